"""Quality of whole projects: seven weighted dimensions, validators, framework rules, and the issues that follow from them.

All of it is sums over a project's parts.  A table of parts has a project column,
id, name, type, framework, content, dependencies, patterns and annotations (both
arrays), importance and complexity.  Texts are read once; what comes behind are
counts, partly summed before they are shuffled, so one project may hold any share
of the parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the dimensions (fixed values).
WEIGHTS = {"accuracy": 0.25, "completeness": 0.2, "relevance": 0.15, "consistency": 0.15, "clarity": 0.1, "timeliness": 0.1, "reliability": 0.05}
#: Points that an issue takes off the overall score (fixed values).
PENALTIES = {"critical": 15.0, "high": 7.0, "medium": 3.0}
#: Least overall score of each level (fixed values).
LEVELS = [(90, "excellent"), (75, "good"), (60, "fair"), (40, "poor")]
LOWEST = "critical"
#: Validator and the least score that passes (fixed values).
VALIDATORS = {"syntax": 70, "structure": 60, "consistency": 70, "completeness": 60, "security": 70}
#: A validation that takes longer is an issue, in milliseconds (fixed value).
SLOW = 5000


@dataclass
class FrameworkRule:
    """A part of a framework whose text has ``has`` and lacks ``lacks`` breaks the rule."""

    framework: str
    rule: str
    severity: str
    has: str
    lacks: str


#: Fixed values.
FRAMEWORK_RULES = [
    FrameworkRule("spring", "spring-constructor-injection", "medium", "@Autowired", "final"),
    FrameworkRule("spring", "spring-transaction-management", "high", "save(", "@Transactional"),
    FrameworkRule("react", "react-hooks-dependencies", "medium", "useEffect", "], ["),
    FrameworkRule("angular", "angular-component-lifecycle", "low", "@Component", "OnDestroy"),
    FrameworkRule("python", "python-type-hints", "low", "def ", ": "),
]


def broken_rules(parts: DataFrame, by: str, rules: list[FrameworkRule] = FRAMEWORK_RULES) -> DataFrame:
    """(by, id, rule, severity): one row for each rule of its framework that a part breaks; null texts and frameworks break none."""
    has = lambda text: F.contains("content", F.lit(text))
    found = [F.when(F.contains("framework", F.lit(r.framework)) & has(r.has) & ~has(r.lacks), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules]
    return parts.select(by, "id", F.inline(F.array_compact(F.array(*found))))


def measures(parts: DataFrame, by: str) -> DataFrame:
    """One row of counts and shares for each project; what both dimensions and validators are made of.

    A project without names is consistent and clear, one without patterns or
    frameworks consistent.  Null texts count as empty, null arrays as empty ones,
    null importance and complexity as 0.
    """
    text = F.coalesce("content", F.lit(""))
    lower = F.lower(text)
    has = lambda c, *words: F.greatest(*[F.contains(c, F.lit(w)) for w in words], F.lit(False))
    times = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    some = lambda name, *words: F.exists(F.coalesce(name, F.array().cast("array<string>")), lambda d: has(d, *words))
    filled = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    named = F.col("name").isNotNull() & (F.col("name") != "")
    is_named = lambda pattern: named & F.col("name").rlike(pattern)
    flags: dict[str, Column] = {
        "parts": F.lit(True),
        "open_brace": has(text, "{") & ~has(text, "}"),
        "open_paren": has(text, "(") & ~has(text, ")"),
        "open_bracket": has(text, "[") & ~has(text, "]"),
        "unlike_braces": times("{") != times("}"),
        "unlike_parens": times("(") != times(")"),
        "named": named,
        "camel": is_named("^[a-z][a-zA-Z0-9]*$"),
        "pascal": is_named("^[A-Z][a-zA-Z0-9]*$"),
        "snake": is_named("^[a-z][a-z0-9_]*$"),
        "clear": named & F.length("name").between(3, 30) & ~F.col("name").rlike("^[a-z]+$"),
        "compliant": filled("annotations") | filled("patterns") | F.col("framework").isNotNull(),
        "spring": F.contains("framework", F.lit("spring")),
        "controllers": F.contains("type", F.lit("controller")),
        "services": F.contains("type", F.lit("service")),
        "repositories": F.contains("type", F.lit("repository")),
        "incomplete": some("dependencies", "undefined", "null"),
        "unresolved": some("dependencies", "undefined"),
        "documented": has(text, "/**", '"""', "///"),
        "unused": (F.coalesce("importance", F.lit(0.0)) < 0.3) & ~filled("dependencies"),
        "vectors": has(lower, "vector") & ~has(lower, "arraylist"),
        "hashtables": has(lower, "hashtable") & ~has(lower, "hashmap"),
        "vars": has(lower, "var ") & ~has(lower, "let ", "const "),
        "modern_java": has(lower, "@override", "lambda", "stream"),
        "modern_js": has(lower, "const ", "let ", "=>"),
        "modern_python": has(lower, "async def", "type hint", "dataclass"),
        "handled": has(lower, "try", "catch", "except", "finally", "throw", "raise"),
        "unchecked": has(lower, ".") & ~has(lower, "null check", "optional"),
        "leaks": has(lower, "new ", "open(") & ~has(lower, "close", "with "),
        "credentials": has(lower, "password") & has(lower, "=") & has(lower, '"'),
        "injections": has(lower, "sql") & has(lower, "+"),
    }
    rows = parts.select(by, "framework", "patterns", F.length(text).alias("size"), F.coalesce(F.col("importance").cast("double"), F.lit(0.0)).alias("importance"), F.coalesce(F.col("complexity").cast("double"), F.lit(0.0)).alias("complexity"), *[F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()])
    # by framework first, for the commonest one of each project
    sums = [F.sum(c).alias(c) for c in ("size", "importance", "complexity")]
    first = rows.groupBy(by, "framework").agg(*sums, *[F.count_if(F.col(k)).alias(k) for k in flags])
    in_framework = F.when(F.col("framework").isNotNull(), F.col("parts"))
    out = first.groupBy(by).agg(*sums, *[F.sum(k).alias(k) for k in flags], F.max(in_framework).alias("most_framework"), F.sum(in_framework).alias("framed"))
    used = rows.select(by, F.explode("patterns").alias("pattern")).groupBy(by, "pattern").agg(F.count("*").alias("n")).groupBy(by).agg(F.max("n").alias("most_pattern"), F.sum("n").alias("patterned"))
    out = out.join(used.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    share = lambda a, b, none: F.when(F.coalesce(F.col(b), F.lit(0)) > 0, F.col(a) / F.col(b)).otherwise(none)
    return out.withColumns(
        {
            "syntax_errors": F.col("open_brace") + F.col("open_paren") + F.col("open_bracket"),
            "naming": F.when(F.col("named") > 0, F.greatest("camel", "pascal", "snake") / F.col("named")).otherwise(1.0),
            "cased": F.when(F.col("named") > 0, F.greatest("camel", "pascal") / F.col("named")).otherwise(1.0),
            "clear_names": share("clear", "named", 1.0),
            "compliance": share("compliant", "parts", 1.0),
            "missing": F.when(F.col("spring") > 0, sum(((F.col(k) == 0).cast("int") for k in ("controllers", "services", "repositories")), F.lit(0))).otherwise(0),
            "documentation": share("documented", "parts", 0.0),
            "deprecated": F.col("vectors") + F.col("hashtables") + F.col("vars"),
            "modern": (F.col("modern_java") + F.col("modern_js") + F.col("modern_python")) / F.col("parts"),
            "handling": share("handled", "parts", 1.0),
            "unreliable": F.col("unchecked") + F.col("leaks"),
            "insecure": F.col("credentials") + F.col("injections"),
            "one_pattern": share("most_pattern", "patterned", 1.0),
            "one_framework": share("most_framework", "framed", 1.0),
        }
    )


def _off(condition: Column, points: int) -> Column:
    return F.when(condition, float(points)).otherwise(0.0)


def _bounded(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def dimensions(measured: DataFrame, issues: DataFrame, by: str) -> DataFrame:
    """Seven scores of each project, the overall one less what its issues (by, severity) cost, and its level.

    Issues of unknown severity cost nothing, those of unknown projects are left out.
    """
    c = F.col
    score = {
        "accuracy": (85.0 - F.least(F.lit(30.0), c("syntax_errors") * 5.0) - _off(c("naming") < 0.8, 10)) * c("compliance"),
        "completeness": 80.0 - c("missing") * 10.0 - c("incomplete") * 5.0 - _off(c("documentation") < 0.5, 15),
        "relevance": 90.0 - _off(c("importance") / c("parts") < 0.5, 20) - F.least(F.lit(15.0), c("unused") * 2.0),
        "consistency": 85.0 - _off(c("one_pattern") < 0.8, 15) - _off(c("one_framework") < 0.9, 10),
        "clarity": 80.0 - _off(c("complexity") / c("parts") > 7, 20) - _off(c("clear_names") < 0.8, 15),
        "timeliness": 95.0 - c("deprecated") * 5.0 - _off(c("modern") < 0.8, 10),
        "reliability": 85.0 - _off(c("handling") < 0.7, 15) - c("unreliable") * 3.0,
    }
    scored = measured.select(by, *[_bounded(s).alias(k) for k, s in score.items()])
    cost = F.lit(0.0)
    for severity, points in PENALTIES.items():
        cost = F.when(c("severity") == severity, points).otherwise(cost)
    costs = issues.groupBy(c(by).alias("_by")).agg(F.sum(cost).alias("cost"))
    base = sum((c(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    out = scored.join(costs, c(by).eqNullSafe(c("_by")), "left").withColumn("overall", F.round(_bounded(base - F.coalesce("cost", F.lit(0.0))), 4))
    level = F.lit(LOWEST)
    for least, name in reversed(LEVELS):
        level = F.when(c("overall") >= least, name).otherwise(level)
    return out.select(by, *[F.round(k, 4).alias(k) for k in WEIGHTS], "overall", level.alias("level"))


def validations(measured: DataFrame, by: str, millis: Column | None = None) -> DataFrame:
    """(by, validator, score, passed, millis): one row for each validator and project; ``millis`` is what a validation took, if it is known."""
    c = F.col
    layered = (c("controllers") > 0) & (c("services") > 0) & (c("repositories") > 0)
    score = {
        "syntax": 100.0 - (c("unlike_braces") + c("unlike_parens")) * 10.0,
        "structure": 90.0 - _off(~layered, 20),
        "consistency": 85.0 * c("cased"),
        "completeness": 80.0 - c("unresolved") * 5.0,
        "security": 95.0 - c("insecure") * 15.0,
    }
    took = (F.lit(None) if millis is None else millis).cast("double").alias("millis")
    row = lambda k: F.struct(F.lit(k).alias("validator"), F.round(F.greatest(F.lit(0.0), score[k]), 4).alias("score"), (score[k] >= least[k]).alias("passed"), took)
    least = VALIDATORS
    return measured.select(by, F.inline(F.array(*[row(k) for k in score])))


def processing_issues(validated: DataFrame, by: str) -> DataFrame:
    """(by, validator, type, severity, confidence): failed validations and slow ones; one may be both."""
    issue = lambda when, *v: F.when(when, F.struct(F.lit(v[0]).alias("type"), F.lit(v[1]).alias("severity"), F.lit(v[2]).alias("confidence")))
    found = F.array(issue(~F.col("passed"), "validation_failure", "high", 0.9), issue(F.col("millis") > SLOW, "performance_degradation", "medium", 0.8))
    return validated.select(by, "validator", F.inline(F.array_compact(found)))
