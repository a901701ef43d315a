"""Metadata filters, declarative rules, ordering and paging."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class SearchFilter:
    """A conjunction of optional predicates; a field that is None does not filter."""

    frameworks: list[str] | None = None
    languages: list[str] | None = None
    chunk_types: list[str] | None = None
    path_contains: str | None = None
    path_pattern: str | None = None
    class_name: str | None = None
    function_name: str | None = None
    component_type: str | None = None
    min_complexity: int | None = None
    max_complexity: int | None = None
    has_framework: bool | None = None
    min_lines: int | None = None
    max_lines: int | None = None
    dependencies: list[str] | None = None

    def condition(self) -> Column:
        lines = F.col("end_line") - F.col("start_line") + 1
        within = lambda column, values: F.lower(column).isin([v.lower() for v in values])
        found = [
            self.frameworks and within("framework", self.frameworks),
            self.languages and within("language", self.languages),
            self.chunk_types and within("chunk_type", self.chunk_types),
            self.path_contains and F.col("file_path").contains(self.path_contains),
            self.path_pattern and F.col("file_path").rlike(self.path_pattern),
            self.class_name and F.col("class_name") == self.class_name,
            self.function_name and F.col("function_name") == self.function_name,
            self.component_type and F.col("component_type") == self.component_type,
            None if self.min_complexity is None else F.coalesce("complexity", F.lit(0)) >= self.min_complexity,
            None if self.max_complexity is None else F.coalesce("complexity", F.lit(0)) <= self.max_complexity,
            None if self.has_framework is None else F.col("framework").isNotNull() == self.has_framework,
            None if self.min_lines is None else lines >= self.min_lines,
            None if self.max_lines is None else lines <= self.max_lines,
            # each wanted name is part of some dependency
            self.dependencies and reduce(lambda a, b: a & b, [_any_contains(w) for w in self.dependencies]),
        ]
        return reduce(lambda a, b: a & b, [c for c in found if isinstance(c, Column)], F.lit(True))


def _any_contains(wanted: str) -> Column:
    return F.exists("dependencies", lambda d: d.contains(wanted))


@dataclass
class Rule:
    """``action`` on rows where all ``conditions`` (field, operator, value) hold: exclude, require, boost or demote by ``by``."""

    action: str
    conditions: list[tuple[str, str, object]]
    by: float = 0.0
    name: str = field(default="")

    def condition(self) -> Column:
        return reduce(lambda a, b: a & b, [compare(*c) for c in self.conditions], F.lit(True))


def compare(name: str, operator: str, value: object) -> Column:
    """A field compared with a value; an unknown operator lets every row pass."""
    c = F.col(name)
    found = {
        "equals": lambda: c == value,
        "contains": lambda: c.contains(value),
        "startsWith": lambda: c.startswith(value),
        "endsWith": lambda: c.endswith(value),
        "in": lambda: c.isin(list(value)),
        "range": lambda: c.between(value[0], value[1]),
        "exists": lambda: c.isNotNull(),
    }.get(operator)
    return F.coalesce(found(), F.lit(False)) if found else F.lit(True)


def apply_rules(df: DataFrame, rules: list[Rule], score: str = "score") -> DataFrame:
    """Applies the rules in order; boosts and demotions multiply the score."""
    for rule in rules:
        match = rule.condition()
        if rule.action == "exclude":
            df = df.where(~match)
        elif rule.action == "require":
            df = df.where(match)
        else:
            factor = 1 + rule.by if rule.action == "boost" else 1 - rule.by
            df = df.withColumn(score, F.when(match, F.col(score) * factor).otherwise(F.col(score)))
    return df


def ordered(df: DataFrame, by: str = "score", descending: bool = True, tie: str = "chunk_idx") -> DataFrame:
    """Sorted by score, complexity, lines or path; ties keep the order of insertion."""
    column = {"lines": F.col("end_line") - F.col("start_line") + 1, "alphabetical": F.col("file_path"), "complexity": F.coalesce("complexity", F.lit(0))}.get(by, F.col(by))
    return df.orderBy(column.desc() if descending else column.asc(), tie)


def page(df: DataFrame, offset: int, limit: int) -> DataFrame:
    return df.offset(offset).limit(limit)
