"""Routes of URL tables that include others, and of nested resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import Rounds

#: A table's entries: a pattern, then what it names or which module it includes.
_ENTRY = r"""\b(re_path|path|url)\s*\(\s*r?(['"])(.*?)\2\s*,\s*(?:include\s*\(\s*\(?\s*(?:['"]([\w.]+)['"]|([\w.]+))|([\w.]+))"""
#: Rows of a resource: method, what follows its path, action (fixed values); those of a single one have no list and no id.
RESOURCE = [("GET", "", "index"), ("GET", "/:id", "show"), ("POST", "", "create"), ("PUT", "/:id", "update"), ("DELETE", "/:id", "destroy")]
SINGLE = [("GET", "", "show"), ("POST", "", "create"), ("PUT", "", "update"), ("DELETE", "", "destroy")]


def normal_path(path: Column) -> Column:
    """One slash in front, none doubled, none at the end; anchors of patterns go."""
    plain = F.regexp_replace(F.concat(F.lit("/"), F.regexp_replace(path, r"\^|\$|\\Z", "")), r"/+", "/")
    return F.when(F.length(plain) > 1, F.regexp_replace(plain, r"/$", "")).otherwise(plain)


def module_of(file_path: Column) -> Column:
    """The module name of a Python file: folders joined by dots."""
    return F.regexp_replace(F.regexp_replace(file_path, r"(/__init__)?\.py$", ""), "/", ".")


def url_entries(files: DataFrame) -> DataFrame:
    """(module, at, pattern, handler, included) of every entry of ``urlpatterns`` in files (file_path, content); comment lines do not count."""
    code = F.regexp_replace("content", r"(?m)^[ \t]*#.*$", "")
    part = lambda n: F.regexp_extract_all(F.col("code"), F.lit(_ENTRY), F.lit(n))
    rows = files.where(F.col("content").rlike(r"\burlpatterns\b")).select(module_of(F.col("file_path")).alias("module"), code.alias("code"))
    rows = rows.select("module", F.posexplode(F.arrays_zip(part(3).alias("pattern"), part(4).alias("quoted"), part(5).alias("bare"), part(6).alias("handler"))).alias("at", "e"))
    included = F.coalesce(F.nullif(F.col("e.quoted"), F.lit("")), F.nullif(F.col("e.bare"), F.lit("")))
    return rows.select("module", "at", F.col("e.pattern").alias("pattern"), F.nullif(F.col("e.handler"), F.lit("")).alias("handler"), included.alias("included"))


def included_routes(entries: DataFrame) -> DataFrame:
    """(root, path, handler, modules): all routes that each root module gives, with the includes followed to any depth.

    Roots are modules that no other includes; where modules only include each
    other, the first by name of them all is one.  A module that includes itself,
    over others or not, is not entered again.  An included module without entries
    gives no route.  Each round joins the open prefixes to the entries.
    """
    rounds = Rounds(entries.sparkSession)
    entries = rounds.keep("entries", entries)
    modules = entries.select("module").distinct()
    known = entries.where("included IS NOT NULL AND included <> module").select(F.col("included").alias("module")).distinct()
    roots = modules.join(known, "module", "left_anti")
    reached = _reached(rounds, roots, entries)
    while True:
        left = modules.join(reached, "module", "left_anti").agg(F.min("module").alias("module")).where("module IS NOT NULL")
        if left.isEmpty():
            break
        roots = rounds.keep("roots", roots.unionByName(left))
        reached = _reached(rounds, roots, entries)
    open_ = rounds.keep("open", roots.select(F.col("module").alias("root"), "module", F.lit("").alias("prefix"), F.array("module").alias("modules")))
    out, n = None, 0
    while not open_.isEmpty():
        step = open_.join(entries, "module").withColumn("whole", F.concat("prefix", F.lit("/"), "pattern"))
        found = rounds.keep(f"found-{n}", step.where("included IS NULL").select("root", normal_path(F.col("whole")).alias("path"), "handler", "modules"))
        out = found if out is None else out.unionByName(found)
        onward = step.where(F.col("included").isNotNull() & ~F.array_contains("modules", F.col("included")))
        open_ = rounds.keep("open", onward.select("root", F.col("included").alias("module"), F.col("whole").alias("prefix"), F.concat("modules", F.array("included")).alias("modules")))
        n += 1
    if out is None:
        out = roots.select(F.col("module").alias("root"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("handler"), F.array("module").alias("modules")).limit(0)
    return out


def _reached(rounds: Rounds, roots: DataFrame, entries: DataFrame) -> DataFrame:
    links = entries.where("included IS NOT NULL").select("module", "included").distinct()
    seen = rounds.keep("seen", roots.select("module").distinct())
    new = seen
    while not new.isEmpty():
        new = rounds.keep("new", new.join(links, "module").select(F.col("included").alias("module")).distinct().join(seen, "module", "left_anti"))
        seen = rounds.keep("seen", seen.unionByName(new))
    return seen


def resource_routes(files: DataFrame) -> DataFrame:
    """(file_path, method, path, handler) of Rails route files (file_path, content).

    ``resources`` gives five rows and ``resource`` four; inside the block of
    another one its path follows that one's path and id, to any depth, and inside
    a ``namespace`` or ``scope`` that one's name.  Single routes name their
    method, path and handler.  Blocks are told by their indentation.
    """
    line = r"^([ \t]*)(resources|resource|namespace|scope|get|post|put|patch|delete)\s+(?::(\w+)|['\"]([^'\"]*)['\"])(?:.*?\bto:\s*['\"]([^'\"]+)['\"])?"
    rows = files.select("file_path", F.posexplode(F.split("content", "\n")).alias("at", "line")).where(F.col("line").rlike(line) & ~F.col("line").rlike(r"^\s*#"))
    part = lambda n: F.regexp_extract("line", line, n)
    rows = rows.select("file_path", "at", F.length(part(1)).alias("indent"), part(2).alias("word"), F.coalesce(F.nullif(part(3), F.lit("")), part(4)).alias("name"), F.nullif(part(5), F.lit("")).alias("to"), F.col("line").rlike(r"\bdo\b(\s*\|.*\|)?\s*$").alias("block"))
    # the open blocks of a file, outermost first, at each of its lines: a list that only its own few routes bound
    each = rows.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("at", "indent", "word", "name", "to", "block"))).alias("l"))
    around = lambda x: F.filter("l", lambda y: y["block"] & (y["at"] < x["at"]) & (y["indent"] < x["indent"]) & ~F.exists("l", lambda z: (z["at"] > y["at"]) & (z["at"] < x["at"]) & (z["indent"] <= y["indent"])))
    step = lambda y: F.concat(F.lit("/"), y["name"], F.when(y["word"] == "resources", F.concat(F.lit("/:"), F.regexp_replace(y["name"], "s$", ""), F.lit("_id"))).otherwise(F.lit("")))
    each = each.select("file_path", F.inline(F.transform("l", lambda x: F.struct(x["word"].alias("word"), x["name"].alias("name"), x["to"].alias("to"), F.array_join(F.transform(around(x), step), "").alias("prefix")))))
    made = lambda rows_: F.array(*[F.struct(F.lit(m).alias("method"), F.concat("prefix", F.lit("/"), "name", F.lit(p)).alias("path"), F.concat("name", F.lit("#"), F.lit(a)).alias("handler")) for m, p, a in rows_])
    single = F.array(F.struct(F.upper("word").alias("method"), F.concat("prefix", F.lit("/"), "name").alias("path"), F.coalesce("to", F.lit("unknown")).alias("handler")))
    found = F.when(F.col("word") == "resources", made(RESOURCE)).when(F.col("word") == "resource", made(SINGLE)).when(F.col("word").isin("namespace", "scope"), F.slice(single, 1, 0)).otherwise(single)
    return each.select("file_path", F.inline(found)).select("file_path", "method", normal_path(F.col("path")).alias("path"), "handler")
