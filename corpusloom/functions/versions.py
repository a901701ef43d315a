"""Versions and version ranges as arrays of four numbers, which Spark orders as versions are ordered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands above every number of a version.
TOP = 2_000_000_000
WIDTH = 4


def key(version: Column) -> Column:
    """The first four numbers of a version, missing ones 0; null if it does not begin with a number (a leading v is left out)."""
    plain = F.regexp_extract(F.trim(version), r"^[vV]?(\d{1,9}(?:\.\d{1,9})*)", 1)
    numbers = F.transform(F.split(plain, r"\."), lambda x: x.cast("int"))
    return F.when(plain != "", F.slice(F.concat(numbers, F.array_repeat(F.lit(0), WIDTH)), 1, WIDTH))


def _padded(numbers: Column) -> Column:
    return F.slice(F.concat(numbers, F.array_repeat(F.lit(0), WIDTH)), 1, WIDTH)


def _next(numbers: Column, at: Column) -> Column:
    """The first version behind all that begin with the first ``at`` numbers."""
    return F.when(at <= 0, F.array_repeat(F.lit(TOP), WIDTH)).otherwise(_padded(F.concat(F.slice(numbers, F.lit(1), F.greatest(at - 1, F.lit(0))), F.array(F.get(numbers, at - 1) + 1))))


def _clause(clause: Column) -> Column:
    """struct<low, high>: versions from low up to, but not including, high that one clause such as ``^1.2`` allows; null if it is none."""
    op = F.regexp_extract(clause, r"^(\^|~=|~>|~|===?|>=|<=|!=|>|<|=)?", 1)
    stars = F.regexp_extract(clause, r"^(?:\^|~=|~>|~|===?|>=|<=|>|<|=)?\s*[vV]?((?:\d{1,9})(?:\.\d{1,9})*)(?:\.[xX*])+$", 1)
    plain = F.regexp_extract(clause, r"^(?:\^|~=|~>|~|===?|>=|<=|>|<|=)?\s*[vV]?(\d{1,9}(?:\.\d{1,9})*)", 1)
    number = F.transform(F.split(plain, r"\."), lambda x: x.cast("int"))
    n = F.size(number)
    low, bottom, top = _padded(number), F.array_repeat(F.lit(0), WIDTH), F.array_repeat(F.lit(TOP), WIDTH)
    after = F.concat(F.slice(low, 1, WIDTH - 1), F.array(F.get(low, F.lit(WIDTH - 1)) + 1))
    leading = F.when(F.get(number, F.lit(0)) > 0, 1).when(F.coalesce(F.get(number, F.lit(1)), F.lit(0)) > 0, 2).otherwise(F.least(n, F.lit(3)))
    range_ = lambda a, b: F.struct(a.alias("low"), b.alias("high"))
    return (
        F.when(clause.rlike(r"^(\*|[xX]|latest|any|)$"), range_(bottom, top))
        .when(stars != "", range_(low, _next(number, n)))
        .when((plain == "") | (op == "!="), F.when(op == "!=", range_(bottom, top)))
        .when(op == "^", range_(low, _next(number, leading)))
        .when(op == "~", range_(low, _next(number, F.least(n, F.lit(2)))))
        .when(op.isin("~=", "~>"), range_(low, _next(number, F.greatest(n - 1, F.lit(1)))))
        .when(op == ">=", range_(low, top))
        .when(op == ">", range_(after, top))
        .when(op == "<", range_(bottom, low))
        .when(op == "<=", range_(bottom, after))
        .otherwise(range_(low, after))
    )


def ranges(constraint: Column) -> Column:
    """array<struct<low, high>> of a constraint: alternatives between ``||``, whose clauses, between commas or blanks, all hold.

    Understood are ``^``, ``~``, ``~=``, ``~>``, comparisons, ``1.x``, ``2.*``,
    ``*``, ``latest`` and ``1.0 - 2.0``; a bare version is itself.  ``!=`` does not
    narrow a range.  An alternative with a clause that is none of these is left
    out, as is an empty one; a null or empty constraint allows everything.
    """
    text = F.regexp_replace(F.trim(F.coalesce(constraint, F.lit(""))), r"(\S+)\s+-\s+(\S+)", ">=$1 <=$2")
    text = F.regexp_replace(text, r"([\^~<>=!])\s+", "$1")

    def both(alternative: Column) -> Column:
        clauses = F.transform(F.split(F.trim(alternative), r"\s*,\s*|\s+"), _clause)
        lows, highs = F.array_sort(F.transform(clauses, lambda c: c["low"])), F.array_sort(F.transform(clauses, lambda c: c["high"]))
        return F.when(~F.exists(clauses, lambda c: c.isNull()), F.struct(F.element_at(lows, -1).alias("low"), highs[0].alias("high")))

    return F.filter(F.transform(F.split(text, r"\s*\|\|\s*"), both), lambda r: r.isNotNull() & (r["low"] < r["high"]))


def allows(constraint: Column, low: Column, high: Column) -> Column:
    """Whether some version from ``low`` up to ``high`` (keys; null leaves a side open) satisfies the constraint."""
    return F.exists(ranges(constraint), lambda r: (F.coalesce(low, F.array_repeat(F.lit(0), WIDTH)) < r["high"]) & (r["low"] < F.coalesce(high, F.array_repeat(F.lit(TOP), WIDTH))))
