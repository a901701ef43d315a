"""Expressions that are a Spark column and the SQL that it is compared with, for rule tables that both engines read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.code import quoted
from .registry import ORACLE_SQL, QUERIES


class X:
    """A column, made when it is asked for, since that needs a session, and its SQL."""

    def __init__(self, make: Callable[[], Column], sql: str):
        self.make, self.sql = make, sql

    @property
    def col(self) -> Column:
        return self.make()

    def _with(self, other: object, symbol: str, f) -> X:
        o = lit(other)
        return X(lambda: f(self.col, o.col), f"({self.sql} {symbol} {o.sql})")

    def __add__(self, o: object) -> X:
        return self._with(o, "+", lambda a, b: a + b)

    def __sub__(self, o: object) -> X:
        return self._with(o, "-", lambda a, b: a - b)

    def __mul__(self, o: object) -> X:
        return self._with(o, "*", lambda a, b: a * b)

    def __truediv__(self, o: object) -> X:
        return self._with(o, "/", lambda a, b: a / b)

    def __gt__(self, o: object) -> X:
        return self._with(o, ">", lambda a, b: a > b)

    def __ge__(self, o: object) -> X:
        return self._with(o, ">=", lambda a, b: a >= b)

    def __lt__(self, o: object) -> X:
        return self._with(o, "<", lambda a, b: a < b)

    def __eq__(self, o: object) -> X:  # type: ignore[override]
        return self._with(o, "=", lambda a, b: a == b)

    def __and__(self, o: X) -> X:
        return self._with(o, "AND", lambda a, b: a & b)

    def __or__(self, o: X) -> X:
        return self._with(o, "OR", lambda a, b: a | b)

    def __invert__(self) -> X:
        return X(lambda: ~self.col, f"(NOT {self.sql})")

    def contains(self, *texts: str) -> X:
        """Whether one of the texts stands in it."""
        out = None
        for t in texts:
            x = X(lambda t=t: F.contains(self.col, F.lit(t)), f"contains({self.sql}, {quoted(t)})")
            out = x if out is None else out | x
        return out

    def ends(self, *texts: str) -> X:
        out = None
        for t in texts:
            x = X(lambda t=t: F.endswith(self.col, F.lit(t)), f"ends_with({self.sql}, {quoted(t)})")
            out = x if out is None else out | x
        return out

    def rlike(self, pattern: str) -> X:
        return X(lambda: self.col.rlike(pattern), f"regexp_matches({self.sql}, {quoted(pattern)})")

    def count(self, pattern: str) -> X:
        return X(lambda: F.regexp_count(self.col, F.lit(pattern)).cast("double"), f"CAST(len(regexp_extract_all({self.sql}, {quoted(pattern)})) AS DOUBLE)")

    def all(self, pattern: str, group: int = 0) -> X:
        """All matches, in order."""
        return X(lambda: F.regexp_extract_all(self.col, F.lit(pattern), F.lit(group)), f"regexp_extract_all({self.sql}, {quoted(pattern)}, {group})")

    def first(self, pattern: str, group: int = 0) -> X:
        return X(lambda: F.regexp_extract(self.col, pattern, group), f"regexp_extract({self.sql}, {quoted(pattern)}, {group})")

    def lower(self) -> X:
        return X(lambda: F.lower(self.col), f"lower({self.sql})")

    def length(self) -> X:
        return X(lambda: F.length(self.col).cast("double"), f"CAST(length({self.sql}) AS DOUBLE)")

    def lines(self, pattern: str | None = None) -> X:
        """Number of lines, or of those that the pattern matches."""
        split = lambda: F.split(self.col, "\n", -1)
        if pattern is None:
            return X(lambda: F.size(split()).cast("double"), f"CAST(len(string_split({self.sql}, chr(10))) AS DOUBLE)")
        return X(lambda: F.size(F.filter(split(), lambda x: x.rlike(pattern))).cast("double"), f"CAST(len(list_filter(string_split({self.sql}, chr(10)), lambda x: regexp_matches(x, {quoted(pattern)}))) AS DOUBLE)")

    def joined(self) -> X:
        return X(lambda: F.concat_ws("|", self.col), f"array_to_string({self.sql}, '|')")

    def distinct(self) -> X:
        """Different values, sorted and joined."""
        return X(lambda: F.concat_ws("|", F.array_sort(F.array_distinct(self.col))), f"array_to_string(list_sort(list_distinct({self.sql})), '|')")

    def size(self) -> X:
        return X(lambda: F.size(self.col).cast("double"), f"CAST(len({self.sql}) AS DOUBLE)")

    def where(self, keep) -> X:
        """Elements of an array that ``keep`` (X to X) holds for."""
        return X(lambda: F.filter(self.col, lambda x: keep(X(lambda: x, "x")).col), f"list_filter({self.sql}, lambda x: {keep(X(lambda: F.lit(''), 'x')).sql})")


def col(name: str) -> X:
    return X(lambda: F.col(name), name)


def lit(value: object) -> X:
    if isinstance(value, X):
        return value
    if isinstance(value, bool):
        return X(lambda: F.lit(value), str(value).lower())
    if isinstance(value, str):
        return X(lambda: F.lit(value), quoted(value))
    return X(lambda: F.lit(float(value)), f"CAST({float(value)!r} AS DOUBLE)")


def first_of(cases: list[tuple[object, X]], otherwise: object) -> X:
    """The value of the first case that holds."""
    values = [(lit(value), cond) for value, cond in cases]
    last = lit(otherwise)

    def make() -> Column:
        out = None
        for v, cond in values:
            out = F.when(cond.col, v.col) if out is None else out.when(cond.col, v.col)
        return out.otherwise(last.col)

    return X(make, "CASE" + "".join(f" WHEN {cond.sql} THEN {v.sql}" for v, cond in values) + f" ELSE {last.sql} END")


def weighed(base: float, cases: list[tuple[float, X]], most: float | None = None) -> X:
    """``base`` and the weights of all cases that hold, at most ``most``; rounded, since sums of tenths are not exact."""
    total = lit(base)
    for weight, cond in cases:
        total = total + first_of([(weight, cond)], 0.0)
    return rounded(total if most is None else least(total, most))


def labels(cases: list[tuple[str, X]]) -> X:
    """The labels of all cases that hold, in order, joined."""
    return X(lambda: F.concat_ws("|", *[F.when(c.col, F.lit(v)) for v, c in cases]), "concat_ws('|', " + ", ".join(f"CASE WHEN {c.sql} THEN {quoted(v)} END" for v, c in cases) + ")")


def chained(*arrays: X) -> X:
    return X(lambda: F.concat(*[a.col for a in arrays]), "list_concat(" + ", ".join(a.sql for a in arrays) + ")" if len(arrays) == 2 else f"flatten([{', '.join(a.sql for a in arrays)}])")


def rounded(x: X, digits: int = 6) -> X:
    return X(lambda: F.round(x.col, digits), f"round({x.sql}, {digits})")


def log(x: X) -> X:
    return X(lambda: F.log(x.col), f"ln({x.sql})")


def least(*xs: object) -> X:
    ys = [lit(x) for x in xs]
    return X(lambda: F.least(*[y.col for y in ys]), f"least({', '.join(y.sql for y in ys)})")


def greatest(*xs: object) -> X:
    ys = [lit(x) for x in xs]
    return X(lambda: F.greatest(*[y.col for y in ys]), f"greatest({', '.join(y.sql for y in ys)})")


#: Columns of each rule query, so that its rules can be applied to other tables.
RULES: dict[str, dict[str, X]] = {}


def applied(name: str, rows: DataFrame) -> DataFrame:
    """The columns of a rule query for ``rows``, a table with the columns that the query's own table has."""
    return rows.select(*[x.col.alias(k) for k, x in RULES[name].items()])


def derived(name: str, doc: str, source, with_sql: str, table: str, columns: dict[str, X], where: X | None = None) -> None:
    """Registers a query that computes columns of each row of a table, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = source(spark, sf_dir)
        return applied(name, rows if where is None else rows.where(where.col))

    RULES[name] = columns
    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {with_sql} SELECT {', '.join(f'{x.sql} AS {k}' for k, x in columns.items())} FROM {table}" + (f" WHERE {where.sql}" if where is not None else "")
