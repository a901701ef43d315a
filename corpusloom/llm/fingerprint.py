"""Operator 1: document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text is cut into paragraphs (lines, cut again at sentence ends and after
``PIECE`` characters) and each becomes a 64-bit digest; the n-th repetition of
a paragraph has a digest of its own, so a text is a *set* of digests.  A sketch
is an array of ``HASHES`` sub-tables of ``CELLS`` cells; a digest lies in one
cell of each.  A cell holds the number of its digests, their exclusive or, and
the exclusive or of a check hash.  The fingerprint of a text is its sketch,
written as text; it has the same size however long the text is.

Two versions are compared by subtracting fingerprint from fingerprint, cell by
cell, which leaves the differing digests only, and peeling: a cell with a single
digest gives it away, and the digest is taken out of the other sub-tables.  A
fingerprint is sized for a small difference.  Where cells remain, the spread of
the subtracted counts tells how many digests differ, and the pair is retried on
a sketch of as many blocks of the same shape as that difference asks for,
however long both texts are; a block that fails is retried on four blocks with
other hashes, and what not even these give away (a few digests in millions) is
told by comparing the digests of that block.

All of this is array functions inside one row; the only shuffle brings each
text beside its next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, let, size_of_text

PIECE = 200
HASHES = 3
#: Cells of each sub-table.
CELLS = 8
#: Differing digests that a block of the larger sketch is meant for, and the logarithm of the blocks that are dealt out in one step.
BLOCK = 10
#: Factor on the estimated difference, whose error is about a third.
MARGIN = 1.4
SUPER = 6
#: Rounds of peeling; each takes out all digests that lie alone in a cell.
ROUNDS = 10
#: Quantiles of the ids that the driver holds, and bytes of text in each range of ids; there are more ranges than quantiles only beyond their product.
QUANTILES = 512
RANGE_BYTES = 64 << 20

FOUND = "array<struct<n:int,k:bigint>>"


def digests(text: Column) -> Column:
    """The set of paragraph digests of a text, sorted; null and empty texts have none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\n.!?]{{1,{PIECE}}}[\n.!?]*|[\n.!?]+"), F.lit(0))

    def told_apart(once: Column) -> Column:
        """Equal digests stand together; each run is numbered from where it begins."""
        begins = F.filter(F.sequence(F.lit(0), F.size(once) - 1), lambda i: (i == 0) | (F.get(once, i) != F.get(once, i - 1)))
        run = lambda begins: F.flatten(F.transform(begins, lambda b, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(begins, j + 1), F.size(once)) - b - 1), lambda q: F.when(q == 0, F.get(once, b)).otherwise(F.xxhash64(F.get(once, b), q)))))
        return let(begins, run)

    return let(F.array_sort(F.transform(pieces, lambda p: F.xxhash64(p))), lambda once: F.when(F.size(F.array_distinct(once)) == F.size(once), once).otherwise(told_apart(once)))


def _shifted(name: str, x: Column | int, by: Column) -> Column:
    return F.call_function(name, F.lit(x) if isinstance(x, int) else x, by.cast("int"))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit(HASHES)).bitwiseAND(F.lit((1 << 32) - 1))


def _mask(h: Column) -> Column:
    """The cells of a digest, one of each sub-table, as bits."""
    bits = [_shifted("shiftleft", 1 << (CELLS * t), _shifted("shiftright", h, F.lit(3 * t)).bitwiseAND(F.lit(CELLS - 1))) for t in range(HASHES)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _elements(keys: Column, n: int = 1, seed: int = 0) -> Column:
    """Digests of a side (``n`` 1 or -1) with their check hash, cells and the hash that deals them out: array of (n, k, c, m, h)."""
    hashed = F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k, F.lit(64 + seed)).alias("h")))
    return F.transform(hashed, lambda e: F.struct(F.lit(n).alias("n"), e["k"].alias("k"), _check(e["k"]).alias("c"), _mask(e["h"]).alias("m"), e["h"].alias("h")))


def _minus(elements: Column) -> Column:
    """The same elements on the other side."""
    return F.transform(elements, lambda e: F.struct((-e["n"]).alias("n"), *[e[x].alias(x) for x in ("k", "c", "m", "h")]))


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.alias("n"), k.alias("k"), c.alias("c"))


def _summed(cell: Column, elements: Column, i: Column, sign: int = 1) -> Column:
    """A cell with those elements put in (``sign`` 1) or taken out that lie in it."""
    own = F.filter(elements, lambda e: F.bit_get(e["m"], i) == F.lit(1).cast("tinyint"))
    return F.aggregate(own, cell, lambda a, e: _cell(a["n"] + e["n"] if sign > 0 else a["n"] - e["n"], a["k"].bitwiseXOR(e["k"]), a["c"].bitwiseXOR(e["c"])))


def _cells(elements: Column) -> Column:
    """The sketch of the elements of one side, or the difference of the sketches of both."""
    none = _cell(F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES * CELLS - 1)), lambda i: _summed(none, elements, i))


def sketch(keys: Column) -> Column:
    """The sketch of a set of digests: array of ``HASHES * CELLS`` cells (n, k, c)."""
    return let(_elements(keys), _cells)


def serialised(cells: Column) -> Column:
    """A sketch as text: for each cell its count (4 hex digits), digests (16) and checks (8)."""
    digits = lambda x, n: F.lpad(F.hex(x), n, "0")
    cell = lambda c: F.concat(digits(F.pmod(c["n"], F.lit(65536)).cast("long"), 4), digits(c["k"], 16), digits(c["c"], 8))
    return F.lower(F.concat_ws("", F.transform(cells, cell)))


def parsed(fingerprint: Column) -> Column:
    """The sketch that ``serialised`` wrote; counts are modulo 65536."""
    number = lambda at, size: F.conv(F.substr(fingerprint, at, F.lit(size)), 16, -10).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(HASHES * CELLS - 1)), lambda i: _cell(number(i * 28 + 1, 4).cast("int"), number(i * 28 + 5, 16), number(i * 28 + 21, 8)))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"])))


def peeled(cells: Column, seed: int = 0) -> Column:
    """What a subtracted sketch gives away: found, array of (n, k) with n 1 for the first side and -1 for the second; null if cells remain."""

    def taken(state: Column, alone: Column) -> Column:
        out = F.transform(alone, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k"), p["c"].alias("c"), _mask(F.xxhash64(p["k"], F.lit(64 + seed))).alias("m")))
        touched = lambda out: F.aggregate(out, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(p["m"]))
        cell = lambda s: F.transform(state["cells"], lambda c, i: F.when(F.bit_get(s["any"], i) == F.lit(1).cast("tinyint"), _summed(c, s["out"], i, -1)).otherwise(c))
        left = let(let(out, lambda out: F.struct(out.alias("out"), touched(out).alias("any"))), cell)
        found = F.transform(alone, lambda p: F.struct(p["n"].alias("n"), p["k"].alias("k")))
        return F.struct(left.alias("cells"), F.concat(state["found"], found).alias("found"), F.lit(True).alias("more"))

    def ended(state: Column) -> Column:
        return F.struct(state["cells"].alias("cells"), state["found"].alias("found"), F.lit(False).alias("more"))

    def round_(state: Column) -> Column:
        alone = F.array_distinct(F.filter(state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (c["c"] == _check(c["k"]))))
        return let(alone, lambda alone: F.when(F.size(alone) > 0, taken(state, alone)).otherwise(ended(state)))

    begin = F.struct(cells.alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(True).alias("more"))
    state = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, lambda s, _: F.when(s["more"], round_(s)).otherwise(s))
    return let(state, lambda s: F.when(F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0)), s["found"]))


def _one_by_one(elements: Column) -> Column:
    keys = lambda n: F.transform(F.filter(elements, lambda e: e["n"] == n), lambda e: e["k"])
    only = lambda a, b, n: F.transform(F.array_except(a, b), lambda k: F.struct(F.lit(n).alias("n"), k.alias("k")))
    return let(F.struct(keys(1).alias("p"), keys(-1).alias("m")), lambda s: F.concat(only(s["p"], s["m"], 1), only(s["m"], s["p"], -1)))


def _block(e: Column, lg: Column) -> Column:
    """The block of an element out of 2**lg, lg > 0."""
    return _shifted("shiftrightunsigned", e["h"], 64 - lg)


def _over(first: Column, last: Column, body: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(F.sequence(first.cast("long"), last.cast("long")), body))


def estimated(cells: Column, plus: Column, minus: Column) -> Column:
    """How many digests a subtracted sketch of two sides' elements holds, from the spread of its counts, with a margin.

    In a sub-table d digests of either sign give the counts a sum of squares
    about their mean of d * (1 - 1 / CELLS) on average; the error of all
    sub-tables together is about a third.
    """
    surplus = F.size(plus) - F.size(minus)
    mean = surplus / CELLS
    squares = F.aggregate(cells, F.lit(0.0), lambda a, c: a + (c["n"] - mean) * (c["n"] - mean))
    spread = F.greatest(F.abs(surplus).cast("double"), squares * (MARGIN / (HASHES * (1 - 1 / CELLS))))
    return F.least(spread, (F.size(plus) + F.size(minus)).cast("double"))


def larger(plus: Column, minus: Column, differing: Column) -> Column:
    """The differing digests of two sides' elements, array of (n, k), by a sketch for about ``differing`` of them."""

    def retried(own: Column) -> Column:
        side = lambda n: _elements(F.transform(F.filter(own, lambda e: e["n"] == n), lambda e: e["k"]), n, 1)
        part = lambda again, g: F.filter(again, lambda e: _block(e, F.lit(2)) == g)
        block = lambda own: F.coalesce(peeled(_cells(own), 1), _one_by_one(own))
        return let(F.concat(side(1), side(-1)), lambda again: _over(F.lit(0), F.lit(3), lambda g: let(part(again, g), block)))

    def block(own: Column) -> Column:
        return F.coalesce(peeled(_cells(own)), retried(own))

    def dealt(s: Column) -> Column:
        """Blocks are dealt out in two steps, so that a long text's digests are not searched once for each of its blocks."""
        few = F.least(s["lg"], F.lit(SUPER))
        many = s["lg"] - few
        outer = lambda g: F.when(many == 0, s["own"]).otherwise(F.filter(s["own"], lambda e: _block(e, many) == g))
        size = _shifted("shiftleft", F.lit(1).cast("long"), few)
        inner = lambda own, g: _over(g * size, (g + 1) * size - 1, lambda b: let(F.filter(own, lambda e: _block(e, s["lg"]) == b), block))
        return _over(F.lit(0), _shifted("shiftleft", F.lit(1).cast("long"), many) - 1, lambda g: let(outer(g), lambda own: inner(own, g)))

    lg = F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(differing, F.lit(1.0)) / BLOCK))).cast("int")
    return let(F.struct(F.concat(plus, _minus(minus)).alias("own"), lg.alias("lg")), dealt)


def difference(a: Column, b: Column, plus: Column, minus: Column) -> Column:
    """(found, tries): the differing digests of two texts from their sketches ``a`` and ``b``, or else from larger ones of their elements."""
    # a sketch of so many cells cannot give away more digests than it has cells
    hopeless = F.abs(F.size(plus) - F.size(minus)) > HASHES * CELLS

    def compared(cells: Column) -> Column:
        small = F.when(hopeless, F.lit(None).cast(FOUND)).otherwise(peeled(cells))
        return let(small, lambda s: F.struct(F.coalesce(s, larger(plus, minus, estimated(cells, plus, minus))).alias("found"), F.when(s.isNull(), 2).otherwise(1).alias("tries")))

    return let(subtracted(a, b), compared)


def one_sided(found: Column, sign: int) -> Column:
    """How many of the digests found stand on one side only."""
    return F.size(F.filter(found, lambda f: f["n"] == sign)).cast("long")


def likeness(found: Column, size: Column) -> Column:
    """1 less the share of the ``size`` digests of both sides that have no counterpart; two empty sets are alike."""
    return F.when(size == 0, 1.0).otherwise(1.0 - F.size(found) / size)


def diff_versions(df: DataFrame, old: str, new: str) -> DataFrame:
    """Adds removed_digests and added_digests (array<bigint>, sorted) between two versions of a text in each row.

    Null versions count as empty; columns of these names are replaced.  Rows are
    handled one by one: repeated rows give repeated results, and an empty table
    an empty one.
    """
    own = [c for c in df.columns if c not in ("removed_digests", "added_digests")]
    rows = df.select(F.struct(*own).alias("row"), digests(F.col(old)).alias("plus"), digests(F.col(new)).alias("minus"))
    rows = rows.select("row", *[_elements(F.col(c)).alias(c) for c in ("plus", "minus")])
    rows = rows.select("row", difference(_cells(F.col("plus")), _cells(F.col("minus")), F.col("plus"), F.col("minus"))["found"].alias("found"))
    side = lambda sign: F.sort_array(F.transform(F.filter("found", lambda f: f["n"] == sign), lambda f: f["k"]))
    return rows.select("row.*", side(1).alias("removed_digests"), side(-1).alias("added_digests"))


def _ranges(docs: DataFrame, quantiles: int, range_bytes: int) -> tuple[Column, int]:
    """The range of each doc_id, larger ids first, and the number of ranges.

    The driver holds at most ``quantiles`` bounds; between two of them ids are
    dealt out evenly over as many ranges as the size of the table asks for.
    Missing ids are a range of their own, the last one.
    """
    low, high, inner = docs.agg(F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / quantiles for i in range(1, quantiles)], 20 * quantiles)).first()
    if low is None:
        return F.lit(0), 1
    edges = sorted({low, high, *inner})
    each = -(-size_of_text(docs) // (range_bytes * quantiles))
    step = max(int(len(edges) ** 0.5), 1)
    # two short searches: among every step-th edge, then among those behind it
    count = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    edge = F.lit(edges).cast("array<bigint>")
    outer = (count(F.lit(edges[::step]).cast("array<bigint>")) - 1) * step
    at = let(outer, lambda o: o + count(F.slice(edge, o + 1, F.lit(step))) - 1)
    begin = lambda i: F.get(edge, i).cast("double")
    inside = lambda i: F.coalesce(F.least(F.floor((F.col("doc_id").cast("double") - begin(i)) / (begin(i + 1) - begin(i)) * each), F.lit(each - 1)), F.lit(0))
    n = len(edges) * each
    return F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(n - 1 - let(at, lambda i: i * each + inside(i))), n + 1


def with_next(docs: DataFrame, quantiles: int = QUANTILES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, text, keys, cells (its digests, as elements, and sketch) and the same of the next text: next_text, next_keys, next_cells.

    Next is the following row in descending doc_id, the first row after the
    last.  Ids are dealt out by ranges; the first row of a range is also sent,
    as a ghost, to the range before it.  Missing ids come last; rows of equal
    ids follow their text's hash, then their text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    part, _ = _ranges(docs, quantiles, range_bytes)
    docs = docs.withColumn("part", part.cast("long"))
    # one row a range, so the join below may broadcast it
    first = docs.groupBy("part").agg(F.max("doc_id").alias("top"))
    around = Window.orderBy("part")
    heads = first.select("part", "top", F.coalesce(F.lag("part").over(around), F.max("part").over(Window.partitionBy())).alias("before"))
    joined = docs.join(F.broadcast(heads), "part", "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("top"))
    own = F.struct(F.lit(False).alias("ghost"), F.col("part").alias("to"))
    ghost = F.struct(F.lit(True).alias("ghost"), F.col("before").alias("to"))
    dealt = joined.select("doc_id", "text", F.explode(F.when(is_head, F.array(own, ghost)).otherwise(F.array(own))).alias("g"))
    dealt = dealt.select(F.col("g.to").alias("part"), F.col("g.ghost").alias("ghost"), "doc_id", "text", F.xxhash64("text").alias("tie"))
    # digests are taken behind the shuffle, once for a text, and its sketch goes along to the text before it
    rows = dealt.repartition("part").withColumn("keys", _elements(digests(F.col("text"))))
    rows = rows.withColumn("cells", _cells(F.col("keys")))
    order = Window.partitionBy("part").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "tie", "text")
    nexts = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "keys", "cells")]
    return rows.select("ghost", "doc_id", "text", "keys", "cells", *nexts).where("NOT ghost").drop("ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are to each other and to the next text's.

    Nulls count as empty texts; an empty text has an all-zero fingerprint, and
    two empty texts are alike (1.0).  A single row is its own next.  Texts of
    any length have fingerprints of the same size; work grows in proportion to
    a text's paragraphs, also where these repeat.  Further columns of ``docs``
    are ignored; repeated rows give repeated results, an empty table none.
    """
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next_text, 1, cast(floor(length(text) / 2) as int))"))
    rows = rows.withColumn("edited", F.when(half > 0, edited).otherwise(F.col("text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "keys", "cells", "next_keys", "next_cells", _elements(digests(F.col("edited"))).alias("edited_keys"))
    rows = rows.withColumn("edited_cells", _cells(F.col("edited_keys")))
    versus = lambda other: F.struct(F.col("cells").alias("a"), F.col(f"{other}_cells").alias("b"), F.col("keys").alias("plus"), F.col(f"{other}_keys").alias("minus"))
    rows = rows.withColumn("to", F.transform(F.array(versus("edited"), versus("next")), lambda v: difference(*(v[c] for c in ("a", "b", "plus", "minus"))))).withColumns({"to_edited": F.col("to")[0], "to_next": F.col("to")[1]})
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        serialised(F.col("cells")).alias("fingerprint"),
        serialised(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(F.col("to_edited.found"), F.size("keys") + F.size("edited_keys")).alias("near_edited"),
        likeness(F.col("to_next.found"), F.size("keys") + F.size("next_keys")).alias("near_next"),
        one_sided(F.col("to_edited.found"), 1).alias("n_removed_paragraphs"),
        one_sided(F.col("to_edited.found"), -1).alias("n_added_paragraphs"),
        F.col("to_edited.tries").alias("tries_edited"),
        F.col("to_next.tries").alias("tries_next"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
