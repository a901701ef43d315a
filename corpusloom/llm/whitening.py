"""Operator 13: whitening by Golub-Kahan-Lanczos bidiagonalisation.

The fitted vectors are the rows of a matrix X, centred at their mean.  Starting
from a unit vector v the method alternates u = Xv and v = X'u, each made
orthogonal to all earlier ones, so that X V = U B with a small bidiagonal B.
Its singular values and right vectors, turned by V, are those of X.

Rows stay where they are, in blocks that Spark reads anew for each product.  A u
has one entry for each row, which is never stored: u = Xg for a short vector g
that the driver keeps beside the v, so a row finds its entries of all earlier u
itself.  A product is one pass over the blocks; each task adds up what its rows
give, and Spark sums these few numbers by their place.  Two passes make a step:
Xv with its coefficients along the earlier u, then, once these are taken off,
the rest of the coefficients and X'u.

The driver holds vectors of the dimension only.  Rows are centred exactly, as
n x - S in integers, before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import size_of_plan, small_batches, written

COMPONENTS = 32
#: Each entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Bytes of a block of rows, and of the input that one task of a pass reads at least.
BLOCK_BYTES = 4 << 20
TASK_BYTES = 32 << 20
#: A singular value below this share of the largest is none, as is what is left of a vector below this share.
NONE = 1e-12
#: Further steps stop where no wanted component can turn by more than this.
SETTLED = 1e-13

RESULTS = {"deviation": "bigint", "whitened": "array<double>"}


def _entries(vector: str):
    return F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is not null, has an entry, and has finite entries only."""
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))


def dimension(df: DataFrame, vector: str) -> int:
    """The commonest length of the usable vectors, of equally common ones the greatest; 0 without any."""
    found = usable(df, vector).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _scaled(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """n x - S, exactly; as Python's integers where 64 bits may not do."""
    most = int(np.abs(x).max(initial=0)) * n + max((abs(int(t)) for t in total), default=0)
    return x * n - total if most < 1 << 62 else x.astype(object) * n - total.astype(object)


def _deviation(scaled: np.ndarray) -> np.ndarray:
    most = int(np.abs(scaled).max(initial=0))
    if most * most * scaled.shape[1] < 1 << 62:
        return (scaled * scaled).sum(axis=1)
    exact = (scaled.astype(object) ** 2).sum(axis=1)
    if max(exact, default=0) >= 1 << 63:
        raise OverflowError("a deviation takes more than 64 bits")
    return exact.astype(np.int64)


class Rows:
    """Vectors as blocks of rows in the shared folder, and sums over them."""

    def __init__(self, df: DataFrame, vector: str, d: int):
        spark = df.sparkSession
        most = max(1, BLOCK_BYTES // (8 * d))

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), most):
                    yield pd.DataFrame({"x": [np.concatenate(pdf["x"].iloc[at : at + most].to_numpy()).astype(np.int64).tobytes()]})

        tasks = max(spark.sparkContext.defaultParallelism, size_of_plan(df) // TASK_BYTES)
        vectors = usable(df, vector).where(F.size(vector) == d).select(_entries(vector).alias("x"))
        self.d = d
        self.blocks = written(vectors.coalesce(tasks).mapInPandas(pack, "x binary"), "vectors").coalesce(tasks)
        self.n, self.total = 0, np.zeros(d, np.int64)
        sums = self._sum(lambda x: np.append(x.sum(axis=0), len(x)), d + 1, "bigint", centred=False)
        self.n, self.total = int(sums[-1]), sums[:-1]

    def _sum(self, f: Callable[[np.ndarray], np.ndarray], size: int, kind: str, centred: bool = True) -> np.ndarray:
        d, n, total, dtype = self.d, self.n, self.total, np.int64 if kind == "bigint" else np.float64

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(size, dtype)
            for pdf in batches:
                for block in pdf["x"]:
                    x = np.frombuffer(block, np.int64).reshape(-1, d)
                    out += f((_scaled(x, n, total) / n).astype(np.float64) if centred else x)
            yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "v": out})

        out = np.zeros(size, dtype)
        for i, v in self.blocks.mapInPandas(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[i] = v
        return out

    def sums(self, f: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum of f over all blocks of centred rows."""
        return self._sum(f, size, "double")

    def product(self, p: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """With t = Xp: the coefficients of t along each u = Xg, its square, and X't."""
        k, d = len(g), self.d

        def f(y: np.ndarray) -> np.ndarray:
            t = y @ p
            return np.concatenate([(y @ g.T).T @ t, [t @ t], y.T @ t])

        out = self.sums(f, k + 1 + d)
        return out[:k], float(out[k]), out[k + 1 :]


def _apart(r: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What is left of ``r`` beside the rows of ``v``; taken off twice, which is enough."""
    for _ in range(2):
        r = r - v.T @ (v @ r)
    return r


def bidiagonalised(rows: Rows, wanted: int, norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right vectors as rows, singular values, both in falling order) of the centred rows, and the bidiagonal matrix.

    Where nothing is left of a u or a v the method goes on from another vector
    beside all earlier ones, so that equal values get as many vectors each.
    """
    d, rng = rows.d, np.random.default_rng(13)
    v, g, w = np.zeros((0, d)), np.zeros((0, d)), np.zeros((0, d))
    alpha: list[float] = []
    beta: list[float] = []
    b, fresh = 0.0, rng.standard_normal(d)
    while True:
        v = np.vstack([v, fresh / np.linalg.norm(fresh)])
        p = v[-1] - b * g[-1] if b else v[-1]
        c, _, _ = rows.product(p, g)
        p = p - g.T @ c
        c, square, back = rows.product(p, g)
        p, back, a = p - g.T @ c, back - w.T @ c, float(np.sqrt(max(square - c @ c, 0.0)))
        if a > NONE * norm:
            g, w = np.vstack([g, p / a]), np.vstack([w, back / a])
        else:
            a, g, w = 0.0, np.vstack([g, np.zeros(d)]), np.vstack([w, np.zeros(d)])
        rest = _apart(w[-1] - a * v[-1], v)
        b = float(np.linalg.norm(rest))
        alpha.append(a)
        k = len(v)
        small = np.diag(alpha) + np.diag(beta, 1)
        left, sigma, right = np.linalg.svd(small)
        if k == d:
            break
        m = min(wanted, k)
        gap = np.array([np.abs(np.delete(sigma, i) - sigma[i]).min(initial=np.inf) for i in range(m)])
        if k > wanted and (b * np.abs(left[-1, :m]) <= SETTLED * np.maximum(gap, NONE * norm)).all():
            break
        if b > NONE * norm:
            fresh = rest
        else:
            b, fresh = 0.0, _apart(rng.standard_normal(d), v)
        beta.append(b)
    return right @ v, sigma, small


@dataclass
class Whitening:
    """Mean and components of a fit; ``components`` are rows, ``values`` the eigenvalues of the covariance."""

    vector: str
    n: int
    total: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def apply(self, df: DataFrame) -> DataFrame:
        """Usable rows of the fitted dimension with deviation and whitened (columns of these names are replaced)."""
        own = [c for c in df.columns if c not in RESULTS]
        n, total, turn = self.n, self.total, (self.components / np.sqrt(self.values)[:, None]).T
        rows = usable(df, self.vector).where(F.size(self.vector) == len(total))
        name = "x" + "_" * (1 + max(map(len, own)))
        schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes if c in own), *(f"{c} {t}" for c, t in RESULTS.items())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    scaled = _scaled(np.stack(pdf[name].to_numpy()).astype(np.int64), n, total)
                    yield pdf[own].assign(deviation=_deviation(scaled), whitened=list((scaled / n).astype(np.float64) @ turn))

        return rows.select(*(f"`{c}`" for c in own), _entries(self.vector).alias(name)).mapInPandas(run, schema)


def fit(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the usable vectors of the commonest length; None without any.

    Vectors that are null or empty, or hold null or non-finite entries, do not
    count, nor do those of another length.  Repeated rows count as often as they
    occur.  At most as many components are found as the vectors span dimensions:
    none for one vector or for equal vectors.  Of a component the entry of
    largest size is positive.  Sums and deviations beyond 64 bits are an error.
    """
    small_batches(df.sparkSession)
    d = dimension(df, vector)
    if not d:
        return None
    rows = Rows(df, vector, d)
    squares = rows.sums(lambda y: (y * y).sum(axis=0), d)
    norm = float(np.sqrt(squares.sum()))
    if not norm:
        return Whitening(vector, rows.n, rows.total, np.zeros((0, d)), np.zeros(0), np.zeros(0), 0.0)
    right, sigma, _ = bidiagonalised(rows, components, norm)
    k = min(components, int((sigma > NONE * sigma[0]).sum()))
    right, values = right[:k] / np.linalg.norm(right[:k], axis=1, keepdims=True), sigma[:k] ** 2 / rows.n
    right = right * np.sign(right[np.arange(k), np.abs(right).argmax(axis=1)])[:, None]
    turn = (right / np.sqrt(values)[:, None]).T
    square = rows.sums(lambda y: ((t := y @ turn).T @ t).ravel(), k * k).reshape(k, k) / rows.n
    return Whitening(vector, rows.n, rows.total, right, values, values * rows.n / squares.sum(), float(np.abs(square - np.eye(k)).max()))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each usable vector and component."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    model = fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], schema)
    explained = F.array(*(F.lit(float(x)) for x in model.explained))
    each = model.apply(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
