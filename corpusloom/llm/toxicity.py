"""Operator 8: toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon learned from labelled rows, how near
its words stand to second-person words, shares of capitals and punctuation, and
rates of obfuscation (letters swapped for digits or symbols, stretched letters,
letters spaced apart).  Trees are fitted with Spark ML on a bounded sample of
labelled rows; another part of the sample calibrates them with isotonic
regression.  Labels are used for fitting only; id, source and language never
enter a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import crc_remainder, documents, small_batches, written

#: Bound of the labelled rows that a model is fitted on (expected number, chosen by hash).
MOST_ROWS = 30_000
#: Words of the learned lexicon, in three tiers of a third each.
MOST_WORDS = 120
CALIBRATION_SHARE = 0.2
THRESHOLD = 0.3
NEAR = 5

#: Second-person words (fixed values).
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine euch euer ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split()

_SWAPPED = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})
_EDGES = ".,;:?!\"'()[]{}<>|*#%&$-_/\\"
_SPACED = re.compile(r"(?<!\S)(?:\w[ .\-*]){3,}\w(?!\S)")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")

FEATURES = [
    "words", "hits", "hit_share", "strong", "strong_share", "middle", "middle_share", "weak_share", "distinct_hits", "first_hit", "second_person", "near_second", "near_hits",
    "capitals", "capital_words", "punctuation", "exclamations", "questions", "symbols", "hidden_hits", "mixed_words", "stretched", "spaced",
]


def plain(word: str) -> str:
    """A word lowered, without punctuation at its edges."""
    return word.lower().strip(_EDGES)


def hidden(word: str) -> str:
    """A word with look-alike characters put back and stretched letters joined."""
    return re.sub(r"(.)\1{2,}", r"\1", word.lower().translate(_SWAPPED)).strip(_EDGES)


class Lexicon:
    def __init__(self, words: list[str]):
        self.tier = {w: 1 + 3 * i // max(len(words), 1) for i, w in enumerate(words)}
        self.tier |= {w: 8 for w in SECOND_PERSON if w not in self.tier}
        self.known: dict[str, int] = {}

    def code(self, word: str) -> int:
        """1 to 3: tier; 8: second person; 4 to 6: tier of a hidden word; 9: letters mixed with digits or symbols; 0: any other."""
        got = self.known.get(word)
        if got is None:
            low = plain(word)
            got = self.tier.get(low, 0)
            if not got and not low.isalpha():
                seen = self.tier.get(hidden(word), 0)
                inner = low.replace("'", "").replace("-", "").replace("’", "")
                got = seen + 3 if 0 < seen < 4 else 9 if any(map(str.isalpha, inner)) and not inner.isalpha() and inner else 0
            elif not got and _STRETCHED.search(low):
                seen = self.tier.get(hidden(word), 0)
                got = seen + 3 if 0 < seen < 4 else 0
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        text = text if isinstance(text, str) else ""
        words = text.split()
        n = len(words)
        codes = np.fromiter(map(self.code, words), np.int8, n)
        d = max(n, 1)
        hits = (codes > 0) & (codes < 7)
        at, second = np.flatnonzero(hits), np.flatnonzero(codes == 8)
        near = 0
        gap = 99.0
        if len(at) and len(second):
            right = np.searchsorted(second, at)
            gaps = np.minimum(np.abs(second[np.minimum(right, len(second) - 1)] - at), np.abs(second[np.maximum(right - 1, 0)] - at))
            near, gap = int((gaps <= NEAR).sum()), float(min(gaps.min(), 99))
        strong, middle, weak = (int(((codes == t) | (codes == t + 3)).sum()) for t in (1, 2, 3))
        chars = max(len(text), 1)
        raw = text.encode("utf-8", "surrogatepass")
        b = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        capitals = int(b[65:91].sum())
        upper = sum(1 for w in words if len(w) > 2 and w.isupper()) if capitals > 2 else 0
        return [
            float(n), float(len(at)), len(at) / d, float(strong), strong / d, float(middle), middle / d, weak / d, float(len({plain(words[i]) for i in at.tolist()})), float(at[0]) / d if len(at) else 1.0, len(second) / d, gap, near / d,
            capitals / chars, upper / d, int(b[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()) / chars, b[33] / chars, b[63] / chars, int(b[[35, 36, 37, 38, 42, 60, 62, 64, 124]].sum()) / chars,
            int(((codes > 3) & (codes < 7)).sum()) / d, int((codes == 9).sum()) / d, len(_STRETCHED.findall(text)) / d, len(_SPACED.findall(text)) / d,
        ]


def with_features(df: DataFrame, words: list[str]) -> DataFrame:
    """``df`` without its text and with the features; the lexicon is bounded by ``MOST_WORDS``."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.select(*kept).dtypes), "f array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(words)
        for pdf in batches:
            yield pdf[kept].assign(f=[lexicon.features(t) for t in pdf["text"]])

    out = df.select(*kept, "text").mapInPandas(run, schema)
    return out.select(*kept, *[F.col("f")[i].alias(f"f_{name}") for i, name in enumerate(FEATURES)])


def learn_lexicon(sample: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """Words that more toxic than other texts hold, by the z value of their log odds; only the best come to the driver."""
    totals = sample.agg(F.sum("toxic"), F.count("*")).first()
    n1, n = totals[0] or 0, totals[1]
    n0 = n - n1
    if not n0 or not n1:
        return []
    tokens = F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    words = sample.select("toxic", F.explode(F.array_distinct(tokens)).alias("w")).where(F.length("w") > 1)
    counts = words.groupBy("w").agg(F.sum("toxic").alias("a"), F.count("*").alias("b")).where(F.col("a") >= 3)
    a, b = F.col("a") + 0.5, F.col("b") - F.col("a") + 0.5
    odds = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + F.col("a") + 0.5))
    scored = counts.withColumn("z", odds / F.sqrt(1 / a + 1 / b)).where(F.col("z") > 3)
    return [r[0] for r in scored.orderBy(F.desc("z"), "w").limit(most).collect()]


class ToxicityModel:
    """Lexicon, trees and calibration; fit with ``fit_model``."""

    def __init__(self, words: list[str], trees, calibration, prior: float):
        self.words, self.trees, self.calibration, self.prior = words, trees, calibration, prior

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` without its text, with score in 0..1 (a column of that name is replaced).

        A null text counts as an empty one, which has a score too.  Whole texts
        are read, however long.  Equal texts have equal scores, whatever their
        other columns, which are returned as they are; an empty table gives an
        empty result.
        """
        kept = [c for c in df.columns if c not in ("text", "score")]
        if self.trees is None:
            return df.select(*kept, F.lit(self.prior).alias("score"))
        # the caller's columns travel in one, so that none clashes with those of the models
        rows = _raw_score(self.trees, with_features(df.select(F.struct(*kept).alias("own"), "text"), self.words))
        return self.calibration.transform(rows).select("own.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction_iso"))).alias("score"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="f_all").transform(df)


def _raw_score(trees, df: DataFrame) -> DataFrame:
    out = trees.transform(_assembled(df))
    return out.withColumn("raw_score", vector_to_array("probability")[1])


def fit_model(texts: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, trees: int = 25, depth: int = 3) -> ToxicityModel:
    """Fits on texts (doc_id, text) and labels (doc_id, toxic: 0 or 1; rows with null are left out).

    At most about ``most_rows`` labels are used, chosen by a hash of the id
    before texts are read, so that the chosen labels may be broadcast and texts
    are not shuffled: they are ``most_rows`` in expectation, and far more cannot
    come (the deviation is the root of that number).  An id labelled several
    times counts as toxic if one of its rows says so; texts that share an id are
    all used.  Null texts count as empty.  Without rows of both labels the model
    returns the share of label 1 (0 if there is none).
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = labels.count()
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1000)) < int(1000 * CALIBRATION_SHARE)
    chosen = labels.where(h < min(1 << 20, -(-most_rows * (1 << 20) // max(n, 1)))).withColumn("part", part)
    sample = written(texts.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "part"), "toxicity-texts")
    words = learn_lexicon(sample.where(~F.col("part")))  # rows that calibrate must not choose the words
    table = written(with_features(sample, words).withColumn("label", F.col("toxic").cast("double")).coalesce(6), "toxicity-sample")
    split = {(r[0], r[1]): r[2] for r in table.groupBy("part", "toxic").count().collect()}
    total = sum(split.values())
    if any(not split.get((part, y)) for part in (True, False) for y in (0, 1)):
        return ToxicityModel(words, None, None, sum(v for (_, y), v in split.items() if y == 1) / total if total else 0.0)
    table = _assembled(table)
    trees_model = GBTClassifier(featuresCol="f_all", labelCol="label", maxIter=trees, maxDepth=depth, minInstancesPerNode=10, stepSize=0.15, subsamplingRate=0.8, seed=7, maxBins=32).fit(table.where(~F.col("part")))
    aside = trees_model.transform(table.where("part")).withColumn("raw_score", vector_to_array("probability")[1])
    calibration = IsotonicRegression(featuresCol="raw_score", labelCol="label", predictionCol="prediction_iso").fit(aside)
    return ToxicityModel(words, trees_model, calibration, 0.0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_remainder("doc_id", 4) == 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit_model(docs, labels.where(~held_out))
    scored = model.score(docs.select("doc_id", "text", held_out.alias("held_out")))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
