"""Quality rules: an isolation forest on rule statistics.

The rule statistics of every document are JVM expressions over its whole text, none of them cut off (the mean length of a word is taken as its logarithm).
Trees isolate rows by random splits of random features; a row's anomaly score is 2 ** (-mean path length / c(sample)), near 1 for rows that few
splits isolate. The trees are grown on good labelled rows, SUBSAMPLE of them each; splits fall anywhere in the range
that a feature has in good and bad labelled rows, so that rows where good ones are missing end early. At most
about `max_train_rows` labelled rows are used (the only bound; drawn by a hash of the id). The threshold is calibrated on all labelled rows: the score that keeps the share
`keep_good` of the good ones, from the exact distribution of scores. Documents above it are rejected.

Defined results
- null and empty texts have statistics 0 and are scored like other rows; texts without a word are rejected when there is a model.
- no good labelled row at all: no model, every score is 0 and everything is kept.
- repeated rows: alike, each on its own. Repeated labels of one id: the worst counts. Null ids take no label. Empty tables give no row.
- extra columns are ignored by `scores`. Very long texts are measured whole; ties at the threshold are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, table

TREES, SUBSAMPLE, DEPTH = 128, 256, 16
BINS = 10_000
FEATURES = ["symbol_share", "upper_share", "digit_share", "mark_share", "bar_share", "word_length", "word_repeats", "space_share", "line_repeats"]


def statistics(text: Column) -> list[Column]:
    """The rule statistics, in the order of FEATURES, from a column of words (`__w`), of lines (`__l`) and a text."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    words, lines = F.greatest(F.size("__w"), F.lit(1)), F.greatest(F.size("__l"), F.lit(1))
    return [
        share(r"[#$%&*@^~<>{}=+\\_]"),
        share(r"\p{Lu}"),
        share(r"[0-9]"),
        share(r"[!?]"),
        share(r"[|\[\]/•]"),
        F.log1p(F.length(F.regexp_replace(text, r"\s+", "")) / words),
        # distinct words grow as the square root of a text's length: what is missing of three times that
        F.greatest(1 - F.size(F.array_distinct("__w")) / F.least(words, 3 * F.sqrt(words)), F.lit(0.0)),
        F.size("__w") / n,
        1 - F.size(F.array_distinct("__l")) / lines,
    ]


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, f: array of the statistics) for every row."""
    t = F.coalesce(col(text), F.lit(""))
    a = docs.select(col(doc_id).alias("doc_id"), t.alias("__t"))
    a = a.select("doc_id", "__t", F.filter(F.split(F.lower("__t"), r"\s+"), lambda w: w != "").alias("__w"), F.split("__t", "\n").alias("__l"))
    return a.select("doc_id", F.size("__w").alias("n_words"), F.array(*[x.cast("double") for x in statistics(F.col("__t"))]).alias("f"))


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class Forest:
    """Arrays of nodes: feature (-1: leaf), split value, left child (right is the next), path length of a leaf."""

    def __init__(self, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, depth: int = DEPTH, seed: int = 5):
        """x: the rows to grow the trees on; low, high: the range of each feature in which splits fall."""
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.roots, self.feature, self.value, self.left, self.path = [], [], [], [], []
        for _ in range(trees):
            self.roots.append(self._node())
            self._grow(self.roots[-1], x[rng.choice(len(x), self.size, replace=False)], low, high, 0, depth, rng)
        self.feature, self.value, self.left, self.path = (np.array(v) for v in (self.feature, self.value, self.left, self.path))

    def _node(self) -> int:
        self.feature.append(-1), self.value.append(0.0), self.left.append(0), self.path.append(0.0)
        return len(self.feature) - 1

    def _grow(self, node: int, x: np.ndarray, low: np.ndarray, high: np.ndarray, at: int, depth: int, rng) -> None:
        live = np.flatnonzero(high > low)
        if at >= depth or len(x) < 2 or not len(live):
            self.path[node] = at + average_path(len(x))
            return
        f = int(rng.choice(live))
        v = rng.uniform(low[f], high[f])
        left = x[:, f] < v
        a, b = self._node(), self._node()
        self.feature[node], self.value[node], self.left[node] = f, v, a
        edge = np.arange(len(low)) == f
        self._grow(a, x[left], low, np.where(edge, v, high), at + 1, depth, rng)
        self._grow(b, x[~left], np.where(edge, v, low), high, at + 1, depth, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            while True:
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = self.left[node] + (x[rows, np.maximum(f, 0)] >= self.value[node])
                node = np.where(inner, go, node)
            total += self.path[node]
        return 2.0 ** (-total / len(self.roots) / max(average_path(self.size), 1e-9))


def fit(labelled: DataFrame, max_train_rows: int = 20_000, seed: int = 5) -> Forest | None:
    """A forest on the good rows of at most about max_train_rows labelled rows of (doc_id, n_words, f, quality)."""
    known = labelled.filter("quality is not null and n_words > 0")
    n = known.count()
    if not n:
        return None
    share = min(1.0, max_train_rows / n)
    rows = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1).select("doc_id", "quality", "f").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    x, good = np.array(rows["f"].tolist()), (rows["quality"] == 1).to_numpy()
    return Forest(x[good], x.min(axis=0), x.max(axis=0), seed=seed) if good.any() else None


def scored(rows: DataFrame, forest: Forest | None) -> DataFrame:
    if forest is None:
        return rows.withColumn("score", F.lit(0.0))
    model = rows.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        return pd.Series(np.round(model.value.score(np.array(f.tolist()).reshape(len(f), len(FEATURES))), 6))

    return rows.withColumn("score", score("f"))


def threshold(rows: DataFrame, keep_good: float) -> float:
    """The least score, on a grid of 1 / BINS, at or below which the share keep_good of the good labelled rows lies."""
    held = rows.filter("quality = 1").groupBy(F.ceil(F.col("score") * BINS).alias("b")).count().orderBy("b").collect()  # at most BINS rows
    need, seen = keep_good * sum(r["count"] for r in held), 0
    for r in held:
        seen += r["count"]
        if seen >= need:
            return r["b"] / BINS
    return math.inf


def scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_good: float = 0.998, max_train_rows: int = 20_000) -> DataFrame:
    """(doc_id, n_words, score, kept) for every row of docs."""
    marks = labels.select(col("doc_id").alias("doc_id"), col("quality").alias("quality")).filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = cut(features(docs, doc_id, text).join(marks, "doc_id", "left"))
    forest = fit(rows, max_train_rows)
    out = scored(rows, forest)
    limit = threshold(out, keep_good) if forest else math.inf
    kept = (F.col("score") <= limit) & ((F.col("n_words") > 0) if forest else F.lit(True))
    return out.select("doc_id", "n_words", "score", kept.alias("kept"))


def op5_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).filter("kept").drop("kept")


QUERIES = {"op5_quality_forest": op5_quality_forest}
ORACLES: dict[str, str] = {}
