"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of the labelled rows (``max_train_rows``, the only
bound) as a distributed aggregate of at most ``languages x buckets`` rows. The smoothed
log-probability matrix is broadcast. Scoring runs over the whole text of every document: a batch
is one sparse matrix in CSR form (indices = n-gram buckets, row pointers = document bounds, all
data 1), multiplied with the matrix by gathering and segment sums in numpy.

The posterior only compares the known languages. Whether a text is in one of them at all is told by its mean
log-likelihood an n-gram under the best language: it must reach that language's bound, which is calibrated on the training
rows, each scored without its own counts. Few n-grams scatter more, so the mean gets a bonus of SPREAD / sqrt(n-grams).

Defined results
- null, empty or n-gram-free text: language ``und``, confidence 0, rejected.
- a text below the bound of its best language (another language, symbols, digits): language ``und``, confidence 0, rejected.
- a language label that is null is not used for training; no labelled row at all: everything is
  ``und`` with confidence 0 and nothing is rejected but null and empty texts (no model, no verdict).
- ties between languages: the alphabetically first.
- repeated rows: scored alike, each on its own. Very long texts are scored whole, in slices.
- extra columns are kept by ``filter_language`` and ignored by ``identify``; helper names never
  clash with them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, spare, table

ORDERS = (2, 3)
BITS = 15
SLICE = 1 << 19
#: The bound of a language: this quantile of its training rows, less MARGIN (log-likelihood an n-gram).
QUANTILE, MARGIN, SPREAD = 0.001, 0.25, 6.0
RESULT = "lang string, confidence double, n_grams long"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def grams(text: str, bits: int = BITS) -> list[np.ndarray]:
    """Buckets of all n-grams of one text, an array for each order; orders have separate ranges."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return [_buckets(points, n, k, bits) for k, n in enumerate(ORDERS)]


def _buckets(points: np.ndarray, n: int, k: int, bits: int) -> np.ndarray:
    m = len(points) - n + 1
    if m <= 0:
        return np.empty(0, dtype=np.int32)
    h = points[:m] * _MULTIPLIERS[0]
    for j in range(1, n):
        h ^= h >> np.uint32(15)
        h += points[j : j + m]
        h *= _MULTIPLIERS[j]
    h ^= h >> np.uint32(13)
    return (h & np.uint32((1 << bits) - 1)).astype(np.int32) + np.int32(k << bits)


def batches(texts: list[str | None], size: int = SLICE):
    """Lists of (document, slice of its lower-case text) of about `size` characters; slices overlap by the longest n-gram less one."""
    part, held = [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        t, lap = t.lower(), max(ORDERS) - 1
        for a in range(0, len(t), size):
            s = t[a : a + size + lap]
            part.append((i, s))
            held += len(s)
            if held >= size:
                yield part
                part, held = [], 0
    if part:
        yield part


def score(texts: list[str | None], logp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (documents x languages) and n-gram counts of whole texts. logp: languages x buckets, float32."""
    total = np.zeros((len(texts), logp.shape[0]))
    count = np.zeros(len(texts), dtype=np.int64)
    for part in batches(texts):
        points = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for _, s in part]
        rows = np.array([i for i, _ in part])
        for k, n in enumerate(ORDERS):
            # n-grams that begin in the slice; those that begin in the overlap are the next slice's
            index = [_buckets(p[: SLICE + n - 1], n, k, bits) for p in points]
            size = np.array([len(x) for x in index])
            live = size > 0
            if not live.any():
                continue
            indices = np.concatenate([x for x in index if len(x)])
            start = np.concatenate([[0], np.cumsum(size[live])[:-1]])
            np.add.at(count, rows[live], size[live])
            for j in range(logp.shape[0]):
                np.add.at(total[:, j], rows[live], np.add.reduceat(logp[j][indices], start, dtype=np.float64))
    return total, count


def sample(docs: DataFrame, text: str, lang: str, max_train_rows: int) -> DataFrame:
    """(text, lang) of at most about max_train_rows labelled rows, drawn by a hash of the text."""
    rows = docs.select(col(text).alias("text"), col(lang).alias("lang")).filter("lang is not null and text is not null and text <> ''")
    n = docs.filter(col(lang).isNotNull()).count()
    if n > max_train_rows:
        parts = 1_000_000
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) < int(parts * max_train_rows / n))
    return rows


def counted(rows: DataFrame, bits: int) -> tuple[list[str], np.ndarray]:
    """Languages and how often each bucket occurs in their rows."""

    def counts(it):
        for pdf in it:
            for name, part in pdf.groupby("lang"):
                total = np.zeros(len(ORDERS) << bits, dtype=np.int64)
                for t in part["text"]:
                    for b in grams(t, bits):
                        total += np.bincount(b, minlength=len(total))
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": name, "bucket": at, "n": total[at]})

    seen = rows.mapInPandas(counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(seen["lang"].unique())
    table_ = np.zeros((len(names), len(ORDERS) << bits))
    for j, name in enumerate(names):
        own = seen[seen["lang"] == name]
        table_[j, own["bucket"].to_numpy()] = own["n"].to_numpy()
    return names, table_


def log_probabilities(table_: np.ndarray, alpha: float, bits: int) -> np.ndarray:
    out = np.empty(table_.shape, dtype=np.float32)
    for k in range(len(ORDERS)):  # each order is a distribution of its own
        part = table_[:, k << bits : (k + 1) << bits] + alpha
        out[:, k << bits : (k + 1) << bits] = np.log(part / part.sum(axis=1, keepdims=True))
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_train_rows: int = 20_000, alpha: float = 0.5, bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probability matrix from at most about max_train_rows labelled rows."""
    names, table_ = counted(sample(docs, text, lang, max_train_rows), bits)
    return names, log_probabilities(table_, alpha, bits)


def familiarity(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Mean log-likelihood an n-gram with the bonus of short texts."""
    n = np.maximum(count, 1)
    return total / n + SPREAD / np.sqrt(n)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", max_train_rows: int = 20_000, alpha: float = 0.5, bits: int = BITS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix and the least familiarity of a text in each."""
    rows = sample(docs, text, lang, max_train_rows)
    names, table_ = counted(rows, bits)
    logp = log_probabilities(table_, alpha, bits)
    if not names:
        return names, logp, np.zeros(0)
    model = docs.sparkSession.sparkContext.broadcast((names, table_, logp))

    def left_out(it):
        names, table_, logp = model.value
        at = {n: j for j, n in enumerate(names)}
        sums = [table_[:, k << bits : (k + 1) << bits].sum(axis=1) for k in range(len(ORDERS))]
        for pdf in it:
            langs, values = [], []
            for t, name in zip(pdf["text"], pdf["lang"]):
                total, n, j, said = 0.0, 0, at.get(name), np.zeros(len(names))
                for k, b in enumerate(grams(t, bits)):
                    bucket, own = np.unique(b, return_counts=True)
                    said += logp[:, bucket] @ own
                    total += (own * np.log((table_[j, bucket] - own + alpha) / (sums[k][j] - len(b) + alpha * (1 << bits)))).sum()
                    n += len(b)
                if n and said.argmax() == j:  # rows that look mislabelled don't count
                    langs.append(name)
                    values.append(float(familiarity(np.array(total), np.array(n))))
            yield pd.DataFrame({"lang": langs, "v": values})

    least = dict(rows.mapInPandas(left_out, "lang string, v double").groupBy("lang").agg(F.percentile_approx("v", QUANTILE, 100_000)).collect())
    return names, logp, np.array([least.get(n, -np.inf) - MARGIN for n in names])


def decide(total: np.ndarray, count: np.ndarray, names: list[str], bounds: np.ndarray | None = None) -> pd.DataFrame:
    """Posterior under equal priors; the orders overlap, so the likelihood is tempered by their number. Texts below the bound of their best language are in none."""
    if not names:
        return pd.DataFrame({"lang": ["und"] * len(count), "confidence": np.zeros(len(count)), "n_grams": count})
    z = total / len(ORDERS)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    best = z.argmax(axis=1)
    none = count == 0
    if bounds is not None:
        none |= familiarity(total[np.arange(len(best)), best], count) < bounds[best]
    return pd.DataFrame({"lang": np.where(none, "und", np.array(names, dtype=object)[best]), "confidence": np.where(none, 0.0, z.max(axis=1)), "n_grams": count})


def scorer(spark: SparkSession, names: list[str], logp: np.ndarray, bits: int = BITS, bounds: np.ndarray | None = None):
    model = spark.sparkContext.broadcast((names, logp, bounds))

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, logp, bounds = model.value
        items = texts.where(texts.notna(), None).tolist()
        return decide(*score(items, logp, bits), names, bounds)

    return predict


def accepted(result, names: list[str], least: float):
    """Not rejected: some n-grams and a posterior of at least `least`; without a model, some n-grams."""
    return (result["n_grams"] > 0) & ((result["confidence"] >= least) if names else F.lit(True))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5, **how) -> DataFrame:
    """(doc_id, lang, confidence, n_grams, accepted) for every row of docs."""
    names, logp, bounds = fit(docs, text, lang, **how)
    predict = scorer(docs.sparkSession, names, logp, how.get("bits", BITS), bounds)
    out = docs.select(col(doc_id).alias("doc_id"), predict(col(text)).alias("r"))
    return out.select("doc_id", "r.lang", F.round("r.confidence", 6).alias("confidence"), "r.n_grams", accepted(F.col("r"), names, least).alias("accepted"))


def filter_language(docs: DataFrame, text: str = "text", lang: str = "lang", least: float = 0.5, **how) -> DataFrame:
    """The rows of docs that aren't rejected, with their columns as they were."""
    names, logp, bounds = fit(docs, text, lang, **how)
    predict = scorer(docs.sparkSession, names, logp, how.get("bits", BITS), bounds)
    (tmp,) = spare(docs, "language")
    return docs.withColumn(tmp, predict(col(text))).filter(accepted(F.col(tmp), names, least)).drop(tmp)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}
