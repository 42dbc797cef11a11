"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Quotas. The mix holds T rows, source s exactly round(T * w_s) of them (largest remainders), with
   the largest T for which no source is asked for more rows than it has. Without weights, the target is the
   tempered distribution w_s = n_s ** TEMPERATURE. With `epochs`, a source that is too small is repeated up to so many times, and what it
   is short of then isn't taken from the others: T is `size`, or the least at which every source is drawn whole. A turn continues the ranks of the one before, so rows are repeated only after they are ranked. `kept` reports rows and quotas.
2. Blocks. In a pseudo-random order, the rows of a source's quota are cut into blocks of `block` rows
   (the last may be shorter).
3. Tree. The vector of block quotas of a range of output shards is split between its halves by a
   multivariate hypergeometric draw whose size is the left half's share of the blocks, down to single shards: every
   shard gets a random mix, the totals are exact and no two shards share a block.
4. Each shard draws the next blocks of every source's permutation, and its rows are shuffled locally.

The tree holds numbers only (shards x sources), of which the driver keeps those of every SUBTREE shards; the
rest is drawn in tasks. The rows are shuffled twice, once for their exact ranks and once to their shard; their texts travel compressed (zstandard), from
before the first shuffle to behind the last. Everything follows from the seed and the rows, so a lost task gives the same result.

Defined results
- a null source is a source of its own, weighted under the key None; without weights like any other.
- a source without a weight, or with weight 0, is left out; a weighted source without rows is ignored.
- empty tables and no positive weight: no row. Repeated rows count as often as they occur; rows
  equal in all columns are alike, so it doesn't matter which one is drawn.
- null ids, null and empty texts and very long ones are drawn like others, whole; a shard has rows_per_shard rows, however long they are.
- ties of the order (equal hashes) go by id, text and the other plain columns.
- all columns are kept; an input column that is called like an output
  column (shard, position) is replaced. The columns travel as one struct, so no helper name clashes with them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, table
from .ranks import group_key, ranked

TEMPERATURE = 0.7
ROWS_PER_SHARD = 8192
BLOCK = 64
SEED = 17
#: Shards of a subtree that is drawn in one task.
SUBTREE = 1024
#: Times that op1_mixing repeats a source that is too small for its share.
EPOCHS = 4


def quotas(rows: dict, weights: dict | None = None, temperature: float = TEMPERATURE, size: int | None = None, epochs: int | None = None) -> dict:
    """Rows to draw from each source: the largest mix in the target proportions without repeats.

    With size or epochs (1 if only size is given): size rows, or as many as draw every source whole, of which no source gives more than
    epochs times its rows; the others don't make up for that.
    """
    order = sorted((s for s in rows if rows[s] > 0), key=lambda s: (s is None, str(s)))
    w = {s: float(rows[s]) ** temperature if weights is None else float(weights.get(s) or 0) for s in order}
    order = [s for s in order if w[s] > 0]
    if not order:
        return {}
    total = sum(w[s] for s in order)
    if size is not None or epochs is not None:
        most = {s: rows[s] * (1 if epochs is None else epochs) for s in order}
        if size is None:
            scale = max(rows[s] / w[s] for s in order)
            return {s: min(max(rows[s], round(w[s] * scale)), most[s]) for s in order}
        exact = {s: size * w[s] / total for s in order}
        out = {s: int(exact[s]) for s in order}
        for s in sorted(order, key=lambda s: (out[s] - exact[s], order.index(s)))[: size - sum(out.values())]:
            out[s] += 1
        return {s: min(out[s], most[s]) for s in order}
    size = int(min(rows[s] * total / w[s] for s in order) * (1 + 1e-12))
    while True:
        exact = {s: size * w[s] / total for s in order}
        out = {s: int(exact[s]) for s in order}
        for s in sorted(order, key=lambda s: (out[s] - exact[s], order.index(s)))[: size - sum(out.values())]:
            out[s] += 1
        if all(out[s] <= rows[s] for s in order):
            return out
        size -= 1


def _halves(a: int, b: int, have: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """Where the range of shards a to b is cut, and the blocks of its left half."""
    mid = (a + b) // 2
    left = int(have.sum()) * (mid - a) // (b - a)
    return mid, np.random.default_rng([seed, a, b]).multivariate_hypergeometric(have, left, method="marginals")


def split(blocks: np.ndarray, shards: int, seed: int = SEED, first: int = 0) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources); the columns add up to `blocks`. first: the number of the first shard."""
    out = np.zeros((shards, len(blocks)), dtype=np.int64)
    stack = [(first, first + shards, np.asarray(blocks, dtype=np.int64))]
    while stack:
        a, b, have = stack.pop()
        if b - a == 1:
            out[a - first] = have
            continue
        mid, part = _halves(a, b, have, seed)
        stack += [(a, mid, part), (mid, b, have - part)]
    return out


def subtrees(blocks: np.ndarray, shards: int, seed: int = SEED, most: int = SUBTREE) -> list[tuple[int, int, list[int], list[int]]]:
    """(first shard, number of shards, blocks, blocks before them) of the nodes of the tree with at most `most` shards, in order."""
    out, stack = [], [(0, shards, np.asarray(blocks, dtype=np.int64))]
    while stack:
        a, b, have = stack.pop()
        if b - a <= most:
            out.append((a, b - a, have))
            continue
        mid, part = _halves(a, b, have, seed)
        stack += [(mid, b, have - part), (a, mid, part)]
    before = np.cumsum([np.zeros(len(blocks), dtype=np.int64), *[h for *_, h in out]], axis=0)
    return [(a, n, h.tolist(), before[i].tolist()) for i, (a, n, h) in enumerate(out)]


def block_spans(spark: SparkSession, blocks: np.ndarray, shards: int, order: list[str], seed: int = SEED) -> DataFrame:
    """(__s, __shard, __from, __to): the blocks of each source's permutation that each shard takes. The tree's top is drawn here, its subtrees in tasks."""

    def draw(it):
        for pdf in it:
            for a, n, have, before in pdf.itertuples(index=False):
                plan = split(np.array(have, dtype=np.int64), n, seed, a)
                ends = plan.cumsum(axis=0) + np.array(before, dtype=np.int64)
                k, j = np.nonzero(plan)
                yield pd.DataFrame({"__s": np.array(order, dtype=object)[j], "__shard": (k + a).astype(np.int32), "__from": ends[k, j] - plan[k, j], "__to": ends[k, j]})

    top = subtrees(blocks, shards, seed) if order else []
    return spark.createDataFrame(top, "a int, n int, have array<long>, before array<long>").mapInPandas(draw, "__s string, __shard int, __from long, __to long")


@F.pandas_udf(T.BinaryType())
def _packed(texts: pd.Series) -> pd.Series:
    z = zstandard.ZstdCompressor(level=1)
    return texts.map(lambda t: z.compress(t.encode("utf-8", "surrogatepass")), na_action="ignore")


@F.pandas_udf(T.StringType())
def _unpacked(data: pd.Series) -> pd.Series:
    z = zstandard.ZstdDecompressor()
    return data.map(lambda b: z.decompress(b).decode("utf-8", "surrogatepass"), na_action="ignore")


def _drawn(rows: DataFrame, weights: dict | None, temperature: float, size: int | None, epochs: int | None) -> tuple[dict, dict]:
    """Rows and quotas by the source's key (column __s of rows)."""
    held = {r[0]: r[1] for r in rows.groupBy("__s").count().collect()}  # a row for each source
    if weights is not None:
        weights = {"" if k is None else f"={k}": w for k, w in weights.items()}
    return held, quotas(held, weights, temperature, size, epochs)


def kept(docs: DataFrame, weights: dict | None = None, source: str = "source", temperature: float = TEMPERATURE, size: int | None = None, epochs: int | None = None) -> DataFrame:
    """(source, rows, drawn) of what mix draws with these parameters; drawn > rows: repeats."""
    held, draw = _drawn(docs.select(group_key(col(source)).alias("__s")), weights, temperature, size, epochs)
    return docs.sparkSession.createDataFrame([(s[1:] if s else None, n, draw.get(s, 0)) for s, n in sorted(held.items())], "source string, rows long, drawn long")


def mix(docs: DataFrame, weights: dict | None = None, source: str = "source", doc_id: str = "doc_id", text: str = "text", rows_per_shard: int = ROWS_PER_SHARD, block: int = BLOCK, seed: int = SEED, temperature: float = TEMPERATURE, size: int | None = None, epochs: int | None = None) -> DataFrame:
    """The drawn rows of docs with their columns, `shard` and `position` (from 0, in the shard's shuffled order). weights: by the source as a string, or None; size, epochs: see quotas."""
    spark, columns = docs.sparkSession, [c for c in docs.columns if c.lower() not in ("shard", "position")]
    small = text in columns and isinstance(docs.schema[text].dataType, T.StringType)
    sent = [_packed(col(c)).alias(c) if small and c == text else col(c) for c in columns]
    rows = docs.select(F.struct(*sent).alias("__row"), group_key(col(source)).alias("__s"), F.xxhash64(F.lit(seed), col(doc_id), col(text)).alias("__h"))
    held, draw = _drawn(rows, weights, temperature, size, epochs)
    order = list(draw)
    shards = max(1, -(-sum(draw.values()) // rows_per_shard))
    spans = block_spans(spark, np.array([-(-draw[s] // block) for s in order], dtype=np.int64), shards, order, seed)
    taken = spans.select("__s", "__shard", F.explode(F.sequence("__from", F.col("__to") - 1)).alias("__block"))
    limit = spark.createDataFrame([(s, draw[s], held[s], max(1, -(-draw[s] // held[s]))) for s in order], "__s string, __quota long, __held long, __turns int")

    def shards_of(spans: DataFrame) -> DataFrame:
        """To each span of ranks, the shards of its blocks from its first one on: blocks that no shard takes come last."""
        spans = spans.join(limit, "__s").withColumn("__turn", F.explode(F.sequence(F.lit(0), F.col("__turns") - 1)))
        spans = spans.withColumn("__before", F.col("__before") + F.col("__turn") * F.col("__held")).drop("__held", "__turns")
        first, last = F.floor(F.col("__before") / block), F.floor((F.col("__before") + F.col("__n") - 1) / block)
        key = ["__s", "__range", "__turn"]
        each = spans.select(*key, F.explode(F.sequence(first, last)).alias("__block")).join(taken, ["__s", "__block"])
        each = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__block", "__shard"))).alias("x"))
        each = each.select(*key, F.transform("x", lambda x: x["__shard"]).alias("__shards"))
        return spans.withColumn("__first", F.col("__before")).join(each, key)

    plain = [c for c in columns if isinstance(docs.schema[c].dataType, T.AtomicType)]
    ties = [F.col("__row")[c] for c in sorted(plain, key=lambda c: (c != doc_id, c == text))]
    out = ranked(rows, "__s", "__h", ties, sum(held.values()), shards_of).filter(F.col("__rank") < F.col("__quota"))
    at = F.floor(F.col("__rank") / block) - F.floor((F.col("__first")) / block)
    out = out.withColumn("shard", F.get("__shards", at.cast("int")))
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "__rank", "__s"), "__s", "__rank")
    back = [(_unpacked(F.col("__row")[c]) if small and c == text else F.col("__row")[c]).alias(c) for c in columns]
    return out.withColumn("position", (F.row_number().over(local) - 1).cast("long")).select(*back, "shard", "position")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), epochs=EPOCHS)


QUERIES = {"op1_mixing": op1_mixing}
ORACLES: dict[str, str] = {}
