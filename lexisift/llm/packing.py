"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most CAPACITY length units (white-space words, or any length column):
a longer document is cut into full sequences and one remainder. Pieces of one length are alike, so the
packing is solved on the counts of the lengths, at most CAPACITY numbers whatever the corpus holds:

1. From the longest length down, a length that is still available opens bins. Their gap is looked up in the index
   of sums: a single length, a pair, then a triple that fills it exactly, as long as the lengths are available;
   as many bins as the counts allow are closed at once with each combination.
2. The residuals, for which no exact filling is left, are placed by best fit in order of falling length,
   again as many equal bins at once as the counts allow.

Then every piece finds its bin from its exact rank among the pieces of its length. Only (id, length)
is shuffled.

Defined results
- null and empty texts, or lengths null or below 1, make no piece.
- repeated rows are separate pieces; ids may repeat or be null.
- empty table: no bin. Ties between fillings: the one with the longest first part; ties between bins: the bin opened first.
- extra columns are ignored. The text isn't needed once its length is known; a document of any length is cut.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, table
from .ranks import ranked

CAPACITY = 2048


def words(text: Column) -> Column:
    """Number of white-space words."""
    return F.regexp_count(text, F.lit(r"[^ \t\r\n\f]+"))


class SumIndex:
    """Single lengths, pairs and triples of available lengths by their sum.

    Singles and pairs are looked up in the availability vector. Triples go through the index of pair sums,
    which is built again after some misses only: availability falls, so a stale index holds too much, never too little.
    """

    def __init__(self, left: np.ndarray):
        self.left = left
        self.refresh()

    def refresh(self) -> None:
        live = self.left > 0
        self.pairs = np.zeros(2 * len(live), dtype=bool)
        lengths = np.flatnonzero(live)
        for a in lengths:
            self.pairs[a + lengths] = True

    def pair(self, total: int, top: int) -> tuple[int, int] | None:
        """(a, b) with a + b = total, top >= a >= b and a as long as possible."""
        a = np.arange(min(top, total - 1), (total - 1) // 2, -1)
        if not len(a):
            return None
        ok = (self.left[a] > 0) & (self.left[total - a] > np.where(2 * a == total, 1, 0))
        at = int(ok.argmax())
        return (int(a[at]), total - int(a[at])) if ok[at] else None

    def find(self, gap: int, top: int) -> tuple[int, ...] | None:
        """A filling of `gap` with lengths up to `top`, of one, two or three parts, the first as long as possible."""
        if gap <= top and self.left[gap]:
            return (gap,)
        if found := self.pair(gap, top):
            return found
        a = np.arange(min(top, gap - 2), (gap + 2) // 3 - 1, -1)
        misses = 0
        for x in a[(self.left[a] > 0) & self.pairs[gap - a]] if len(a) else ():
            x = int(x)
            self.left[x] -= 1
            found = self.pair(gap - x, x)
            self.left[x] += 1
            if found:
                return (x, *found)
            misses += 1
        if misses > 8:
            self.refresh()
        return None


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, number of such bins)]; lengths count down within a bin as they were placed."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for x, n in counts.items():
        left[x] = n
    index, out, rest = SumIndex(left), [], {}
    for x in map(int, np.flatnonzero(left)[::-1]):
        while left[x]:
            if x == capacity:
                out.append(((x,), int(left[x])))
                left[x] = 0
                break
            left[x] -= 1
            found = index.find(capacity - x, x)
            left[x] += 1
            if not found:
                rest[x] = int(left[x])
                left[x] = 0
                break
            need = defaultdict(int)
            for y in (x, *found):
                need[y] += 1
            n = min(int(left[y]) // k for y, k in need.items())
            for y, k in need.items():
                left[y] -= n * k
            out.append(((x, *found), n))
    return out + best_fit(rest, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in order of falling length, equal bins together."""
    open_: dict[int, list] = defaultdict(list)  # gap -> [(lengths, number)], in order of opening
    for x in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        n = counts[x]
        while n:
            gap = min((g for g, held in open_.items() if g >= x and held), default=None)
            if gap is None:
                # a new bin takes as many of them as fit, as best fit would do one by one
                k = capacity // x
                full, over = divmod(n, k)
                if full:
                    open_[capacity - k * x].append(((x,) * k, full))
                if over:
                    open_[capacity - over * x].append(((x,) * over, 1))
                n = 0
                continue
            lengths, m = open_[gap].pop(0)
            take = min(m, n)
            if m > take:
                open_[gap].insert(0, (lengths, m - take))
            open_[gap - x].append(((*lengths, x), take))
            n -= take
    return [b for gap in sorted(open_) for b in open_[gap]]


def slots(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number of ranks, first bin, pieces of this length in a bin) for each pattern and length."""
    out, used, base = [], defaultdict(int), 0
    for lengths, n in plan:
        for x in dict.fromkeys(lengths):
            k = lengths.count(x)
            out.append((x, used[x], n * k, base, k))
            used[x] += n * k
        base += n
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", length: Column | None = None, text: str = "text") -> DataFrame:
    """(__id, __start, __len): each document's pieces."""
    n = (words(col(text)) if length is None else length).cast("long")
    out = docs.select(col(doc_id).alias("__id"), n.alias("__all")).filter("__all > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("__all") - 1, F.lit(capacity).cast("long"))
    out = out.select("__id", "__all", F.explode(starts).alias("__start"))
    return out.select("__id", "__start", F.least(F.lit(capacity), F.col("__all") - F.col("__start")).cast("int").alias("__len"))


def pack(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", length: Column | None = None, text: str = "text") -> DataFrame:
    """A row for each bin: (bin_id, doc_ids, starts, lengths, used), the pieces in order of falling length."""
    spark = docs.sparkSession
    items = cut(pieces(docs, capacity, doc_id, length, text).withColumn("__h", F.xxhash64("__id", "__start", "__len")))
    counts = {r[0]: r[1] for r in items.groupBy("__len").count().collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(slots(solve(counts, capacity)), "__l int, __a long, __m long, __bin long, __k int")

    def bins_of(spans: DataFrame) -> DataFrame:
        """To each span of ranks of a length, the slots that it overlaps."""
        hit = (F.col("__len") == F.col("__l")) & (F.col("__a") < F.col("__before") + F.col("__n")) & (F.col("__a") + F.col("__m") > F.col("__before"))
        return spans.join(plan, hit).groupBy("__len", "__range", "__n", "__before").agg(F.sort_array(F.collect_list(F.struct("__a", "__m", "__bin", "__k"))).alias("__slots"))

    placed = ranked(items, "__len", "__h", [F.col("__id"), F.col("__start")], sum(counts.values()), bins_of)
    rank = F.col("__rank")
    slot = F.filter("__slots", lambda s: (s["__a"] <= rank) & (rank < s["__a"] + s["__m"]))[0]
    placed = placed.withColumn("__s", slot).select("__id", "__start", "__len", (F.col("__s.__bin") + F.floor((rank - F.col("__s.__a")) / F.col("__s.__k"))).alias("bin_id"))
    held = F.array_sort(F.collect_list(F.struct((-F.col("__len")).alias("o"), F.col("__id").alias("i"), F.col("__start").alias("s"), F.col("__len").alias("n"))))
    out = placed.groupBy("bin_id").agg(held.alias("x"))
    part = lambda f: F.transform("x", lambda x: x[f])
    return out.select("bin_id", part("i").alias("doc_ids"), part("s").alias("starts"), part("n").alias("lengths"), F.aggregate("x", F.lit(0), lambda a, x: a + x["n"]).alias("used"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
