"""N-gram Jaccard self-join with Bayesian candidate pruning: classes of near duplicates and the number of links of each document.

1. Sketch. Each document's set of word 3-grams gives HASHES MinHash values of 16 bits. Documents with the same words
   are one text from here on (their sets are equal), however many they are; they are told apart again in the result.
2. Candidates. Four values at a time are a band; texts that share a band of the 32 are candidates (recall
   at the threshold 0.6 is 98.8 %, at 0.7 above 99.9 %). A group of more than MEMBERS texts is cut into blocks by a hash, and
   each pair of blocks is a unit of its own. Units with the same members in several bands are one.
3. Pruning. In a unit, the values of a pair are compared 32 at a time. After n values of which m agree, the posterior of
   the similarity under a uniform prior is Beta(m + 1, n - m + 1); the pair is dropped when the probability that it
   reaches the threshold is below TOLERANCE. A pair is looked at in the first band that it shares, so in one unit.
4. Verification. The texts with a pair that is left get the hashes of all their n-grams, and the unit is run again with
   exact Jaccard similarities. Units are cut by the number of n-grams here, so that none holds much more than GRAMS, or two texts.
5. A unit gives one row for each text with a link: its number of links and a member that it is connected to. The classes are
   the components of these connections (least labels with pointer jumping).

No pair leaves its unit, so all that is shuffled is in proportion to texts and units. No partner or candidate is left out.

Defined results
- null and empty texts, or ones of white space, have no n-gram and no partner: a class of their own, 0 links. Texts of fewer than 3 words
  have one n-gram: all words. Texts of any length are taken whole.
- null ids: no row in `links` (there is no id to report); `keep_one` keeps them. A repeated row (same id and words) counts once; rows with one id and
  other words are documents of their own, each with its row.
- ties: a class is named by its least id. Empty tables give no row. Extra columns are ignored (`links`) or kept (`keep_one`).
- texts are told apart by a 64-bit hash of their words, n-grams by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, spare, table
from .shingles import grams

THRESHOLD, TOLERANCE = 0.6, 0.002
HASHES, ROWS, STEP = 128, 4, 32
BANDS = HASHES // ROWS
#: Texts of a block of candidates; n-grams of a block that is verified.
MEMBERS, GRAMS = 2048, 1 << 20
CHUNK = 1 << 18
_RNG = np.random.default_rng(11)
_A = _RNG.integers(1 << 31, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values as uint16 (texts x HASHES) of n-gram hashes; only texts with an n-gram mean something."""
    live = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, HASHES), dtype=np.uint16)
    if len(live):
        x, starts = (values >> np.uint64(32)).astype(np.uint32), bounds[live]
        for k in range(HASHES):
            h = (x ^ _B[k]) * _A[k]
            low = np.minimum.reduceat(h, starts)
            out[live, k] = ((low ^ (low >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.uint16)
    return out


def _chunks(texts: list[str | None]):
    """Index lists of about CHUNK characters."""
    part, held = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        held += len(t or "")
        if held >= CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def sketch(docs: DataFrame, doc_id: str, text: str, own: bool = False) -> DataFrame:
    """(id, k, n, sig) of documents with an id: hash of the words, n-grams with repeats, BANDS longs of four values each; k and sig are null without a word. own: and u, the hash of the text."""

    def run(it):
        for data in it:
            ids, texts = data.column(0), data.column(1).to_pylist()
            for part in _chunks(texts):
                values, bounds, k, n = grams([texts[i] or "" for i in part])
                bands = signatures(values, bounds).view(np.int64)
                none, rows = n == 0, pa.array(part)
                at = np.arange(0, (len(part) + 1) * BANDS, BANDS, dtype=np.int32)
                sig = pa.ListArray.from_arrays(pa.array(at, mask=np.append(none, False)), pa.array(bands.ravel()))
                more = [data.column(2).take(rows)] if own else []
                yield pa.record_batch([ids.take(rows), pa.array(k.view(np.int64), mask=none), pa.array(np.diff(bounds).astype(np.int64)), sig, *more], names=["id", "k", "n", "sig", *["u"][: len(more)]])

    more = [F.xxhash64(col(text)).alias("u")] if own else []
    rows = docs.select(col(doc_id).alias("id"), col(text).alias("text"), *more).filter("id is not null")
    return rows.mapInArrow(run, f"id {docs.schema[doc_id].dataType.simpleString()}, k long, n long, sig array<long>" + ", u long" * own)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """Fewest of the first STEP, 2 STEP... values that must agree: P(similarity >= threshold | m of n) = P(Bin(n + 1, threshold) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:
            m += 1
            p += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, need: list[int]) -> np.ndarray:
    """Which of the pairs (a[i], b[i]) of rows of sig (uint16) survive."""
    keep = np.arange(len(a))
    hits = np.zeros(len(a), dtype=np.int32)
    for s, m in enumerate(need):
        at = slice(s * STEP, (s + 1) * STEP)
        hits[keep] += (sig[a[keep], at] == sig[b[keep], at]).sum(axis=1, dtype=np.int32)
        keep = keep[hits[keep] >= m]
        if not len(keep):
            break
    return keep


def candidates(keys: np.ndarray, band: int, split: int, need: list[int]):
    """Surviving pairs of a unit in parts, the first member rising. keys: members x BANDS; all members share the band.

    Members before `split` are one block, the others the second (split = members: one block, with itself). A pair that shares an
    earlier band too belongs to another unit.
    """
    m, two = len(keys), split < len(keys)
    sig = np.ascontiguousarray(keys).view(np.uint16)
    step = max(1, (1 << 20) // max(m, 1))
    for lo in range(0, split if two else m, step):
        a = np.arange(lo, min(lo + step, split if two else m))
        b = np.arange(split, m) if two else np.arange(m)
        found = np.ones((len(a), len(b)), dtype=bool) if two else a[:, None] < b[None, :]
        for k in range(band):
            found &= keys[a, k][:, None] != keys[b, k][None, :]
        i, j = np.nonzero(found)
        for c in range(0, len(i), 1 << 17):
            x, y = a[i[c : c + (1 << 17)]], b[j[c : c + (1 << 17)]]
            live = prune(sig, x, y, need)
            if len(live):
                yield x[live], y[live]


def units(one: DataFrame) -> DataFrame:
    """(u1, u2, band, split, ks): groups of texts that share a band, hot ones as pairs of blocks; u1 and u2 are a hash of 128 bits."""
    each = one.select("k", F.posexplode("sig").alias("band", "key"))
    # counted first, so that no group is gathered before it is cut
    groups = each.groupBy("band", "key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    rows = each.join(groups, ["band", "key"]).withColumn("blocks", F.ceil(F.col("m") / MEMBERS).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = rows.groupBy("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.sort_array(F.collect_list(F.struct("block", "k"))).alias("x"))
    held = held.withColumn("split", F.size(F.filter("x", lambda r: r["block"] == F.col("i")))).filter("size(x) > 1 and split > 0 and (i = j or split < size(x))")
    held = held.select("band", "split", F.transform("x", lambda r: r["k"]).alias("ks"))
    held = held.groupBy(F.xxhash64("split", "ks").alias("u1"), F.xxhash64(F.lit(1), "ks", "split").alias("u2"))
    return held.agg(F.min("band").alias("band"), F.first("split").alias("split"), F.first("ks").alias("ks"))


def _whole(it):
    """Batches sorted by their first three columns as single batches that hold whole groups of them."""

    def one(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0] if len(parts) > 1 else parts[0]

    held, last = [], None
    for data in it:
        if not data.num_rows:
            continue
        keys = np.stack([data.column(c).to_numpy() for c in range(3)])
        if held and (keys[:, 0] != last).any():
            yield one(held)
            held = []
        last = keys[:, -1]
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        if len(change):
            yield one([*held, data.slice(0, int(change[-1]) + 1)])
            held = [data.slice(int(change[-1]) + 1)]
        else:
            held.append(data)
    if held:
        yield one(held)


def _units_of(it, more: int):
    """(key, band, split, ks, keys, the column `more` as a slice) of each unit, from rows (u1, u2, sub, at, band, split, k, sig, ...) in the order of (u1, u2, sub, at)."""
    for data in _whole(it):
        keys = np.stack([data.column(c).to_numpy() for c in range(3)])
        edge = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        at, band, split, ks = (data.column(c).to_numpy() for c in range(3, 7))
        sig = data.column(7).flatten().to_numpy().reshape(-1, BANDS)
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), data.num_rows]):
            rows = slice(a, b)
            own, extra = at[rows], data.column(more).slice(a, b - a)
            if b - a > 1 and (own[1:] == own[:-1]).any():  # a text that came twice
                keep = np.unique(own, return_index=True)[1]
                yield keys[:, a], int(band[a]), int(split[a]), ks[rows][keep], sig[rows][keep], extra.take(pa.array(keep))
            else:
                yield keys[:, a], int(band[a]), int(split[a]), ks[rows], sig[rows], extra


def _rows_of(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(c)) for c in columns], names=names)


def parts(live: np.ndarray, n: np.ndarray, split: int, most: int) -> np.ndarray:
    """A number for each member, rising: runs of live ones with about `most` n-grams; none goes over `split`."""
    size = np.where(live, n, 0)
    at = (np.cumsum(size) - size) // most
    if 0 < split < len(at):
        at[split:] += 1 + at[split - 1] - at[split]
    return np.unique(at, return_inverse=True)[1]


def survivors(one: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(u1, u2, sub, at, band, split, k, sig): the texts with a pair that isn't pruned, in units that are small enough to be verified."""
    rows = units(one).select("u1", "u2", "band", "split", F.posexplode("ks").alias("at", "k")).join(one, "k")
    rows = rows.select("u1", "u2", F.lit(0).alias("sub"), "at", "band", "split", "k", "sig", "n")
    need, most = least_matches(threshold, tolerance), GRAMS
    names = ["u1", "u2", "sub", "at", "band", "split", "k", "sig"]

    def run(it):
        out, held = [[] for _ in names], 0
        for (u1, u2, _), band, split, ks, keys, n in _units_of(it, 8):
            pairs = list(candidates(keys, band, split, need)) if len(ks) <= 64 else None  # those of a large unit aren't kept
            live = np.zeros(len(ks), dtype=bool)
            for x, y in pairs if pairs is not None else candidates(keys, band, split, need):
                live[x] = live[y] = True
            if not live.any():
                continue
            part = parts(live, n.to_numpy(), split, most)
            some = np.array([0])
            if part[-1]:
                codes = [np.unique(part[x] * (part[-1] + 1) + part[y]) for x, y in (pairs if pairs is not None else candidates(keys, band, split, need))]
                some = np.unique(np.concatenate(codes))
            for sub, code in enumerate(some.tolist()):
                p, q = divmod(code, int(part[-1]) + 1)
                one_, two_ = np.flatnonzero(live & (part == p)), np.flatnonzero(live & (part == q))
                mine = one_ if p == q else np.concatenate([one_, two_])
                m = len(mine)
                for c, v in zip(out, (np.full(m, u1), np.full(m, u2), np.full(m, sub, np.int32), np.arange(m, dtype=np.int32), np.full(m, band, np.int32), np.full(m, len(one_), np.int32), ks[mine], keys[mine].ravel())):
                    c.append(v)
                held += m
            if held > 1 << 13:
                yield _with_sig(out, names)
                out, held = [[] for _ in names], 0
        if held:
            yield _with_sig(out, names)

    rows = rows.repartition("u1", "u2").sortWithinPartitions("u1", "u2", "sub", "at")
    return rows.mapInArrow(run, "u1 long, u2 long, sub int, at int, band int, split int, k long, sig array<long>")


def _with_sig(columns: list[list], names: list[str]) -> pa.RecordBatch:
    *flat, sig = (np.concatenate(c) for c in columns)
    at = pa.array(np.arange(0, len(sig) + 1, BANDS, dtype=np.int32))
    return pa.record_batch([*map(pa.array, flat), pa.ListArray.from_arrays(at, pa.array(sig))], names=names)


def gram_sets(texts: DataFrame) -> DataFrame:
    """(k, g) of (id, text): the distinct n-gram hashes of each text as bytes. A text that comes again in a partition is left out."""

    def run(it):
        seen: set[int] = set()
        for data in it:
            rows = data.column(1).to_pylist()
            for part in _chunks(rows):
                values, bounds, k, n = grams([rows[i] or "" for i in part])
                live = [i for i in np.flatnonzero(n).tolist() if not (int(k[i]) in seen or seen.add(int(k[i])))]
                if live:
                    sets = [np.unique(values[bounds[i] : bounds[i + 1]]).tobytes() for i in live]
                    yield pa.record_batch([pa.array(k[live].view(np.int64)), pa.array(sets, pa.binary())], names=["k", "g"])

    return texts.mapInArrow(run, "k long, g binary")


class Unit:
    """Exact similarities within one unit. links: the number of each member's; label: equal for connected members."""

    def __init__(self, sets: list[np.ndarray], threshold: float, forest: bool):
        self.sets, self.threshold, self.forest = sets, threshold, forest
        self.size = np.array([len(s) for s in sets])
        self.links, self.label = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
        self.flat = None

    def _prepare(self) -> None:
        _, ids = np.unique(np.concatenate(self.sets), return_inverse=True)
        self.flat, self.at = ids, np.concatenate([[0], np.cumsum(self.size)])
        self.mark = np.zeros(int(ids.max(initial=-1)) + 1, dtype=np.int32)

    def common(self, x: int, y: np.ndarray) -> np.ndarray:
        """Number of n-grams that x shares with each of y."""
        if len(self.sets) == 2:
            return np.array([len(np.intersect1d(*self.sets, assume_unique=True))])
        if self.flat is None:
            self._prepare()
        self.mark[self.flat[self.at[x] : self.at[x + 1]]] = 1
        out = []
        for c in range(0, len(y), 256):
            part = y[c : c + 256]
            first = np.concatenate([[0], np.cumsum(self.size[part])[:-1]])
            index = np.repeat(self.at[part] - first, self.size[part]) + np.arange(self.size[part].sum())
            out.append(np.add.reduceat(self.mark[self.flat[index]], first))
        self.mark[self.flat[self.at[x] : self.at[x + 1]]] = 0
        return np.concatenate(out)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Verify the pairs (a[i], b[i]); forest: only those whose members aren't connected yet."""
        order = np.argsort(a, kind="stable")
        cuts = np.flatnonzero(np.diff(a[order], prepend=-1)).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
            x, y = int(a[order[lo]]), b[order[lo:hi]]
            if self.forest:
                y = y[self.label[y] != self.label[x]]
                if not len(y):
                    continue
            both = self.common(x, y)
            y = y[both / (self.size[x] + self.size[y] - both) >= self.threshold - 1e-12]
            if len(y):
                self.links[x] += len(y)
                np.add.at(self.links, y, 1)
                self.label[np.isin(self.label, self.label[[x, *y]])] = min(self.label[x], self.label[y].min())


def verified(docs: DataFrame, reps: DataFrame, found: DataFrame, doc_id: str, text: str, threshold: float, tolerance: float, forest: bool = False) -> DataFrame:
    """(k, root, n) of texts with a link: in each unit the number of links and a member that the text is connected to. forest: only enough links are looked for to connect the members."""
    wanted = reps.join(found.select("k").distinct(), "k", "left_semi").select("id").distinct()
    texts = docs.select(col(doc_id).alias("id"), col(text).alias("text")).filter("id is not null and text is not null").join(wanted, "id", "left_semi")
    rows = found.join(gram_sets(texts), "k").select("u1", "u2", "sub", "at", "band", "split", "k", "sig", "g")
    need = least_matches(threshold, tolerance)

    def run(it):
        out, held = [[], [], []], 0
        for _, band, split, ks, keys, g in _units_of(it, 8):
            unit = Unit([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in g], threshold, forest)
            for x, y in candidates(keys, band, split, need):
                unit.add(x, y)
            live = np.flatnonzero(unit.links)
            if len(live):
                out[0].append(ks[live]), out[1].append(ks[unit.label[live]]), out[2].append(unit.links[live])
                held += len(live)
            if held > 1 << 15:
                yield _rows_of(out, ["k", "root", "n"])
                out, held = [[], [], []], 0
        if held:
            yield _rows_of(out, ["k", "root", "n"])

    return rows.repartition("u1", "u2", "sub").sortWithinPartitions("u1", "u2", "sub", "at").mapInArrow(run, "k long, root long, n long")


def components(edges: DataFrame) -> DataFrame:
    """(k, root) of every node of the edges (a, b): root is the least node of its component.

    Least labels with pointer jumping, until nothing changes; every round is written to the shared folder.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "k"))
    while True:
        near = both.join(labels, both["b"] == labels["k"]).groupBy("a").agg(F.min("root").alias("near"))
        step = labels.join(near, labels["k"] == near["a"]).select("k", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        to = labels.select(F.col("k").alias("m"), F.col("root").alias("next"))
        new = cut(step.join(to, step["root"] == to["m"]).select("k", F.least("root", "next").alias("root"), (F.least("root", "next") < F.col("old")).alias("moved")))
        labels = new.select("k", "root")
        if not new.filter("moved").limit(1).count():
            return labels


def classes(docs: DataFrame, sketches: DataFrame, doc_id: str, text: str, threshold: float, tolerance: float, forest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(k, n_links) of texts with a link, and (k, class_id) of all texts: the least id in the text's class."""
    texts = sketches.filter("k is not null").groupBy("k").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))  # equal for equal words
    one = texts.select("k", "n", "sig")
    reps = texts.select("k", "id")
    rows = cut(verified(docs, reps, cut(survivors(one, threshold, tolerance)), doc_id, text, threshold, tolerance, forest))
    roots = components(rows.select(F.col("k").alias("a"), F.col("root").alias("b")))
    named = reps.join(roots, "k", "left").select("k", "id", F.coalesce("root", "k").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("class_id"))
    return rows.groupBy("k").agg(F.sum("n").alias("n_links")), named.join(least, "root").select("k", "class_id")


def links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_copies, n_links), a row for each document.

    class_id: the least id of the documents that links connect, or that have the same words; n_copies: other documents with the same
    words; n_links: texts with other words whose similarity reaches the threshold.
    """
    sketches = cut(sketch(docs, doc_id, text))
    found, named = classes(docs, sketches, doc_id, text, threshold, tolerance)
    members = sketches.select("id", "k").distinct()
    copies = members.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("m"))
    known = copies.join(named, "k").join(found, "k", "left")
    out = members.join(known, "k", "left")
    zero = F.lit(0).cast("long")
    return out.select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id"), F.coalesce(F.col("m") - 1, zero).alias("n_copies"), F.coalesce("n_links", zero).alias("n_links"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """docs without the near duplicates: of each class of documents that links connect, the one with the least id stays.

    Documents with no id or no word stay. All columns are kept. Of repeated rows of the document that stays, all stay.
    Of an id with several texts, only the rows go whose own text is a duplicate.
    """
    sketches = cut(sketch(docs, doc_id, text, own=True))
    _, named = classes(docs, sketches, doc_id, text, threshold, tolerance, forest=True)
    gone, own = spare(docs, "gone", "own")
    ids = sketches.filter("k is not null").select("id", "k", "u").join(named, "k")
    dropped = ids.filter("id <> class_id").select(F.col("id").alias(gone), F.col("u").alias(own)).distinct()
    return docs.join(dropped, (col(doc_id) == dropped[gone]) & (F.xxhash64(col(text)) == dropped[own]), "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(table(spark, sf_dir, "documents"))


QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLES = {
    "op8_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT row_number() OVER () AS t, w, count(*) AS docs, min(doc_id) AS least FROM d WHERE len(w) > 0 GROUP BY w),
g AS (SELECT DISTINCT t, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) ELSE [array_to_string(w, ' ')] END) AS s FROM t),
n AS (SELECT t, count(*) AS n FROM g GROUP BY t),
p AS (SELECT a.t AS a, b.t AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.t <> b.t GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE c / (x.n + y.n - c) >= {THRESHOLD} - 1e-12),
r AS (SELECT t AS a, t AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT r.a AS t, min(t.least) AS class_id FROM r JOIN t ON t.t = r.b GROUP BY 1),
l AS (SELECT a AS t, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(t.docs - 1, 0) AS n_copies, coalesce(l.n_links, 0) AS n_links
FROM d LEFT JOIN t ON t.w = d.w LEFT JOIN c ON c.t = t.t LEFT JOIN l ON l.t = t.t""",
}
