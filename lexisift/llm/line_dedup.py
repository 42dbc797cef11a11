"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

A document is the sequence of its lines (blanks at the ends don't count, blank lines are left out). In the order
of (doc_id, hash of the text, line), every maximal run of lines that has occurred before is a later copy; if it has at least
MIN_WORDS words, its lines are deleted, with the blank lines after each. Overlapping runs are deleted alike.

1. Lines that occur once end any run. They cut the documents into segments; only the segments go on.
2. Prefix doubling. A suffix's rank is (hash of its first line, offset among the suffixes with that line). In a round with
   prefixes of c lines, seven more ranks at distances c, 2c ... 7c (read within the document) order the suffixes of
   a group, which doubles the prefix three times in one round. A suffix that ends leaves the sorting. It stops when no group with
   longer suffixes is left: after log8 of the longest repeated run. What is sorted are the different continuations with their counts (partial
   sums before the shuffle), first by the next rank and then within it, and their ranks are joined to the suffixes: a hot line with hot followers is a few rows.
3. Equal suffixes are one from here on: all but the first are copies up to their end. This also takes hot lines out.
4. LCP. Neighbours in suffix order that were in one group in the round for c lines, and no longer for 8c, have a common prefix of c to
   8c lines. Where also the lines before them agree, the value is that of the suffix before, less one; only the others
   (whose lengths add up to n log n at most) are compared line by line.
5. LCP intervals. A pass with a stack upwards and one downwards over the suffixes of a first line give each the longest interval in which an earlier
   suffix lies: the longest run from there that has occurred before. Both read sorted rows one after the other and hold only the stack.

Steps 4 and 5 take the classes of step 3 of one first line in one task: one row for each different repeated continuation of the line, however often it occurs.

Defined results
- null or empty text, null id: the row stays as it is and isn't the source of anything.
- a document of which no line is left is dropped; all columns are kept, only the text (and nothing that is derived from it) changes.
- repeated rows (same id and text) are one document: they are treated alike, and none is the other's copy.
- rows with one id and other texts are ordered by the hash of their texts. Empty tables give no row.
- lines are told apart by a 64-bit hash. Texts of any length are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, cut, spare, table

MIN_WORDS = 8
FACTOR = 8
_WORD = re.compile(r"[^ \t\r\f\v]+")


def _key(doc_id: str, text: str) -> list[Column]:
    return [col(doc_id).alias("d"), F.xxhash64(col(doc_id), col(text)).alias("u")]


def repeated_lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, u, pos, h, seg, rem): lines that occur more than once; seg numbers a document's segments, rem counts the lines to its end."""
    lines = F.filter(F.transform(F.split(col(text), "\n"), lambda x: F.trim(F.translate(x, "\t\r\f\x0b", "    "))), lambda x: x != "")
    rows = docs.filter(col(doc_id).isNotNull() & col(text).isNotNull()).select(*_key(doc_id, text), F.transform(lines, lambda x: F.xxhash64(x)).alias("hs"))
    rows = rows.groupBy("d", "u").agg(F.first("hs").alias("hs"))
    rows = rows.select("d", "u", F.posexplode("hs").alias("pos", "h"))
    # counted by a partial aggregate and joined, so that the places of a hot line are never gathered
    often = rows.groupBy(F.col("h").alias("h2")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = rows.join(often, F.col("h") == F.col("h2")).select("d", "u", "pos", "h")
    line = Window.partitionBy("d", "u").orderBy("pos")
    rows = rows.withColumn("seg", F.col("pos") - F.row_number().over(line))
    return rows.withColumn("rem", F.row_number().over(Window.partitionBy("d", "u", "seg").orderBy(F.desc("pos"))))


def _places(tuples: DataFrame, names: list[str]) -> DataFrame:
    """(h, off, t1, t2, same, place): how many suffixes of the group come before those with these continuations. tuples: a row for each different one, `same` times."""
    first, rest = names[0], names[1:]
    nexts = tuples.groupBy("h", "off", first).agg(F.sum("same").alias("m"))
    nexts = nexts.withColumn("base", F.sum("m").over(Window.partitionBy("h", "off").orderBy(first)) - F.col("m")).drop("m")
    own = Window.partitionBy("h", "off", first).orderBy(*[F.asc_nulls_first(n) for n in rest]).rowsBetween(Window.unboundedPreceding, 0)
    tuples = tuples.withColumn("within", F.sum("same").over(own) - F.col("same"))
    return tuples.join(nexts, ["h", "off", first]).select("h", "off", "t1", "t2", "same", (F.col("base") + F.col("within")).alias("place"))


def suffix_ranks(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows with `off` (order among suffixes with the same first line; equal suffixes are equal) and `offs` (those of each round), and the number of rounds."""
    # offsets are spread by two in each round, which leaves a place for the suffixes that end
    state = cut(rows.withColumn("off", F.lit(0).cast("long")).withColumn("offs", F.array().cast("array<long>")))
    c, rounds = 1, 0
    in_doc = Window.partitionBy("d", "u", "seg").orderBy("pos")
    names = [f"k{j}" for j in range(1, FACTOR)]
    while state.filter((F.col("rem") > c)).limit(1).count():
        shifted = state.select("*", *[F.lead(F.struct("h", "off"), j * c).over(in_doc).alias(n) for j, n in enumerate(names, 1)])
        ended = state.filter(F.col("rem") <= c)
        tag = [F.xxhash64(*names).alias("t1"), F.xxhash64(F.lit(1), *names).alias("t2")]
        going = shifted.filter(F.col("rem") > c).select("*", *tag).drop(*names)
        places = _places(shifted.filter(F.col("rem") > c).groupBy("h", "off", *names).agg(F.count(F.lit(1)).alias("same")).select("*", *tag), names)
        going = going.join(places, ["h", "off", "t1", "t2"]).withColumn("new", 2 * F.col("off") + F.col("place") + 1)
        going = going.select("d", "u", "pos", "h", "seg", "rem", F.col("new").alias("off"), F.concat("offs", F.array("new")).alias("offs"), ((F.col("same") > 1) & (F.col("rem") > c * FACTOR)).alias("open"))
        ended = ended.select("d", "u", "pos", "h", "seg", "rem", (2 * F.col("off")).alias("off"), F.concat("offs", F.array(2 * F.col("off"))).alias("offs"), F.lit(False).alias("open"))
        state = cut(going.unionByName(ended))
        c, rounds = c * FACTOR, rounds + 1
        if not state.filter("open").limit(1).count():
            break
        state = state.drop("open")
    return state.drop("open"), rounds


def common_prefixes(ranks: DataFrame) -> DataFrame:
    """(h, off, d, u, pos, lcp) of the first of each class of equal suffixes: lcp with the class before it under the same first line."""
    place = F.struct("d", "u", "pos")
    before = F.lag("h").over(Window.partitionBy("d", "u", "seg").orderBy("pos"))
    reps = ranks.withColumn("prev", before).groupBy("h", "off").agg(F.min_by(F.struct("d", "u", "pos", "seg", "rem", "prev", "offs"), place).alias("r")).select("h", "off", "r.*")
    order = Window.partitionBy("h").orderBy("off")
    pairs = reps.withColumn("p", F.lag(F.struct("d", "u", "pos", "seg", "rem", "prev", "offs")).over(order))
    first, rest = pairs.filter("p is null"), pairs.filter("p is not null")
    # rounds in which both were in one group: a common prefix of FACTOR ** level lines at least
    level = F.size(F.filter(F.zip_with("offs", F.col("p.offs"), lambda x, y: x == y), lambda x: x))
    most = F.least("rem", F.col("p.rem"))
    rest = rest.withColumn("level", level).withColumn("most", most)
    rest = rest.withColumn("base", F.least(F.pow(F.lit(FACTOR), "level").cast("int"), "most"))
    rest = rest.withColumn("size", F.least(F.pow(F.lit(FACTOR), F.col("level") + 1).cast("int"), "most") - F.col("base"))
    rest = rest.withColumn("alone", F.coalesce(F.col("prev") != F.col("p.prev"), F.lit(True)))
    rest = cut(rest.select("h", "off", "d", "u", "pos", "seg", "alone", "base", "size", F.col("p.d").alias("d2"), F.col("p.u").alias("u2"), F.col("p.pos").alias("pos2"), F.col("p.seg").alias("seg2")))
    # lines of the segments that are compared
    work = rest.filter("alone and size > 0")
    segs = ranks.groupBy("d", "u", "seg").agg(F.min("pos").alias("start"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]).alias("hs"))
    part = lambda pos: F.slice("hs", F.col(pos) - F.col("start") + F.col("base") + 1, F.col("size"))
    one = work.join(segs, ["d", "u", "seg"]).select("h", "off", "d2", "u2", "seg2", "pos2", "base", "size", part("pos").alias("a"))
    two = one.join(segs.select(F.col("d").alias("d2"), F.col("u").alias("u2"), F.col("seg").alias("seg2"), "start", "hs"), ["d2", "u2", "seg2"]).select("h", "off", "size", "a", part("pos2").alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda x, y: x == y), False)
    more = two.select("h", "off", F.when(differ > 0, differ - 1).otherwise(F.col("size")).cast("int").alias("more"))
    known = rest.join(more, ["h", "off"], "left").withColumn("own", F.when(F.col("alone"), F.col("base") + F.coalesce("more", F.lit(0))))
    known = known.unionByName(first.select("h", "off", "d", "u", "pos", "seg", F.lit(0).alias("own")), allowMissingColumns=True)
    # the others: the value of the last compared suffix before in the segment, less the distance
    back = Window.partitionBy("d", "u", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("own").isNotNull(), F.struct("pos", "own")), ignorenulls=True).over(back)
    return known.withColumn("l", last).select("h", "off", "d", "u", "pos", F.coalesce("own", F.col("l.own") - (F.col("pos") - F.col("l.pos"))).cast("int").alias("lcp"))


class Sweep:
    """A pass over suffixes in (falling or rising) suffix order: the longest prefix that one met before has whose place is earlier."""

    def __init__(self):
        self.stack: list[tuple] = []

    def step(self, place, lcp: int) -> int:
        """lcp: with the suffix before in the pass."""
        stack, now, out = self.stack, lcp, 0
        while stack and stack[-1][0] > place:
            now = min(now, stack.pop()[1])
        if stack:
            out = now
        stack.append((place, now))
        return out


def previous_lengths(order: list[int], lcp: list[int]) -> list[int]:
    """For suffixes in suffix order (order: their place in the text, lcp: with the one before): the longest prefix that an earlier one has."""
    up, down, n = Sweep(), Sweep(), len(order)
    out = [up.step(x, k) for x, k in zip(order, lcp)]
    for i in range(n - 1, -1, -1):
        out[i] = max(out[i], down.step(order[i], lcp[i + 1] if i + 1 < n else 0))
    return out


def _swept(lcps: DataFrame, rising: bool) -> DataFrame:
    """(d, u, pos, n > 0) of one pass over (h, off, d, u, pos, lcp), the suffixes of a first line one after the other."""

    def run(it):
        line, sweep, before = None, Sweep(), 0
        for data in it:
            hs, ds, us, ps, ls = (data.column(c).to_pylist() for c in ("h", "d", "u", "pos", "lcp"))
            out = []
            for h, d, u, p, k in zip(hs, ds, us, ps, ls):
                if h != line:
                    line, sweep, before = h, Sweep(), 0
                out.append(sweep.step((d, u, p), k if rising else before))
                before = k
            rows = np.flatnonzero(out)
            if len(rows):
                yield pa.record_batch([*(data.column(c).take(pa.array(rows)) for c in ("d", "u", "pos")), pa.array(np.array(out, dtype=np.int32)[rows])], names=["d", "u", "pos", "n"])

    order = F.asc("off") if rising else F.desc("off")
    rows = lcps.select("h", "off", "d", "u", "pos", "lcp").repartition("h").sortWithinPartitions("h", order)
    return rows.mapInArrow(run, f"d {lcps.schema['d'].dataType.simpleString()}, u long, pos int, n int")


def earlier_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d, u, runs: (pos, n) of lines that have occurred before, none inside another)."""
    ranks, _ = suffix_ranks(repeated_lines(docs, doc_id, text))
    place = F.struct("d", "u", "pos")
    lcps = cut(common_prefixes(ranks))  # it is read by both passes
    classes = ranks.groupBy("h", "off").agg(F.min(place).alias("m"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    copies = ranks.join(classes, ["h", "off"]).filter(place != F.col("m")).select("d", "u", "pos", F.col("rem").alias("n"))
    runs = _swept(lcps, True).unionByName(_swept(lcps, False)).unionByName(copies)
    before = Window.partitionBy("d", "u").orderBy("pos", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("to", F.max(F.col("pos") + F.col("n")).over(before)).filter("to is null or pos + n > to")
    return runs.groupBy("d", "u").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("runs"))


def without_runs(text: str, runs: list[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[str | None, int]:
    """The text without the runs of at least min_words words (None if no line is left), and the number of lines deleted."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip(" \t\r\f\v")]
    words = [0]
    for i in full:
        words.append(words[-1] + len(_WORD.findall(lines[i])))
    gone, done = [False] * len(full), 0
    for pos, n in runs:
        if words[pos + n] - words[pos] >= min_words:
            a = max(pos, done)
            gone[a : pos + n] = [True] * (pos + n - a)
            done = max(done, pos + n)
    if not any(gone):
        return text, 0
    if all(gone):
        return None, len(gone)
    kept, drop, at = [], False, iter(gone)
    for x in lines:
        drop = next(at) if x.strip(" \t\r\f\v") else drop
        if not drop:
            kept.append(x)
    return "\n".join(kept), sum(gone)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, count: str | None = None) -> DataFrame:
    """docs without later copies of runs of lines, and without the documents of which nothing is left. count: a column for the number of lines deleted."""

    @F.pandas_udf("text string, n int")
    def apply(texts: pd.Series, pos: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if t is None or p is None else without_runs(t, list(zip(p.tolist(), k.tolist())), min_words) for t, p, k in zip(texts, pos, n)], columns=["text", "n"])

    runs = earlier_runs(docs, doc_id, text)
    out, d, u, r = spare(docs, "out", "d", "u", "runs")
    runs = runs.select(F.col("d").alias(d), F.col("u").alias(u), F.col("runs").alias(r))
    hit = docs.join(runs, (col(doc_id) == runs[d]) & (F.xxhash64(col(doc_id), col(text)) == runs[u]), "left")
    # texts without runs don't go to Python
    live = F.col(r).isNotNull()
    hit = hit.withColumn(out, apply(F.when(live, col(text)), F.transform(r, lambda x: x["pos"]), F.transform(r, lambda x: x["n"])))
    hit = hit.filter(~live | F.col(f"{out}.text").isNotNull())
    columns = [F.when(live, F.col(f"{out}.text")).otherwise(col(c)).alias(c) if c == text else col(c) for c in docs.columns if c != count]
    if count:
        columns.append(F.when(live, F.col(f"{out}.n")).otherwise(0).alias(count))
    return hit.select(*columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_deleted")


QUERIES = {"op4_line_dedup": op4_line_dedup}
ORACLES = {
    "op4_line_dedup": rf"""
WITH l0 AS (SELECT doc_id AS d, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
l AS (SELECT d, i, raw, trim(translate(raw, chr(9) || chr(13) || chr(12) || chr(11), '    '), ' ') AS x FROM l0),
s AS (SELECT d, x, i, row_number() OVER (PARTITION BY d ORDER BY i) AS p, len(list_filter(regexp_split_to_array(x, '[ \t\r\f\v]+'), lambda y: y <> '')) AS w FROM l WHERE x <> ''),
e AS (SELECT a.d, a.p, b.d AS d2, b.p AS p2 FROM s a JOIN s b ON a.x = b.x AND (b.d < a.d OR b.d = a.d AND b.p < a.p)),
g AS (SELECT *, p - row_number() OVER (PARTITION BY d, d2, p - p2 ORDER BY p) AS g FROM e),
f AS (SELECT d, p, max(p) OVER (PARTITION BY d, d2, p - p2, g) - p + 1 AS n FROM g),
r AS (SELECT d, p, max(n) AS n FROM f GROUP BY d, p),
q AS (SELECT r.d, r.p, r.n FROM r JOIN s ON s.d = r.d AND s.p >= r.p AND s.p < r.p + r.n GROUP BY r.d, r.p, r.n HAVING sum(s.w) >= {MIN_WORDS}),
x AS (SELECT DISTINCT s.d, s.i FROM s JOIN q ON s.d = q.d AND s.p >= q.p AND s.p < q.p + q.n),
m AS (SELECT l.d, l.i, l.raw, l.x, x.i IS NOT NULL AS gone, max(CASE WHEN l.x <> '' THEN l.i END) OVER (PARTITION BY l.d ORDER BY l.i) AS last FROM l LEFT JOIN x ON x.d = l.d AND x.i = l.i),
k AS (SELECT m.d, string_agg(m.raw, chr(10) ORDER BY m.i) AS t, count(*) FILTER (WHERE m.x <> '') AS n FROM m LEFT JOIN x ON x.d = m.d AND x.i = m.last WHERE x.i IS NULL GROUP BY m.d),
c AS (SELECT d, count(*) AS n FROM x GROUP BY d)
SELECT doc_id, CASE WHEN c.n IS NULL THEN text ELSE k.t END AS text, CAST(coalesce(c.n, 0) AS INTEGER) AS n_deleted
FROM documents LEFT JOIN c ON c.d = doc_id LEFT JOIN k ON k.d = doc_id WHERE c.n IS NULL OR k.n > 0""",
}
