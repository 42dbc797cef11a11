"""URL filters: hosts are segmented into words, then multinomial naive Bayes scores the tokens.

1. Unigrams. The words of all documents are counted (all rows, whole texts). Of those counts only the words
   that are a substring of some host label are used; they are found with a join, so no vocabulary is
   collected or broadcast. The counts are written to the shared folder once, for the join and their total.
2. Viterbi. Each distinct label of a host is split into the words with the greatest product of unigram
   probabilities; a chunk that isn't a word costs a fixed penalty a letter. Host parts that are separated by
   dots, dashes or digits are split there first.
3. Naive Bayes. Tokens are the segmented host words and the words of the path (query and fragment
   included, marked as path tokens). The training rows are labelled by a table of hosts (`labels`), where one is given: pages of other hosts
   are only scored. Without one, seed words label all rows: a page whose host has a seed word as a
   whole dash- or dot-separated part is unwanted, the others are wanted. Counts and the classes' prior are taken over
   all labelled pages. The weights are a table, joined to the tokens of the distinct token lists by key.

Only hosts are segmented, so the work of the search is that of distinct host labels.

Defined results
- null or empty url, or one without a host: no tokens, score 0, not blocked, host null.
- user names, ports and upper case in hosts are dropped. Labels of any length are split, into words of at most MAX_WORD letters (the longest label that a
  host name may have) and unknown chunks of any length; urls of any length are taken whole.
- ties in a segmentation: the one with the longer last word. Repeated rows: alike, each on its own.
- no unwanted page among the labelled ones: all scores 0, nothing blocked. A host with labels of both kinds is unwanted; null hosts and labels are ignored.
- no page: no row. No or empty documents: hosts split at their separators only.
- extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, table

SEEDS = ["ads", "adult", "bet", "bets", "casino", "malware", "phish", "pills", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx"]
STOP = ["www", "com", "net", "org", "example"]
MAX_WORD, ALPHA = 63, 1.0
#: Cost of an unknown chunk: of 10 in the corpus, ten times less likely with each letter; BASE where there is no corpus.
BASE, LETTER = 10.0, math.log(10)
WORD = r"[\p{L}]+"


def host_of(url: Column) -> Column:
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(h != "", h)


def rest_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1))


def labels_of(host: Column) -> Column:
    """Runs of letters of a host."""
    return F.array_distinct(F.filter(F.regexp_extract_all(host, F.lit(WORD), F.lit(0)), lambda x: ~x.isin(*STOP)))


def unigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all rows: runs of letters in lower case."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(col(text)), F.lit(WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def viterbi(label: str, cost: dict[str, float], base: float = BASE) -> list[str]:
    """The cheapest split of a label into words at their cost and unknown chunks at base + LETTER a letter."""
    n, longest = len(label), max(map(len, cost), default=0)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    chunk, at = 0.0, 0  # the least best[i] - LETTER * i so far, and its i: where the best unknown chunk begins
    for j in range(1, n + 1):
        best[j], back[j] = chunk + base + LETTER * j, at
        for i in range(max(0, j - longest), j):
            w = cost.get(label[i:j])
            if w is not None and (best[i] + w < best[j] - 1e-12 or best[i] + w < best[j] + 1e-12 and i < back[j]):
                best[j], back[j] = best[i] + w, i
        if best[j] - LETTER * j < chunk - 1e-12:
            chunk, at = best[j] - LETTER * j, j
    out, j = [], n
    while j:
        out.append(label[back[j] : j])
        j = back[j]
    return out[::-1]


def segment(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words) for each distinct label. labels: (label); words: (word, n)."""
    at = F.sequence(F.lit(1), F.length("label"))
    starts = labels.filter(F.length("label") >= 2).select("label", F.explode(at).alias("i"))
    ends = F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), F.length("label") - F.col("i") + 1))
    subs = starts.select("label", F.explode(F.transform(ends, lambda k: F.substring("label", F.col("i"), k))).alias("word")).distinct()
    total = words.agg(F.sum("n").alias("all"))
    held = subs.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("word", F.log("n").alias("log_n"))).alias("held"))
    both = labels.join(held, "label", "left").crossJoin(F.broadcast(total))  # total is one row

    @F.pandas_udf("array<string>")
    def best(names: pd.Series, held: pd.Series, total: pd.Series) -> pd.Series:
        out = []
        for x, h, n in zip(names, held, total):
            log_all = math.log(n) if n == n and n else 0.0
            out.append(viterbi(x, {w["word"]: log_all - w["log_n"] for w in (h if h is not None else [])}, max(log_all - LETTER, BASE)))
        return pd.Series(out)

    return both.select("label", best("label", "held", F.col("all").cast("double")).alias("words"))


def host_labels(labels: DataFrame) -> DataFrame:
    """(host, unwanted) of a table with these columns: a row for each host, in lower case."""
    return labels.select(F.lower("host").alias("host"), F.col("unwanted").cast("boolean").alias("unwanted")).filter("host is not null and unwanted is not null").groupBy("host").agg(F.bool_or("unwanted").alias("unwanted"))


def tokens(pages: DataFrame, words: DataFrame, url: str = "url", page_id: str = "page_id", seeds: list[str] = SEEDS, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, host_words, seeded, path_words): page_id and url as given, tokens as arrays; seeded: whether a page is unwanted, null if its host has no label."""
    rows = pages.select(col(page_id).alias("page_id"), col(url).alias("url"), host_of(col(url)).alias("host"))
    hosts = rows.select("host").filter("host is not null").distinct()
    parts = hosts.select("host", F.posexplode(labels_of(F.col("host"))).alias("i", "label"))
    cuts = segment(parts.select("label").distinct(), words)
    split = parts.join(cuts, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "words"))), lambda x: x["words"])).alias("host_words"))
    seeded = F.coalesce(F.arrays_overlap(labels_of(F.col("host")), F.array(*map(F.lit, seeds)).cast("array<string>")), F.lit(False))
    split = hosts.join(split, "host", "left")
    if labels is not None:
        split, seeded = split.join(host_labels(labels), "host", "left"), F.col("unwanted")
    split = split.select("host", F.coalesce("host_words", F.array().cast("array<string>")).alias("host_words"), seeded.alias("seeded"))
    path = F.transform(F.array_distinct(F.regexp_extract_all(rest_of(F.col("url")), F.lit(WORD), F.lit(0))), lambda x: F.concat(F.lit("/"), x))
    return rows.join(split, "host", "left").select("page_id", "url", "host", "host_words", "seeded", F.coalesce(path, F.array().cast("array<string>")).alias("path_words"))


def weights(rows: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(token, weight): log-odds of unwanted against wanted over all labelled pages; the token '' holds the classes' log-odds."""
    known = rows.filter("host is not null and seeded is not null")
    n = known.select("seeded", F.explode("words").alias("token")).groupBy("token").agg(F.count_if("seeded").alias("bad"), F.count_if(~F.col("seeded")).alias("good"))
    total = n.agg(F.sum("bad").alias("b"), F.sum("good").alias("g"), F.count(F.lit(1)).alias("v"))
    odds = F.log((F.col("bad") + alpha) / (F.col("b") + alpha * F.col("v"))) - F.log((F.col("good") + alpha) / (F.col("g") + alpha * F.col("v")))
    prior = known.agg(F.count_if("seeded").alias("b"), F.count_if(~F.col("seeded")).alias("g")).filter("b > 0").select(F.lit("").alias("token"), (F.log(F.col("b") + alpha) - F.log(F.col("g") + alpha)).alias("weight"))
    return n.crossJoin(F.broadcast(total)).filter("b > 0").select("token", odds.alias("weight")).unionByName(prior)  # total is one row


def filter_urls(pages: DataFrame, docs: DataFrame, page_id: str = "page_id", url: str = "url", text: str = "text", block_at: float = 0.0, seeds: list[str] = SEEDS, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, host_words, score, blocked) for every page. labels: (host, unwanted) of known hosts, instead of seeds."""
    rows = cut(tokens(pages, cut(unigrams(docs, text)), url, page_id, seeds, labels).withColumn("words", F.concat("host_words", "path_words")))
    w = weights(rows)
    # equal token lists have equal scores
    lists = rows.filter("host is not null").select("words").distinct().withColumn("key", F.array_join("words", "\n"))
    score = lists.select("key", F.explode(F.concat("words", F.array(F.lit("")))).alias("token")).join(w, "token").groupBy("key").agg(F.sum("weight").alias("score"))
    score = score.withColumn("score", F.round("score", 6))
    out = rows.withColumn("key", F.when(F.col("host").isNotNull(), F.array_join("words", "\n"))).join(score, "key", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return out.select("page_id", "url", "host", F.array_join("host_words", " ").alias("host_words"), "score", (F.col("score") > block_at).alias("blocked"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = {"op9_url_filter": op9_url_filter}
ORACLES: dict[str, str] = {}
