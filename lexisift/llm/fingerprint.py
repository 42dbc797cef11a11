"""Document fingerprints: a homomorphic hash of the multiset of paragraphs.

Each paragraph is hashed to a vector of 32 lanes of 32 bits (SHA-256, expanded by four more
SHA-256 of the digest with a counter); a document's fingerprint is the sum of the vectors modulo
2**32 in each lane, 1024 bits. The order of paragraphs doesn't matter, their number does.
Paragraphs are inserted and deleted by adding and subtracting (`insert`, `delete`) without the rest
of the document. Everything is built from JVM expressions over one row; no paragraph is shuffled. Copies are counted by a partial aggregate of the
fingerprints, which are written to the shared folder once and read twice.

A paragraph is a line, with runs of blanks as one space and no blanks at its ends; empty lines are none.

Defined results
- null or empty text: no paragraph, the zero vector, 0 copies, no first document.
- repeated rows: each is a copy of the other and counted; null ids never are a first document.
- extra columns are ignored. Very long texts are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, cut, table

LANES = 32
MODULUS = 1 << 32
BLANKS = r"[ \t\r\f\x0B]+"


def paragraphs(text: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.trim(F.regexp_replace(p, BLANKS, " ")))
    return F.filter(lines, lambda p: p != "")


def _wide(p: Column) -> Column:
    """256 hex digits."""
    h = F.sha2(p, 256)
    return F.transform(F.array(h), lambda d: F.concat(*[F.sha2(F.concat(d, F.lit(f":{k}")), 256) for k in range(LANES // 8)]))[0]


def _lanes(wide: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda i: F.conv(F.substring(wide, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def _encode(sums: Column) -> Column:
    return F.array_join(F.transform(sums, lambda x: F.lower(F.lpad(F.hex(F.pmod(x, F.lit(MODULUS))), 8, "0"))), "")


def vector_sum(parts: Column) -> Column:
    zero = F.array_repeat(F.lit(0).cast("long"), LANES)
    return F.aggregate(F.transform(parts, _wide), zero, lambda acc, w: F.zip_with(acc, _lanes(w), lambda a, b: a + b))


def fingerprint(parts: Column) -> Column:
    """256 hex digits of an array of paragraphs."""
    return _encode(vector_sum(parts))


def insert(fp: Column, parts: Column) -> Column:
    """The fingerprint of the document with more paragraphs."""
    return _encode(F.zip_with(_lanes(fp), vector_sum(parts), lambda a, b: a + b))


def delete(fp: Column, parts: Column) -> Column:
    """The fingerprint of the document without some of its paragraphs."""
    return _encode(F.zip_with(_lanes(fp), vector_sum(parts), lambda a, b: a - b))


def combine(*fps: Column) -> Column:
    """The fingerprint of several documents' paragraphs together."""
    out = _lanes(fps[0])
    for fp in fps[1:]:
        out = F.zip_with(out, _lanes(fp), lambda a, b: a + b)
    return _encode(out)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, fingerprint, n_copies, first_doc_id) for every row: rows with the same paragraphs in any order, and the least id among them."""
    out = docs.select(col(doc_id).alias("doc_id"), paragraphs(col(text)).alias("p")).select("doc_id", F.size("p").alias("n_paragraphs"), fingerprint(F.col("p")).alias("fingerprint"))
    out = cut(out)  # it is read twice
    # counted by a partial aggregate and joined, so that no group of copies is gathered; documents without paragraphs take no part
    same = out.filter("n_paragraphs > 0").groupBy(F.col("fingerprint").alias("same")).agg(F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("first_doc_id"))
    out = out.join(same, (F.col("n_paragraphs") > 0) & (F.col("fingerprint") == F.col("same")), "left")
    return out.select("doc_id", "n_paragraphs", "fingerprint", F.coalesce("n_copies", F.lit(0).cast("long")).alias("n_copies"), "first_doc_id")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
ORACLES = {
    "op3_fingerprints": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (SELECT r, trim(regexp_replace(unnest(string_split(coalesce(text, ''), chr(10))), '[ \t\r\f\x0B]+', ' ', 'g'), ' ') AS p FROM d),
h AS (SELECT r, sha256(p) AS h FROM l WHERE p <> ''),
w AS (SELECT r, concat(sha256(h || ':0'), sha256(h || ':1'), sha256(h || ':2'), sha256(h || ':3')) AS w FROM h),
s AS (SELECT r, i, sum(CAST('0x' || substr(w, CAST(i * 8 + 1 AS BIGINT), 8) AS BIGINT)) % 4294967296 AS v FROM w, range(32) t(i) GROUP BY r, i),
f AS (SELECT r, string_agg(lpad(lower(to_hex(CAST(v AS BIGINT))), 8, '0'), '' ORDER BY i) AS f FROM s GROUP BY r),
n AS (SELECT r, count(*) AS n FROM h GROUP BY r),
a AS (SELECT d.doc_id, coalesce(n.n, 0) AS n, coalesce(f.f, repeat('0', 256)) AS f FROM d LEFT JOIN n USING (r) LEFT JOIN f USING (r))
SELECT doc_id, CAST(n AS INTEGER) AS n_paragraphs, f AS fingerprint,
  CASE WHEN n > 0 THEN count(*) OVER (PARTITION BY f) ELSE 0 END AS n_copies,
  CASE WHEN n > 0 THEN min(doc_id) OVER (PARTITION BY f) END AS first_doc_id
FROM a""",
}
