"""A query for each operator over the tables of a folder, with SQL for its result where SQL can express it.

Results are whole (size -1) but where a page or a top list is what the query shows. Scores are rounded to six
digits on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .functions.analysis import ACCENTED, PLAIN
from .operators.search import SearchResult
from .sources import oplog, postings
from .sources.shared import shared_dir

IDS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Run = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def engine(spark: SparkSession, sf_dir: str, *tables: str) -> Engine:
    e = Engine(spark)
    for t in tables:
        e.register(t, read(spark, sf_dir, t), IDS[t])
    return e


def add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def scored(r: SearchResult) -> DataFrame:
    return r.hits.select("_id", F.round("_score", 6).alias("score"))


def hits(name: str, table: str, query: dict, sql: str, **body) -> None:
    """(_id, score) of all hits."""
    add(name, lambda spark, d: scored(engine(spark, d, table).search(table, {"query": query, "size": -1, "_source": False} | body)), sql)


def agg(name: str, table: str, aggs: dict, sql: str, path: str, shape: Callable[[DataFrame], DataFrame] = lambda x: x, query: dict | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        body = {"aggs": aggs, "size": 0} | ({"query": query} if query else {})
        return shape(engine(spark, d, table).search(table, body).aggs[path])

    add(name, run, sql)


# --- SQL


def norm(x: str) -> str:
    return f"translate(lower({x}), '{ACCENTED}', '{PLAIN}')"


def tok(x: str) -> str:
    return rf"regexp_extract_all({norm(x)}, '[\p{{L}}\p{{Nd}}]+')"


def corpus(table: str, text: str, more: str = "", d: str = "d", s: str = "s") -> str:
    """CTEs: documents with their tokens, and their number and total length."""
    key = IDS[table]
    return f"{d} AS (SELECT CAST({key} AS VARCHAR) AS _id, coalesce({tok(text)}, []) AS t{more} FROM {table}), {s} AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t)) AS l FROM {d})"


def has(term: str, d: str = "d") -> str:
    return f"list_contains({d}.t, '{term}')"


def weight(tf: str, dl: str, s: str = "s") -> str:
    return f"({tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * {dl} / greatest({s}.l / greatest({s}.n, 1), 1))))"


def idf(df: str, s: str = "s") -> str:
    return f"ln(1 + ({s}.n - {df} + 0.5) / ({df} + 0.5))"


def bm25(term: str, boost: float = 1.0, d: str = "d", s: str = "s") -> str:
    df = f"(SELECT count(*) FROM {d} x WHERE list_contains(x.t, '{term}'))"
    return f"({boost} * {idf(df, s)} * {weight(f'len(list_filter({d}.t, lambda x: x = {term!r}))', f'len({d}.t)', s)})"


def part(term: str, boost: float = 1.0, d: str = "d", s: str = "s") -> str:
    return f"(CASE WHEN {has(term, d)} THEN {bm25(term, boost, d, s)} ELSE 0 END)"


def constant(table: str, where: str, score: str = "1.0") -> str:
    return f"SELECT CAST({IDS[table]} AS VARCHAR) AS _id, CAST({score} AS DOUBLE) AS score FROM {table} WHERE {where}"


DOC = corpus("documents", "text")
NAME = corpus("part", "p_name")

# --- flagship

TOP = {"query": {"bool": {"must": [{"match": {"text": "the with of ention"}}], "filter": [{"term": {"lang.keyword": "en"}}]}}, "size": 10, "_source": False}


def search_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(engine(spark, sf_dir, "documents").search("documents", TOP))


_terms = ["the", "with", "of", "ention"]
add(
    "search_top",
    search_top,
    f"WITH {corpus('documents', 'text', ', lang')} SELECT _id, round({' + '.join(part(t) for t in _terms)}, 6) AS score FROM d, s WHERE lang = 'en' AND ({' OR '.join(has(t) for t in _terms)}) ORDER BY {' + '.join(part(t) for t in _terms)} DESC, _id LIMIT 10",
)

# --- full text

hits("match_or", "documents", {"match": {"text": "with the"}}, f"WITH {DOC} SELECT _id, round({part('with')} + {part('the')}, 6) AS score FROM d, s WHERE {has('with')} OR {has('the')}")
hits("match_and", "documents", {"match": {"text": {"query": "of The and", "operator": "and", "boost": 2}}}, f"WITH {DOC} SELECT _id, round({bm25('of', 2)} + {bm25('the', 2)} + {bm25('and', 2)}, 6) AS score FROM d, s WHERE {has('of')} AND {has('the')} AND {has('and')}")
hits("match_keyword", "documents", {"match": {"lang.keyword": {"query": "EN", "boost": 3}}}, constant("documents", "lang = 'en'", "3.0"))


def _fuzzy_sql(term: str, most: int) -> str:
    return f"""WITH {NAME}, p AS (SELECT _id, w, count(*) AS tf, any_value(dl) AS dl FROM (SELECT _id, unnest(t) AS w, len(t) AS dl FROM d) GROUP BY _id, w),
v AS (SELECT w, count(*) AS df, levenshtein(w, '{term}') AS e FROM p GROUP BY w)
SELECT _id, round(max({idf('v.df')} * {weight('p.tf', 'p.dl')} * (1 - 0.25 * e)), 6) AS score FROM p JOIN v USING (w), s WHERE e <= {most} GROUP BY _id"""


hits("match_fuzzy", "part", {"match": {"p_name": {"query": "widgt", "fuzziness": "AUTO"}}}, _fuzzy_sql("widgt", 1))
hits("fuzzy", "part", {"fuzzy": {"p_name": {"value": "plats", "fuzziness": "2"}}}, _fuzzy_sql("plats", 2))


def _phrase_sql(terms: list[str], last: str = " ") -> str:
    return f"WITH {DOC} SELECT _id, round({bm25(terms[0])} * {len(terms)}, 6) AS score FROM d, s WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' {' '.join(terms)}{last}')"


hits("match_phrase", "documents", {"match_phrase": {"text": "of the"}}, _phrase_sql(["of", "the"]))
hits("match_phrase_prefix", "documents", {"match_phrase_prefix": {"text": "of th"}}, _phrase_sql(["of", "th"], ""))
hits(
    "match_phrase_slop",
    "documents",
    {"match_phrase": {"text": {"query": "that with", "slop": 3}}},
    f"WITH {DOC}, p AS (SELECT _id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM d), m AS (SELECT DISTINCT a._id FROM p a JOIN p b ON a._id = b._id AND b.i > a.i AND b.i <= a.i + 4 WHERE a.w = 'that' AND b.w = 'with') SELECT d._id, round({bm25('that')} * 2, 6) AS score FROM d SEMI JOIN m ON d._id = m._id, s",
)

_TWO = f"WITH {corpus('part', 'p_name', '', 'd', 's')}, {corpus('part', 'p_type', '', 'b', 'u')}, j AS (SELECT d._id, %s AS x, %s AS y FROM d JOIN b USING (_id), s, u)"
_best = _TWO % (f"{part('red', 2)} + {part('small', 2)}", f"{part('red', 1, 'b', 'u')} + {part('small', 1, 'b', 'u')}")
hits("multi_match_best", "part", {"multi_match": {"query": "red small", "fields": ["p_name^2", "p_type"]}}, _best + " SELECT _id, round(greatest(x, y), 6) AS score FROM j WHERE greatest(x, y) > 0")
hits("multi_match_most", "part", {"multi_match": {"query": "red small", "fields": ["p_name^2", "p_type"], "type": "most_fields"}}, _best + " SELECT _id, round(x + y, 6) AS score FROM j WHERE x + y > 0")
hits("multi_match_phrase", "part", {"multi_match": {"query": "red plate", "fields": ["p_name", "p_type"], "type": "phrase"}}, f"WITH {NAME} SELECT _id, round({bm25('red')} * 2, 6) AS score FROM d, s WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' red plate ')")
hits("query_string", "part", {"query_string": {"query": 'hot AND "ring"', "default_operator": "and", "default_field": "p_name"}}, f"WITH {NAME} SELECT _id, round({bm25('hot')} + {bm25('ring')}, 6) AS score FROM d, s WHERE {has('hot')} AND {has('ring')}")
hits("simple_query_string", "part", {"simple_query_string": {"query": "hot+gizmo", "fields": ["p_name^0.5"]}}, f"WITH {NAME} SELECT _id, round({part('hot', 0.5)} + {part('gizmo', 0.5)}, 6) AS score FROM d, s WHERE {has('hot')} OR {has('gizmo')}")

# --- exact values

hits("match_all", "nation", {"match_all": {"boost": 1.5}}, constant("nation", "true", "1.5"))
hits("match_none", "nation", {"match_none": {}}, constant("nation", "false"))
hits("term_keyword", "customer", {"term": {"c_mktsegment.keyword": {"value": "BUILDING", "boost": 2}}}, constant("customer", "c_mktsegment = 'BUILDING'", "2.0"))
hits("term_keyword_casefold", "customer", {"term": {"c_mktsegment.keyword": "Building"}}, constant("customer", "c_mktsegment = 'BUILDING'"))
hits("term_text", "documents", {"term": {"text": "Thé"}}, f"WITH {DOC} SELECT _id, CAST(1.0 AS DOUBLE) AS score FROM d WHERE {has('the')}")
hits("term_number", "part", {"term": {"p_size": 11}}, constant("part", "p_size = 11"))
hits("term_date", "orders", {"term": {"o_orderdate": "1997-05-28"}}, constant("orders", "o_orderdate = TIMESTAMP '1997-05-28'"))
hits("terms", "events", {"terms": {"event_type.keyword": ["click", "view"]}}, constant("events", "event_type IN ('click', 'view')"))
hits("range_number", "part", {"range": {"p_retailprice": {"gte": 905, "lt": "915.5", "boost": 3}}}, constant("part", "p_retailprice >= 905 AND p_retailprice < 915.5", "3.0"))
hits("range_date", "orders", {"range": {"o_orderdate": {"gt": "1996-12-31", "lte": "1997-06-30 00:00:00"}}}, constant("orders", "o_orderdate > TIMESTAMP '1996-12-31' AND o_orderdate <= TIMESTAMP '1997-06-30'"))
hits("range_string", "part", {"range": {"p_name": {"gte": "hot", "lt": "new"}}}, constant("part", "p_name >= 'hot' AND p_name < 'new'"))
hits("prefix", "part", {"prefix": {"p_name": "GI"}}, f"WITH {NAME} SELECT _id, CAST(1.0 AS DOUBLE) AS score FROM d WHERE len(list_filter(t, lambda x: starts_with(x, 'gi'))) > 0")
hits("prefix_keyword", "part", {"prefix": {"p_brand.keyword": {"value": "brand#1", "boost": 2}}}, constant("part", "starts_with(lower(p_brand), 'brand#1')", "2.0"))
hits("wildcard", "part", {"wildcard": {"p_brand.keyword": {"value": "*#?2"}}}, constant("part", "p_brand LIKE '%#_2'"))
hits("wildcard_text", "part", {"wildcard": {"p_name": "w?d*t"}}, f"WITH {NAME} SELECT _id, CAST(1.0 AS DOUBLE) AS score FROM d WHERE len(list_filter(t, lambda x: x LIKE 'w_d%t')) > 0")
hits("ids", "customer", {"ids": {"values": ["1", 7, "999999"]}}, constant("customer", "c_custkey IN (1, 7, 999999)"))


def _exists(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels"), "doc_id", "left").withColumn("marks", F.struct("quality", "toxic"))
    e = Engine(spark)
    e.register("labelled", docs.select("doc_id", "lang", "marks"), "doc_id")
    return scored(e.search("labelled", {"query": {"exists": {"field": "marks"}}, "size": -1, "_source": False}))


add("exists", _exists, "SELECT CAST(d.doc_id AS VARCHAR) AS _id, CAST(1.0 AS DOUBLE) AS score FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL OR l.toxic IS NOT NULL")

# --- compounds

FULL = {"bool": {"must": [{"match": {"text": "with"}}], "filter": [{"terms": {"lang.keyword": ["en", "fr"]}}, {"range": {"n_chars": {"gte": 200}}}], "should": [{"match": {"text": "the"}}, {"term": {"source.keyword": "src3"}}], "must_not": [{"range": {"n_chars": {"gt": 8000}}}], "boost": 2}}

hits(
    "bool_full",
    "documents",
    FULL,
    f"WITH {corpus('documents', 'text', ', lang, source, n_chars')} SELECT _id, round(({bm25('with')} + {part('the')} + CASE WHEN source = 'src3' THEN 1 ELSE 0 END) * 2, 6) AS score FROM d, s WHERE {has('with')} AND lang IN ('en', 'fr') AND n_chars >= 200 AND n_chars <= 8000",
)
hits(
    "bool_msm",
    "orders",
    {"bool": {"should": [{"term": {"o_orderstatus.keyword": "P"}}, {"range": {"o_totalprice": {"gt": 200000}}}, {"prefix": {"o_orderpriority.keyword": "1"}}], "minimum_should_match": "2"}},
    "SELECT _id, CAST(c AS DOUBLE) AS score FROM (SELECT CAST(o_orderkey AS VARCHAR) AS _id, CAST(o_orderstatus = 'P' AS INT) + CAST(o_totalprice > 200000 AS INT) + CAST(starts_with(o_orderpriority, '1') AS INT) AS c FROM orders) WHERE c >= 2",
)
hits("bool_must_not_only", "orders", {"bool": {"must_not": [{"term": {"o_orderstatus.keyword": "F"}}, {"range": {"o_totalprice": {"lt": 100000}}}]}}, constant("orders", "o_orderstatus <> 'F' AND o_totalprice >= 100000", "0.0"))
hits("bool_filter_only", "orders", {"bool": {"filter": {"range": {"o_totalprice": {"gte": 400000}}}}}, constant("orders", "o_totalprice >= 400000", "0.0"))
hits("constant_score", "part", {"constant_score": {"filter": {"match": {"p_name": "red"}}, "boost": 1.25}}, f"WITH {NAME} SELECT _id, CAST(1.25 AS DOUBLE) AS score FROM d WHERE {has('red')}")
_DIS = f"WITH {NAME}, j AS (SELECT _id, {part('red')} AS x, {part('ring')} AS y FROM d, s)"
hits("dis_max_tie", "part", {"dis_max": {"queries": [{"match": {"p_name": "red"}}, {"match": {"p_name": "ring"}}], "tie_breaker": 0.3}}, _DIS + " SELECT _id, round(greatest(x, y) + 0.3 * ((x + y) - greatest(x, y)), 6) AS score FROM j WHERE greatest(x, y) > 0")
hits(
    "function_score_weight",
    "part",
    {"function_score": {"query": {"match": {"p_name": "red"}}, "functions": [{"filter": {"range": {"p_size": {"gte": 25}}}, "weight": 10}, {"weight": 2}]}},
    f"WITH {corpus('part', 'p_name', ', p_size')} SELECT _id, round({bm25('red')} * (CASE WHEN p_size >= 25 THEN 10 ELSE 1 END * 2), 6) AS score FROM d, s WHERE {has('red')}",
)
_FVF = {
    "none": "x", "log": "log10(greatest(x, 1e-9))", "log1p": "log10(x + 1)", "log2p": "log10(x + 2)", "ln": "ln(greatest(x, 1e-9))", "ln1p": "ln(1 + x)",
    "ln2p": "ln(x + 2)", "square": "x * x", "sqrt": "sqrt(greatest(x, 0))", "reciprocal": "CASE WHEN x <> 0 THEN 1 / x ELSE x END",
}
for _m, _sql in _FVF.items():
    hits(f"field_value_factor_{_m}", "documents", {"function_score": {"query": {"match_all": {}}, "field_value_factor": {"field": "n_chars", "factor": 1.5, "missing": 1, "modifier": _m}}}, f"SELECT _id, round({_sql}, 6) AS score FROM (SELECT CAST(doc_id AS VARCHAR) AS _id, coalesce(CAST(n_chars AS DOUBLE), 1) * 1.5 AS x FROM documents) WHERE ({_sql}) >= 0")
for _m, _sql in {"sum": "2 + f", "replace": "f", "max": "greatest(2, f)", "min": "least(2, f)", "avg": "(2 + f) / 2", "multiply": "2 * f"}.items():
    hits(f"boost_mode_{_m}", "part", {"function_score": {"query": {"match_all": {"boost": 2}}, "field_value_factor": {"field": "p_size", "factor": 0.1}, "boost_mode": _m}}, f"SELECT _id, round({_sql}, 6) AS score FROM (SELECT CAST(p_partkey AS VARCHAR) AS _id, CAST(p_size AS DOUBLE) * 0.1 AS f FROM part)")


def orders_with_lines(spark: SparkSession, d: str) -> Engine:
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"), F.col("l_linenumber").alias("no"))).alias("lines"))
    orders = read(spark, d, "orders")
    e = Engine(spark)
    e.register("baskets", orders.join(lines, orders["o_orderkey"] == lines["k"], "left").drop("k"), "o_orderkey")
    return e


def _nested(spark: SparkSession, d: str) -> DataFrame:
    q = {"nested": {"path": "lines", "query": {"bool": {"filter": [{"term": {"lines.flag.keyword": "R"}}, {"range": {"lines.qty": {"gte": 49}}}]}}}}
    return scored(orders_with_lines(spark, d).search("baskets", {"query": q, "size": -1, "_source": False}))


add("nested_flat", _nested, "SELECT CAST(l_orderkey AS VARCHAR) AS _id, CAST(0.0 AS DOUBLE) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'R') AND bool_or(l_quantity >= 49)")

# --- pipeline


def _post_filter(spark: SparkSession, d: str) -> DataFrame:
    r = engine(spark, d, "orders").search("orders", {"query": {"range": {"o_totalprice": {"gte": 300000}}}, "post_filter": {"term": {"o_orderstatus.keyword": "O"}}, "aggs": {"s": {"terms": {"field": "o_orderstatus.keyword"}}}, "size": -1})
    n = r.matched.agg(F.count(F.lit(1)).alias("total"))
    return r.aggs["s"].crossJoin(F.broadcast(n))  # a row of one count


add("post_filter", _post_filter, "SELECT o_orderstatus AS key, count(*) AS doc_count, (SELECT count(*) FROM orders WHERE o_totalprice >= 300000 AND o_orderstatus = 'O') AS total FROM orders WHERE o_totalprice >= 300000 GROUP BY 1")
hits("min_score", "part", {"match": {"p_name": "red ring"}}, _DIS + " SELECT _id, round(x + y, 6) AS score FROM j WHERE x + y >= 2.5", min_score=2.5)
add("count", lambda spark, d: engine(spark, d, "orders").count("orders", {"query": {"range": {"o_totalprice": {"lt": 150000}}}}), "SELECT count(*) AS count FROM orders WHERE o_totalprice < 150000")
add("paging", lambda spark, d: engine(spark, d, "orders").search("orders", {"sort": [{"o_totalprice": "desc"}], "from": 20, "size": 15}).hits.select("_id", "o_totalprice"), "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice FROM orders ORDER BY o_totalprice DESC, _id LIMIT 15 OFFSET 20")
add("max_score", lambda spark, d: engine(spark, d, "part").search("part", {"query": {"match": {"p_name": "red ring"}}}).matched.agg(F.round(F.max("_score"), 6).alias("max_score"), F.count(F.lit(1)).alias("total")), _DIS + " SELECT round(max(x + y), 6) AS max_score, count(*) AS total FROM j WHERE x + y > 0")


def _ranked(df: DataFrame) -> DataFrame:
    """The order of a page as a column."""
    rows = df.agg(F.collect_list(F.struct("_id", "sort")).alias("x"))
    return rows.select(F.posexplode("x").alias("rank", "r")).select("rank", "r._id")


add("sort_multi", lambda spark, d: _ranked(engine(spark, d, "orders").search("orders", {"sort": ["o_orderpriority.keyword", {"o_orderdate": {"order": "desc"}}], "size": 50}).hits.select("_id", "sort")), "SELECT CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderdate DESC, _id) - 1 AS INTEGER) AS rank, _id FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS _id FROM orders) ORDER BY rank LIMIT 50")


def _sort_missing(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id", "left")
    e = Engine(spark)
    e.register("labelled", docs, "doc_id")
    return _ranked(e.search("labelled", {"sort": [{"quality": {"order": "desc", "missing": "_first"}}, {"toxic": "asc"}], "size": 100}).hits.select("_id", "sort"))


add("sort_missing", _sort_missing, "SELECT CAST(row_number() OVER (ORDER BY quality DESC NULLS FIRST, toxic NULLS LAST, _id) - 1 AS INTEGER) AS rank, _id FROM (SELECT CAST(doc_id AS VARCHAR) AS _id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)) ORDER BY rank LIMIT 100")
add("sort_multivalue", lambda spark, d: _ranked(orders_with_lines(spark, d).search("baskets", {"sort": [{"lines.qty": "desc"}], "size": 60}).hits.select("_id", "sort")), "SELECT CAST(row_number() OVER (ORDER BY q DESC NULLS LAST, _id) - 1 AS INTEGER) AS rank, _id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS _id, max(l_quantity) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) ORDER BY rank LIMIT 60")
add("source_filter", lambda spark, d: engine(spark, d, "customer").search("customer", {"size": -1, "_source": {"includes": ["c_*"], "excludes": ["c_acct*", "c_nationkey"]}}).hits.drop("_index", "_score"), "SELECT CAST(c_custkey AS VARCHAR) AS _id, c_custkey, c_name, c_mktsegment FROM customer")
add(
    "highlight",
    lambda spark, d: engine(spark, d, "part").search("part", {"query": {"match": {"p_name": "red ring"}}, "highlight": {"fields": {"p_name": {}}}, "size": -1}).hits.select("_id", F.col("highlight")["p_name"][0].alias("marked")),
    r"SELECT CAST(p_partkey AS VARCHAR) AS _id, regexp_replace(p_name, '\b(red|ring)\b', '<em>\1</em>', 'g') AS marked FROM part WHERE regexp_matches(p_name, '\b(red|ring)\b')",
)

# --- aggregations

agg("agg_terms", "events", {"t": {"terms": {"field": "event_type.keyword", "size": 3}}}, "SELECT event_type AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3", "t")
agg("agg_terms_key_order", "part", {"t": {"terms": {"field": "p_size", "size": 7, "order": {"_key": "asc"}}}}, "SELECT CAST(p_size AS VARCHAR) AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 1 LIMIT 7", "t")
agg("agg_terms_count_asc", "part", {"t": {"terms": {"field": "p_brand.keyword", "size": 5, "order": {"_count": "asc"}}}}, "SELECT p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 5", "t")


def _terms_other(spark: SparkSession, d: str) -> DataFrame:
    return engine(spark, d, "part").search("part", {"aggs": {"t": {"terms": {"field": "p_brand.keyword", "size": 5}}}, "size": 0}).others["t"]


add("agg_terms_other", _terms_other, "WITH b AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY 1) SELECT CAST(sum(n) FILTER (WHERE r > 5) AS BIGINT) AS sum_other_doc_count FROM b")
add("agg_terms_multivalue", lambda spark, d: orders_with_lines(spark, d).search("baskets", {"aggs": {"f": {"terms": {"field": "lines.flag"}, "aggs": {"q": {"sum": {"field": "lines.qty"}}, "n": {"value_count": {"field": "lines.no"}}, "c": {"cardinality": {"field": "lines.qty"}}}}}, "size": 0}).aggs["f"], "WITH o AS (SELECT l.* FROM lineitem l JOIN orders ON o_orderkey = l_orderkey), k AS (SELECT DISTINCT l_orderkey, l_returnflag FROM o) SELECT k.l_returnflag AS key, count(DISTINCT k.l_orderkey) AS doc_count, sum(l_quantity) AS q, count(l_linenumber) AS n, count(DISTINCT l_quantity) AS c FROM k JOIN o ON o.l_orderkey = k.l_orderkey GROUP BY 1")
agg("agg_filter", "events", {"f": {"filter": {"range": {"value": {"gte": 50}}}, "aggs": {"m": {"max": {"field": "value"}}}}}, "SELECT 'filter' AS key, count(*) AS doc_count, max(value) AS m FROM events WHERE value >= 50", "f")
agg("agg_filters", "events", {"f": {"filters": {"filters": {"clicks": {"term": {"event_type.keyword": "click"}}, "high": {"range": {"value": {"gt": 90}}}, "none": {"match_none": {}}}}, "aggs": {"a": {"min": {"field": "value"}}}}}, "SELECT 'clicks' AS key, count(*) AS doc_count, min(value) AS a FROM events WHERE event_type = 'click' UNION ALL SELECT 'high', count(*), min(value) FROM events WHERE value > 90 UNION ALL SELECT 'none', count(*), min(value) FROM events WHERE false", "f")
agg("agg_range", "events", {"r": {"range": {"field": "value", "ranges": [{"to": 10}, {"from": 10, "to": 25.5}, {"key": "top", "from": 20}, {"from": 1e6}]}}}, "SELECT '*-10.0' AS key, CAST(NULL AS DOUBLE) AS \"from\", CAST(10 AS DOUBLE) AS \"to\", count(*) AS doc_count FROM events WHERE value < 10 UNION ALL SELECT '10.0-25.5', 10, 25.5, count(*) FROM events WHERE value >= 10 AND value < 25.5 UNION ALL SELECT 'top', 20, NULL, count(*) FROM events WHERE value >= 20 UNION ALL SELECT '1000000.0-*', 1000000, NULL, count(*) FROM events WHERE value >= 1000000", "r")
agg("agg_histogram", "events", {"h": {"histogram": {"field": "value", "interval": 12.5}, "aggs": {"s": {"sum": {"field": "value"}}}}}, "SELECT floor(value / 12.5) * 12.5 AS key, count(*) AS doc_count, round(sum(value), 4) AS s FROM events WHERE value IS NOT NULL GROUP BY 1", "h", lambda x: x.withColumn("s", F.round("s", 4)))
for _u in ("year", "month", "week", "day", "hour", "minute"):
    _t = "orders" if _u in ("year", "month", "week") else "events"
    _c = "o_orderdate" if _t == "orders" else "ts"
    agg(f"agg_date_histogram_{_u}", _t, {"d": {"date_histogram": {"field": _c, "calendar_interval": _u}}}, f"SELECT epoch_ms(date_trunc('{_u}', {_c})) AS key, strftime(date_trunc('{_u}', {_c}), '%Y-%m-%dT%H:%M:%S.000Z') AS key_as_string, count(*) AS doc_count FROM {_t} WHERE {_c} IS NOT NULL GROUP BY 1, 2", "d")
agg("agg_global", "events", {"g": {"global": {}, "aggs": {"a": {"avg": {"field": "value"}}}}}, "SELECT 'global' AS key, count(*) AS doc_count, round(avg(value), 6) AS a FROM events", "g", lambda x: x.withColumn("a", F.round("a", 6)), {"term": {"event_type.keyword": "click"}})
agg(
    "agg_nested",
    "events",
    {"t": {"terms": {"field": "event_type.keyword", "size": 3}, "aggs": {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"v": {"stats": {"field": "value"}}}}}}},
    "WITH k AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 3) SELECT event_type AS t, epoch_ms(date_trunc('day', ts)) AS key, count(*) AS doc_count, count(value) AS n, min(value) AS low, max(value) AS high, round(sum(value), 4) AS total FROM events WHERE event_type IN (SELECT event_type FROM k) GROUP BY 1, 2",
    "t>d",
    lambda x: x.select("t", "key", "doc_count", F.col("v.count").alias("n"), F.col("v.min").alias("low"), F.col("v.max").alias("high"), F.round("v.sum", 4).alias("total")),
)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"low": "min", "high": "max", "mean": "avg", "total": "sum", "n": "value_count", "kinds": "cardinality", "all": "stats"}
    e = Engine(spark)
    e.register("lines", read(spark, d, "lineitem"), "l_orderkey")
    r = e.search("lines", {"aggs": {"f": {"terms": {"field": "l_returnflag.keyword"}, "aggs": {n: {k: {"field": "l_quantity" if k != "sum" else "l_extendedprice"}} for n, k in kinds.items()}}}, "size": 0})
    return r.aggs["f"].select("key", "doc_count", "low", "high", F.round("mean", 6).alias("mean"), F.round("total", 2).alias("total"), "n", "kinds", F.col("all.count").alias("count"), F.col("all.sum").alias("quantity"))


add("agg_metrics", _metrics, "SELECT l_returnflag AS key, count(*) AS doc_count, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 6) AS mean, round(sum(l_extendedprice), 2) AS total, count(l_quantity) AS n, count(DISTINCT l_quantity) AS kinds, count(l_quantity) AS count, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1")

# --- analysis, several tables, writes


def _analyze(spark: SparkSession, d: str) -> DataFrame:
    from .functions.analysis import tokens

    return read(spark, d, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("position", "token"))


add("analyze", _analyze, f"SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS position, unnest(t) AS token FROM (SELECT doc_id, {tok('text')} AS t FROM documents)")


add("term_dictionary", lambda spark, d: text_postings(spark, d).dictionary(), f"WITH {DOC} SELECT term, count(*) AS doc_freq FROM (SELECT DISTINCT _id, unnest(t) AS term FROM d) GROUP BY term")


_BUILT: dict[tuple[str, str, str, str], str] = {}


def posted(spark: SparkSession, d: str, table: str, field: str) -> Engine:
    """An engine with the inverted index of a text field of a whole table, built once a session, in the folder that executors share."""
    e = engine(spark, d, table)
    key = (spark.sparkContext.applicationId, d, table, field)
    known = key in _BUILT
    if not known:
        _BUILT[key] = f"{shared_dir(spark).rstrip('/')}/postings-{uuid.uuid4().hex}"
    e.attach(table, field, _BUILT[key], build=not known)
    return e


def text_postings(spark: SparkSession, d: str) -> postings.Postings:
    return posted(spark, d, "documents", "text").indices["documents"].lists["text"]


def listed(name: str, like: str, table: str, field: str, query: dict, **body) -> None:
    """The query `like` again, answered from the inverted index."""
    add(name, lambda spark, d: scored(posted(spark, d, table, field).search(table, {"query": query, "size": -1, "_source": False} | body)), ORACLES[like])


add("postings_match", lambda spark, d: text_postings(spark, d).match("with the").select("_id", F.round("score", 6).alias("score")), ORACLES["match_or"])
add("postings_scan", lambda spark, d: text_postings(spark, d).docs("with").select("_id", "freq", "len", F.array_join("pos", ",").alias("pos")), f"WITH {DOC}, p AS (SELECT _id, len(t) AS n, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM d) SELECT _id, CAST(count(*) AS INTEGER) AS freq, CAST(any_value(n) AS INTEGER) AS len, string_agg(i, ',' ORDER BY i) AS pos FROM p WHERE w = 'with' GROUP BY _id")
add("doc_freq", lambda spark, d: text_postings(spark, d).doc_freq("with"), f"WITH {DOC} SELECT count(*) AS doc_freq FROM d WHERE {has('with')}")
listed("posted_match_or", "match_or", "documents", "text", {"match": {"text": "with the"}})
listed("posted_match_and", "match_and", "documents", "text", {"match": {"text": {"query": "of The and", "operator": "and", "boost": 2}}})
listed("posted_top", "search_top", "documents", "text", TOP["query"], size=10)
listed("posted_fuzzy", "match_fuzzy", "part", "p_name", {"match": {"p_name": {"query": "widgt", "fuzziness": "AUTO"}}})
listed("posted_phrase", "match_phrase", "documents", "text", {"match_phrase": {"text": "of the"}})
listed("posted_phrase_prefix", "match_phrase_prefix", "documents", "text", {"match_phrase_prefix": {"text": "of th"}})
listed("posted_phrase_slop", "match_phrase_slop", "documents", "text", {"match_phrase": {"text": {"query": "that with", "slop": 3}}})
listed("posted_term", "term_text", "documents", "text", {"term": {"text": "Thé"}})
listed("posted_prefix", "prefix", "part", "p_name", {"prefix": {"p_name": "GI"}})
listed("posted_wildcard", "wildcard_text", "part", "p_name", {"wildcard": {"p_name": "w?d*t"}})
listed("posted_dis_max", "dis_max_tie", "part", "p_name", {"dis_max": {"queries": [{"match": {"p_name": "red"}}, {"match": {"p_name": "ring"}}], "tie_breaker": 0.3}})
listed("posted_bool", "bool_full", "documents", "text", FULL)
add("field_stats", lambda spark, d: text_postings(spark, d).field_stats().select("n_docs", F.round("mean_len", 6).alias("mean_len")), f"WITH {DOC} SELECT n AS n_docs, round(l / n, 6) AS mean_len FROM s")


def _multi_index(spark: SparkSession, d: str) -> DataFrame:
    r = engine(spark, d, "documents", "benchmark", "part").search("doc*,bench???k,missing", {"query": {"match": {"text": "with"}}, "size": -1, "_source": False})
    return r.hits.select("_index", "_id", F.round("_score", 6).alias("score"))


add("multi_index", _multi_index, f"WITH {DOC}, {corpus('benchmark', 'text', '', 'b', 'u')} SELECT 'documents' AS _index, _id, round({bm25('with')}, 6) AS score FROM d, s WHERE {has('with')} UNION ALL SELECT 'benchmark', _id, round({bm25('with', 1.0, 'b', 'u')}, 6) FROM b, u WHERE {has('with', 'b')}")
add("cat_indices", lambda spark, d: engine(spark, d, "orders", "part").cat_indices(), "SELECT 'orders' AS _index, count(*) AS docs FROM orders UNION ALL SELECT 'part', count(*) FROM part")
add("stats", lambda spark, d: engine(spark, d, "orders", "part").stats(), "SELECT 'orders' AS _index, count(*) AS docs FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT '_all', (SELECT count(*) FROM orders) + (SELECT count(*) FROM part)")


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as a log: errors delete their user's document, others put one."""
    e = read(spark, d, "events")
    return e.select(F.lit("users").alias("_index"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("id"), F.when(F.col("event_type") != "error", F.col("props")).alias("src"))


add(
    "bulk_lww",
    lambda spark, d: oplog.latest(event_log(spark, d)).select("_id", "_version", "_seq_no", "_source"),
    "WITH g AS (SELECT user_id, max(event_id) AS last, coalesce(max(event_id) FILTER (WHERE event_type = 'error'), -1) AS gone FROM events GROUP BY 1) SELECT CAST(g.user_id AS VARCHAR) AS _id, count(*) AS _version, max(event_id) AS _seq_no, max_by(props, event_id) AS _source FROM g JOIN events e ON e.user_id = g.user_id AND e.event_id > g.gone WHERE g.last > g.gone GROUP BY 1",
)


def _update_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events as partial updates of their user's document: each type sets its own key."""
    e = read(spark, d, "events")
    doc = F.concat(F.lit('{"seen":{"'), "event_type", F.lit('":'), F.col("event_id").cast("string"), F.lit("}}"))
    ops = e.select(F.lit("users").alias("_index"), F.col("event_id").alias("seq"), F.lit("update").alias("op"), F.col("user_id").cast("string").alias("id"), doc.alias("doc"), doc.alias("upsert"))
    state = oplog.after(None, oplog.apply_operations(None, ops))
    return state.select("_id", "_version", *[F.get_json_object("_source", f"$.seen.{t}").cast("long").alias(t) for t in ("click", "error", "purchase", "signup", "view")])


add("update_merge", _update_merge, "SELECT CAST(user_id AS VARCHAR) AS _id, count(*) AS _version, max(event_id) FILTER (WHERE event_type = 'click') AS click, max(event_id) FILTER (WHERE event_type = 'error') AS error, max(event_id) FILTER (WHERE event_type = 'purchase') AS purchase, max(event_id) FILTER (WHERE event_type = 'signup') AS signup, max(event_id) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY user_id")


def _delete_by_query(spark: SparkSession, d: str) -> DataFrame:
    e = engine(spark, d, "orders")
    e.delete_by_query("orders", {"query": {"range": {"o_totalprice": {"lt": 250000}}}})
    return e.search("orders", {"size": -1}).hits.select("_id", "o_totalprice")


add("delete_by_query", _delete_by_query, "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_totalprice FROM orders WHERE o_totalprice >= 250000")
add("mget", lambda spark, d: engine(spark, d, "nation", "region").mget("nation", [{"_id": "3"}, {"_index": "region", "_id": "1"}, {"_index": "nowhere", "_id": "1"}], ["99", "3"]).select("position", "_index", "_id", "found"), "SELECT * FROM (VALUES (0, 'nation', '3', true), (1, 'region', '1', true), (2, 'nowhere', '1', false), (3, 'nation', '99', false), (4, 'nation', '3', true)) v(position, _index, _id, found)")
add("get", lambda spark, d: engine(spark, d, "customer").get("customer", "17").drop("_id"), "SELECT * FROM customer WHERE c_custkey = 17")


# --- the surface: files, logs, single documents, names, answers


def lines_of(df: DataFrame, order: str, line, to: str, files: int) -> None:
    """Text files whose names are in the order of a column."""
    df.repartitionByRange(files, order).sortWithinPartitions(order).select(line.alias("value")).write.mode("overwrite").text(to)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _bulk_ndjson(spark: SparkSession, d: str) -> DataFrame:
    """All events as bulk files: each is indexed under its user's id, errors delete it; then the documents that are left."""
    e, to = read(spark, d, "events"), _folder(spark, "bulk")
    meta = F.concat(F.lit('{"_index":"users","_id":"'), F.col("user_id").cast("string"), F.lit('"}'))
    doc = F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit('"}'))
    put = F.concat(F.lit('{"index":'), meta, F.lit("}\n"), doc)
    lines_of(e, "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit('{"delete":'), meta, F.lit("}"))).otherwise(put), to, 5)
    ops = oplog.sequence(oplog.read_bulk(spark, to))
    state = oplog.after(None, oplog.apply_operations(None, ops))
    return state.select("_id", "_version", F.get_json_object("_source", "$.event").cast("long").alias("event"), F.get_json_object("_source", "$.type").alias("type"))


_LAST = "WITH g AS (SELECT user_id, max(event_id) AS last, coalesce(max(event_id) FILTER (WHERE event_type = 'error'), -1) AS gone FROM events GROUP BY 1), h AS (SELECT g.user_id, count(*) AS v, max(event_id) AS e, max_by(event_type, event_id) AS t, max_by(props, event_id) AS p FROM g JOIN events x ON x.user_id = g.user_id AND x.event_id > g.gone GROUP BY 1)"
add("bulk_ndjson", _bulk_ndjson, _LAST + " SELECT CAST(user_id AS VARCHAR) AS _id, v AS _version, e AS event, t AS type FROM h")


def _json_log(spark: SparkSession, d: str) -> DataFrame:
    """All events as a log of JSON lines in several files of unlike sizes, replayed."""
    e, to = read(spark, d, "events"), _folder(spark, "log")
    line = F.to_json(F.struct(F.when(F.col("event_type") == "error", "del").otherwise("put").alias("op"), F.col("user_id").cast("string").alias("id"), F.struct(F.col("event_id").alias("event")).alias("src")))
    n = F.pmod(F.col("event_id"), F.lit(7))
    lines_of(e.withColumn("line", F.when(n == 3, F.concat(F.lit("not json\n"), line)).otherwise(line)), "event_id", F.col("line"), to, 6)
    return oplog.latest(oplog.read_json_log(spark, to, "users")).select("_id", "_version", F.get_json_object("_source", "$.event").cast("long").alias("event"))


add("json_log_replay", _json_log, _LAST + " SELECT CAST(user_id AS VARCHAR) AS _id, v AS _version, e AS event FROM h")


def json_nations(spark: SparkSession, d: str) -> Engine:
    """All nations as JSON documents."""
    e = Engine(spark)
    n = read(spark, d, "nation")
    e.ingest("nations", n.select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("index").alias("op"), F.col("n_nationkey").cast("string").alias("id"), F.to_json(F.struct("n_name", "n_regionkey")).alias("doc")))
    return e


def _saved(spark: SparkSession, d: str) -> DataFrame:
    e, to = json_nations(spark, d), _folder(spark, "store")
    e.remove("nations", "3")
    e.save(to)
    again = Engine(spark)
    again.load(to, ["nations"])
    return again.search("nations", {"query": {"range": {"n_regionkey": {"gte": 1}}}, "size": -1}).hits.select("_id", F.get_json_object("_source", "$.n_name").alias("name"))


add("save_load", _saved, "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name AS name FROM nation WHERE n_regionkey >= 1 AND n_nationkey <> 3")


def _single_puts(spark: SparkSession, d: str) -> DataFrame:
    """Single writes over all nations: one put, one create that conflicts, one without an id, an update and a delete."""
    e = json_nations(spark, d)
    e.put("nations", "100", {"n_name": "NOWHERE", "n_regionkey": 9})
    e.put("nations", "0", {"n_name": "CLASH"}, create=True)
    e.put("nations", None, {"n_name": "NEW", "n_regionkey": 9})
    e.update("nations", "1", {"n_regionkey": 9})
    e.remove("nations", "2")
    hits = e.search("nations", {"size": -1}).hits
    return hits.select(F.when(F.col("_id").startswith("ls-"), "auto").otherwise(F.col("_id")).alias("_id"), F.get_json_object("_source", "$.n_name").alias("name"), F.get_json_object("_source", "$.n_regionkey").cast("long").alias("region"))


add("single_writes", _single_puts, "SELECT CAST(n_nationkey AS VARCHAR) AS _id, n_name AS name, CASE WHEN n_nationkey = 1 THEN 9 ELSE CAST(n_regionkey AS BIGINT) END AS region FROM nation WHERE n_nationkey <> 2 UNION ALL VALUES ('100', 'NOWHERE', CAST(9 AS BIGINT)), ('auto', 'NEW', 9)")


def rows_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _bulk_items(spark: SparkSession, d: str) -> DataFrame:
    body = '{"index":{"_id":"1"}}\n{"a":1}\n{"create":{"_id":"1"}}\n{"a":2}\n{"update":{"_id":"1"}}\n{"doc":{"b":2}}\n{"update":{"_id":"5"}}\n{"doc":{"b":2}}\n{"delete":{"_id":"1"}}\n{"delete":{"_id":"1"}}\n{"index":{"_id":"2"}}\nbroken\n'
    return Engine(spark).bulk(body, "x").select("seq", "op", "_id", "status", "result", "error")


add("bulk_items", _bulk_items, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'index', '1', 201, 'created', NULL), (1, 'create', '1', 409, NULL, 'version_conflict_engine_exception'), (2, 'update', '1', 200, 'updated', NULL), (3, 'update', '5', 404, NULL, 'document_missing_exception'), (4, 'delete', '1', 200, 'deleted', NULL), (5, 'delete', '1', 404, 'not_found', NULL), (6, 'index', '2', 400, NULL, 'mapper_parsing_exception')) t(seq, op, _id, status, result, error)")


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    """The mapping that all nations infer, one field declared before and one added later."""
    e = Engine(spark)
    e.create("nations", {"properties": {"n_name": {"type": "keyword"}}})
    n = read(spark, d, "nation")
    e.ingest("nations", n.select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("index").alias("op"), F.col("n_nationkey").cast("string").alias("id"), F.to_json(F.struct("n_name", "n_regionkey", F.lit("2024-01-01").alias("since"), F.struct(F.lit("x").alias("y")).alias("o"))).alias("doc")))
    e.put_mapping("nations", {"properties": {"later": {"type": "double"}}})
    return rows_of(spark, sorted(e.indices["nations"].types.items()), "path string, type string")


add("mapping", _mapping, "SELECT * FROM (VALUES ('later', 'double'), ('n_name', 'keyword'), ('n_regionkey', 'long'), ('o.y', 'text'), ('o.y.keyword', 'keyword'), ('since', 'date')) t(path, type)")


def _index_crud(spark: SparkSession, d: str) -> DataFrame:
    from .facade import Facade

    api = Facade(Engine(spark))
    calls = [("PUT", "/a"), ("PUT", "/a"), ("HEAD", "/a"), ("HEAD", "/b"), ("GET", "/a"), ("GET", "/b"), ("PUT", "/_bad"), ("GET", "/a/_settings"), ("PUT", "/a/_mapping"), ("DELETE", "/a"), ("DELETE", "/a"), ("GET", "/_cluster/health"), ("GET", "/_nodes"), ("GET", "/"), ("GET", "/_template/x"), ("HEAD", "/_template/x"), ("POST", "/_refresh"), ("GET", "/_cat/indices"), ("POST", "/a/_open"), ("GET", "/a/_alias"), ("GET", "/favicon.ico"), ("GET", "/a/_nonsense")]
    return rows_of(spark, [(i, m, p, api.request(m, p, {})[0]) for i, (m, p) in enumerate(calls)], "call int, method string, path string, status int")


add("index_crud", _index_crud, "SELECT * FROM (VALUES (0, 'PUT', '/a', 200), (1, 'PUT', '/a', 400), (2, 'HEAD', '/a', 200), (3, 'HEAD', '/b', 404), (4, 'GET', '/a', 200), (5, 'GET', '/b', 404), (6, 'PUT', '/_bad', 400), (7, 'GET', '/a/_settings', 200), (8, 'PUT', '/a/_mapping', 200), (9, 'DELETE', '/a', 200), (10, 'DELETE', '/a', 404), (11, 'GET', '/_cluster/health', 200), (12, 'GET', '/_nodes', 200), (13, 'GET', '/', 200), (14, 'GET', '/_template/x', 200), (15, 'HEAD', '/_template/x', 404), (16, 'POST', '/_refresh', 200), (17, 'GET', '/_cat/indices', 200), (18, 'POST', '/a/_open', 200), (19, 'GET', '/a/_alias', 200), (20, 'GET', '/favicon.ico', 404), (21, 'GET', '/a/_nonsense', 400)) t(call, method, path, status)")
add("uri_params", lambda spark, d: engine(spark, d, "part").search("part", {"_source": False}, q="hot ring", size=-1, sort="p_size:desc").hits.select("_id", F.col("sort")[0]["num"].alias("size")), f"WITH {corpus('part', 'p_name', ', p_size')} SELECT _id, CAST(p_size AS DOUBLE) AS size FROM d WHERE {has('hot')} OR {has('ring')}")
add("sort_values", lambda spark, d: engine(spark, d, "orders").search("orders", {"sort": ["o_orderpriority.keyword", {"o_totalprice": "desc"}, "o_orderdate"], "size": -1, "_source": False}).hits.select("_id", F.col("sort")[0]["str"].alias("priority"), F.col("sort")[1]["num"].alias("price"), F.col("sort")[2]["num"].alias("at")), "SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderpriority AS priority, o_totalprice AS price, CAST(epoch_ms(o_orderdate) AS DOUBLE) AS at FROM orders")


def _response(spark: SparkSession, d: str) -> DataFrame:
    """The answer of a search request as the facade gives it: a page of hits, total, greatest score and buckets."""
    from .facade import Facade

    body = {"query": {"match": {"p_name": "red ring"}}, "size": 5, "aggs": {"b": {"terms": {"field": "p_brand.keyword", "size": 3}}}}
    _, r = Facade(engine(spark, d, "part")).request("POST", "/part/_search", body)
    hits = [("hit", h["_id"], round(h["_score"], 6)) for h in r["hits"]["hits"]]
    more = [("total", "", float(r["hits"]["total"]["value"])), ("max", "", round(r["hits"]["max_score"], 6)), ("other", "", float(r["aggregations"]["b"]["sum_other_doc_count"]))]
    return rows_of(spark, hits + more + [("bucket", b["key"], float(b["doc_count"])) for b in r["aggregations"]["b"]["buckets"]], "what string, key string, value double")


add("response", _response, _DIS + """, m AS (SELECT _id, x + y AS v, p_brand FROM j JOIN part ON CAST(p_partkey AS VARCHAR) = _id WHERE x + y > 0), k AS (SELECT p_brand, count(*) AS n FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT 'hit' AS what, _id AS key, round(v, 6) AS value FROM (SELECT * FROM m ORDER BY v DESC, _id LIMIT 5) UNION ALL SELECT 'total', '', CAST(count(*) AS DOUBLE) FROM m UNION ALL SELECT 'max', '', round(max(v), 6) FROM m
UNION ALL SELECT 'bucket', p_brand, CAST(n AS DOUBLE) FROM k UNION ALL SELECT 'other', '', CAST((SELECT count(*) FROM m) - sum(n) AS DOUBLE) FROM k""")
add(
    "highlight_non_ascii",
    lambda spark, d: engine(spark, d, "documents").search("documents", {"query": {"match": {"text": "eaue que"}}, "highlight": {"fields": {"text": {}}, "pre_tags": ["["], "post_tags": ["]"]}, "size": -1, "_source": False}).hits.select("_id", F.col("highlight")["text"][0].alias("marked")),
    rf"WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS _id, text, regexp_extract_all(text, '[A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+|[^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+') AS s FROM documents), m AS (SELECT _id, text, array_to_string(list_transform(s, lambda x: CASE WHEN {norm('x')} IN ('eaue', 'que') THEN '[' || x || ']' ELSE x END), '') AS marked FROM w WHERE list_contains({tok('text')}, 'eaue') OR list_contains({tok('text')}, 'que')) SELECT _id, CASE WHEN marked <> text THEN marked END AS marked FROM m",
)
add("analyze_texts", lambda spark, d: Engine(spark).analyze(["Crème Brûlée", "2 Eggs!"]), "SELECT * FROM (VALUES ('creme', '<ALPHANUM>', 0, 0, 5), ('brulee', '<ALPHANUM>', 1, 0, 6), ('2', '<ALPHANUM>', 2, 0, 1), ('eggs', '<ALPHANUM>', 3, 0, 4)) t(token, type, position, start_offset, end_offset)")
agg(
    "agg_global_nested",
    "events",
    {"t": {"terms": {"field": "event_type.keyword", "size": 3}, "aggs": {"g": {"global": {}, "aggs": {"h": {"terms": {"field": "event_type.keyword", "size": 2}, "aggs": {"m": {"max": {"field": "value"}}}}}}}}},
    "WITH k AS (SELECT event_type AS t, count(*) AS n FROM events GROUP BY 1), a AS (SELECT t FROM k ORDER BY n DESC, t LIMIT 3), b AS (SELECT t, n FROM k ORDER BY n DESC, t LIMIT 2) SELECT a.t, b.t AS key, b.n AS doc_count, (SELECT max(value) FROM events WHERE event_type = b.t) AS m FROM a, b",
    "t>g>h",
    lambda x: x.select("t", "key", "doc_count", "m"),
    {"range": {"value": {"gte": 10}}},
)
