"""Analysis and value coercion, in the JVM and in Python alike."""

from pyspark.sql import functions as F

from lexisift.engine import Engine
from lexisift.functions import analysis as A
from lexisift.functions import values as V
from lexisift.plans.compiler import field_boost, fuzzy_distance, strip_operators
from lexisift.sources.catalog import resolve, valid_name

TEXTS = ["Caffè Espresso, 100% Arabica!", "uno due tre", "ΟΔΟΣ İstanbul", "straße caffè’s", "café", "кот/кит", "", "  ", "a_b-c", "٣ ½"]


def test_tokens(spark):
    got = [r[0] for r in spark.createDataFrame([(t,) for t in TEXTS], "t string").select(A.tokens(F.col("t"))).collect()]
    assert got == [A.py_tokens(t) for t in TEXTS]
    assert got[0] == ["caffe", "espresso", "100", "arabica"] and got[3] == ["strase", "caffe", "s"]
    assert A.py_normalize("PERÙ") == "peru"


def test_coercion(spark):
    given = ["2026-01-01", "2026-01-01 10:00:00", "2026-01-01T10:00:00Z", "2026-01-01T10:00:00+02:00", "12.50", " 1", "1d", "10:00:00", "now", "1e2", "", "2026", "-3", "2026-13-01"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    got = [r[0] for r in df.select(V.string_number(F.col("t"))).collect()]
    assert got == [V.py_number(t) for t in given]
    assert got[4] == 12.5 and got[5] is None and got[6] is None and got[8] is None and got[11] == 2026.0


def test_number_strings(spark):
    x = [12.0, 12345678.9, 0.1, -3.0, 1e-7, 2.5e10, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(V.number_string(F.col("x"))).collect()]
    assert got == ["12", "12345678.9", "0.1", "-3", "0.0000001", "25000000000", None]


def test_request_helpers():
    assert field_boost("name^2.5") == ("name", 2.5) and field_boost("name^x") == ("name^x", 1.0) and field_boost("name^0") == ("name^0", 1.0)
    assert [fuzzy_distance("AUTO", t) for t in ("ab", "abc", "abcdef", "éé")] == [0, 1, 2, 1]
    assert strip_operators('ORANGE AND "x"+y') == " ANGE    x  y"
    assert resolve("b,a*,nope", ["a1", "a2", "b", "c"]) == ["a1", "a2", "b"] and resolve("[ab]?", ["a1", "b", "c1"]) == ["a1"]
    assert valid_name("site-1") and not any(map(valid_name, ["", "-a", "_a", ".a", "a b", "a*", "x" * 256]))


def test_many_values(spark):
    rows = [(1, ["red hat", "blue"], [3.0, 1.0], [("x", 5), ("y", 1)]), (2, ["blue red"], [], []), (3, None, None, None), (4, [None, "green"], [2.0, None], [("x", None)])]
    e = Engine(spark)
    e.register("m", spark.createDataFrame(rows, "id long, tags array<string>, nums array<double>, items array<struct<sku string, qty long>>"), "id")
    find = lambda q: {r["_id"] for r in e.search("m", {"query": q, "size": -1}).hits.collect()}
    assert find({"match_phrase": {"tags": "hat blue"}}) == set() and find({"match_phrase": {"tags": {"query": "hat blue", "slop": 100}}}) == {"1"}
    assert find({"term": {"tags.keyword": "blue"}}) == {"1"} and find({"range": {"nums": {"lt": 2}}}) == {"1"}
    assert find({"exists": {"field": "items"}}) == {"1", "4"} and find({"term": {"items.qty": 5}}) == {"1"}
    assert find({"bool": {"filter": [{"term": {"items.sku": "y"}}, {"term": {"items.qty": 5}}]}}) == {"1"}
    order = lambda s: [r["_id"] for r in e.search("m", {"sort": [s], "size": -1}).hits.collect()]
    assert order({"nums": "asc"}) == ["1", "4", "2", "3"] and order({"nums": "desc"}) == ["1", "4", "2", "3"]
    assert order({"nums": {"order": "asc", "missing": "_first"}}) == ["2", "3", "1", "4"]
    aggs = e.search("m", {"aggs": {"t": {"terms": {"field": "tags.keyword"}, "aggs": {"s": {"sum": {"field": "nums"}}, "c": {"cardinality": {"field": "items.sku"}}}}, "r": {"range": {"field": "nums", "ranges": [{"from": 2}]}}}, "size": 0}).to_dict()["aggregations"]
    assert [(b["key"], b["doc_count"], b["s"]["value"], b["c"]["value"]) for b in aggs["t"]["buckets"]] == [("blue", 1, 4.0, 2), ("blue red", 1, None, 0), ("green", 1, 2.0, 1), ("red hat", 1, 4.0, 2)]
    assert aggs["r"]["buckets"][0]["doc_count"] == 2


def test_empty_table(spark):
    e = Engine(spark)
    e.register("none", spark.createDataFrame([], "id long, text string, n double"), "id")
    d = e.search("none", {"query": {"match": {"text": {"query": "abc", "fuzziness": "AUTO"}}}, "aggs": {"t": {"terms": {"field": "text"}}, "m": {"avg": {"field": "n"}}}}).to_dict()
    assert d["hits"]["total"]["value"] == 0 and d["aggregations"] == {"t": {"doc_count_error_upper_bound": 0, "sum_other_doc_count": 0, "buckets": []}, "m": {"value": None}}
