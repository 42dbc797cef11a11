"""Bulk requests, partial updates, logs, persistence and the stream of operations."""

import itertools
import json

import pyarrow as pa
import pytest

from lexisift.engine import Engine
from lexisift.sources import documents, oplog
from lexisift.streaming.ingest import stream_log

BULK = """
{"index":{"_id":"1"}}
{"title":"Harbour","stats":{"reads":7},"n":1.50}
{"create":{"_id":"1"}}
{"title":"again"}
{"update":{"_id":"1"}}
{"doc":{"stats":{"reads":8,"by":null}}}
{"update":{"_id":"9"}}
{"doc":{"a":1}}
{"update":{"_id":"2"}}
{"doc":{"a":1},"doc_as_upsert":true}
{"delete":{"_id":"7"}}
{"index":{"_id":"3"}}
{broken
{"delete":{"_id":"2"}}
{"index":{"_id":"2"}}
{"a":2}
"""


@pytest.fixture(scope="module")
def bulked(spark):
    e = Engine(spark)
    return e, e.bulk(BULK, "posts").collect()


def test_bulk_items(bulked):
    assert [(r["op"], r["_id"], r["status"], r["result"]) for r in bulked[1]] == [
        ("index", "1", 201, "created"), ("create", "1", 409, None), ("update", "1", 200, "updated"), ("update", "9", 404, None), ("update", "2", 200, "created"),
        ("delete", "7", 404, "not_found"), ("index", "3", 400, None), ("delete", "2", 200, "deleted"), ("index", "2", 201, "created"),
    ]


def test_state_after_bulk(bulked):
    e, _ = bulked
    got = {r["_id"]: (r["_version"], r["_source"]) for r in e.stores["posts"].snapshot().collect()}
    assert got == {"1": (2, '{"n":1.50,"stats":{"by":null,"reads":8},"title":"Harbour"}'), "2": (1, '{"a":2}')}
    assert e.search("posts", {"query": {"term": {"stats.reads": 8}}}).hits.collect()[0]["_id"] == "1"
    assert e.search("posts", {"query": {"exists": {"field": "stats"}}}).total == 1 and e.search("posts", {"query": {"exists": {"field": "stats.by"}}}).total == 0


def test_malformed_action_after_others(spark):
    e = Engine(spark)
    with pytest.raises(ValueError, match="malformed"):
        e.bulk('{"index":{"_index":"a","_id":"1"}}\n{"x":1}\nnonsense', None)
    assert e.stats("a").collect()[0]["docs"] == 1


def test_dynamic_mapping():
    doc = documents.parse('{"label":"crate","pieces":12,"weight":0.25,"sealed":false,"packed":"2025-03-09 18:30:00","o":{"l":[{"x":1},{"x":2}],"e":[],"z":null}}')
    flat = documents.flatten(doc)
    assert {p: documents.kind_of(v[0]) for p, v in flat.items()} == {"label": "text", "pieces": "long", "weight": "double", "sealed": "boolean", "packed": "date", "o.l.x": "long"}
    assert flat["o.l.x"] == ["1", "2"]


def test_first_type_stays(spark):
    e = Engine(spark)
    e.put("t", "1", {"x": 1})
    e.put("t", "2", {"x": "word", "y": "2026-01-01"})
    assert e.mapping("t")["t"]["mappings"]["properties"] == {"x": {"type": "long"}, "y": {"type": "date"}}
    assert e.search("t", {"query": {"term": {"x": "word"}}}).total == 1 and e.search("t", {"query": {"match": {"x": "word"}}}).total == 0


def test_persistence(spark, tmp_path, bulked):
    bulked[0].save(f"file://{tmp_path}/store")
    e = Engine(spark)
    e.load(f"file://{tmp_path}/store", ["posts"])
    assert e.mapping("posts") == bulked[0].mapping("posts")
    assert e.search("posts", {"query": {"match": {"title": "HARBOUR"}}}).hits.collect()[0]["_id"] == "1"


def test_log(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    one = oplog.apply_operations(None, spark.createDataFrame([("a", 1, "index", "x", "{}", None), ("a", 2, "delete", "x", None, None), ("a", 3, "index", "x", '{"v":1}', None), ("a", 4, "index", "y", "{}", None), ("b", 5, "delete", "q", None, None)], "_index string, seq long, op string, id string, doc string, upsert string"))
    oplog.append_log(one, path)
    oplog.append_log(oplog.apply_operations(None, spark.createDataFrame([("a", 9, "index", "y", '{"v":2}', None)], "_index string, seq long, op string, id string, doc string, upsert string")), path)
    assert {r["_id"]: (r["_version"], r["_source"]) for r in oplog.latest(oplog.read_log(spark, path)).collect()} == {"x": (1, '{"v":1}'), "y": (2, '{"v":2}')}
    oplog.compact(spark, path, f"{path}2")
    assert {r["_id"]: r["_version"] for r in oplog.latest(oplog.read_log(spark, f"{path}2")).collect()} == {"x": 1, "y": 1}


def test_json_log_skips_corrupt_lines(spark, tmp_path):
    (tmp_path / "wal.jsonl").write_text('{"op":"put","id":"1","src":{"a":1}}\nnot json\n{"op":"put","id":"2","src":{"a":2}}\n{"op":"del","id":"1"}\n')
    got = oplog.latest(oplog.read_json_log(spark, f"file://{tmp_path}/wal.jsonl", "a")).collect()
    assert [(r["_id"], r["_source"]) for r in got] == [("2", '{"a":2}')]


def test_bulk_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.ndjson").write_text('{"index":{"_index":"a","_id":"1"}}\n{"v":1}\n{"delete":{"_index":"a","_id":"2"}}\n')
    rows = oplog.read_bulk(spark, f"file://{tmp_path}/in").orderBy("ordinal").collect()
    assert [(r["_index"], r["op"], r["id"], r["doc"]) for r in rows] == [("a", "index", "1", '{"v":1}'), ("a", "delete", "2", None)]


def test_stream(spark, tmp_path):
    schema = "_index string, ordinal long, op string, id string, doc string"
    src, log = f"file://{tmp_path}/src", f"file://{tmp_path}/log"
    for batch in ([("a", 0, "index", "1", '{"v":1}'), ("a", 1, "index", "2", "{}")], [("a", 0, "index", "1", '{"v":2}'), ("a", 1, "delete", "2", None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(src)
        stream_log(spark.readStream.schema(schema).json(src), log, f"file://{tmp_path}/cp").awaitTermination()
    got = oplog.latest(oplog.read_log(spark, log)).collect()
    assert [(r["_id"], r["_version"], r["_source"]) for r in got] == [("1", 2, '{"v":2}')]


def test_json_log_of_several_files(spark, tmp_path):
    """The second file is read first, as it is larger, and the first in two splits; what is written last wins all the same."""
    filler = "\n".join(json.dumps({"op": "put", "id": f"f{i}", "src": {"i": i}}) for i in range(3000))
    (tmp_path / "a.jsonl").write_text('{"op":"put","id":"x","src":{"v":"old"}}\n{"op":"put","id":"y","src":{"v":1}}\n' + filler[: len(filler) // 3].rpartition("\n")[0] + '\n{"op":"del","id":"y"}\n{"op":"put","id":"y","src":{"v":2}}\n')
    (tmp_path / "b.jsonl").write_text(filler + '\n{"op":"put","id":"x","src":{"v":"new"}}\n{"op":"del","id":"f7"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["_id"]: (r["_version"], r["_source"]) for r in oplog.latest(oplog.read_json_log(spark, f"file://{tmp_path}/*.jsonl", "a")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["x"] == (2, '{"v":"new"}') and got["y"] == (1, '{"v":2}') and "f7" not in got and len(got) == 3001


def test_stream_of_creates_updates_and_requests(spark, tmp_path):
    schema = "_index string, request long, ordinal long, op string, id string, doc string, upsert string"
    src, log, items = (f"file://{tmp_path}/{x}" for x in ("src", "log", "items"))
    batches = [
        [("a", 2, 0, "index", "1", '{"v":"later"}', None), ("a", 1, 0, "index", "1", '{"v":"sooner"}', None), ("a", 1, 1, "create", "2", '{"n":1}', None), ("a", 2, 1, "create", "2", '{"n":9}', None)],
        [("a", 3, 0, "update", "2", '{"m":2}', None), ("a", 3, 1, "create", "1", "{}", None), ("a", 4, 0, "update", "9", "{}", None), ("a", 4, 1, "update", "3", "{}", '{"up":1}')],
        [("a", 5, 0, "delete", "1", None, None), ("a", 5, 1, "delete", "8", None, None)],
    ]
    for batch in batches:
        spark.createDataFrame(batch, schema).repartition(3).write.mode("append").json(src)
        stream_log(spark.readStream.schema(schema).json(src), log, f"file://{tmp_path}/cp", items=items).awaitTermination()
    got = {r["_id"]: (r["_version"], r["_source"]) for r in oplog.latest(oplog.read_log(spark, log)).collect()}
    assert got == {"2": (2, '{"m":2,"n":1}'), "3": (1, '{"up":1}')}
    said = [(r["batch"], r["_id"], r["op"], r["status"]) for r in spark.read.parquet(items).orderBy("batch", "_id", "seq").collect()]
    assert said == [
        (0, "1", "index", 201), (0, "1", "index", 200), (0, "2", "create", 201), (0, "2", "create", 409), (1, "1", "create", 409), (1, "2", "update", 200), (1, "3", "update", 200), (1, "9", "update", 404), (2, "1", "delete", 200), (2, "8", "delete", 404),
    ]


def test_delete_by_query_and_typed_tables(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, s string"), "id")
    assert e.delete_by_query("t", {"query": {"term": {"s": "a"}}}).first()[0] == 1
    assert {r["_id"] for r in e.search("t").hits.collect()} == {"2", "3"}
    assert e.delete_by_query("t").first()[0] == 2 and e.count("t").first()[0] == 0
    with pytest.raises(ValueError, match="typed"):
        e.put("t", "1", {})


def test_writes_touch_only_what_they_change(spark, monkeypatch):
    """A put writes its document and the writes since the last merge, not the table; searches don't parse documents again."""
    from lexisift.sources import store

    monkeypatch.setattr(store, "MERGE_AFTER", 4)
    e = Engine(spark)
    e.ingest("t", spark.createDataFrame([(i, "index", str(i), f'{{"n":{i}}}') for i in range(2000)], "seq long, op string, id string, doc string"))
    sizes = []
    for k in range(7):
        e.put("t", str(k), {"n": k, "round": "again"}) if k % 3 else e.remove("t", str(k))
        held = e.stores["t"]
        sizes.append((held.delta.count() if held.delta is not None else 0, held.base.count()))
        assert e.count("t").first()[0] == 2000 - sum(1 for j in range(k + 1) if j % 3 == 0)
    assert sizes == [(2000, 0), (2000, 0), (0, 1999), (1, 1999), (2, 1999), (3, 1999), (0, 1997)]
    r = e.search("t", {"query": {"term": {"round": "again"}}, "size": -1})
    assert {x["_id"] for x in r.hits.collect()} == {"1", "2", "4", "5"}
    assert "Python" not in r.matched._jdf.queryExecution().toString()
    assert e.delete_by_query("t", {"query": {"range": {"n": {"gte": 10}}}}).first()[0] == 1990
    assert {x["_id"] for x in e.search("t", {"size": -1}).hits.collect()} == {"1", "2", "4", "5", "7", "8", "9"}
    e.put("t", "500", {"n": -1})
    assert e.get("t", "500").first()["_version"] == 1 and e.get("t", "1").first()["_version"] == 2


def test_bulk_files_are_parsed_as_they_come(spark, tmp_path):
    """Files in many splits give what their whole bodies give, in order; no file and no id's operations are held as a whole."""
    (tmp_path / "in").mkdir()
    put = lambda i, d: json.dumps({"index": {"_index": "a", "_id": str(i % 7)}}) + "\n" + json.dumps(d)
    good = "\n".join([put(i, {"v": i}) if i % 3 else json.dumps({"delete": {"_index": "a", "_id": str(i % 5)}}) for i in range(300)])
    like = "\r\n".join(["", put(1, {"delete": {"_index": "a", "_id": "1"}}), "  ", put(2, {"index": {}}), '{"update":{"_index":"a","_id":"1"}}', "broken", '{"create":{"_index":"a","_id":"1"}}'])
    bodies = {"1.ndjson": good + "\nno action\n" + good, "2 b.ndjson": good.replace('"a"', '"b"'), "3.ndjson": like, "4.ndjson": "", "5.ndjson": put(9, {"v": 1}) + "\n"}
    for name, body in bodies.items():
        (tmp_path / "in" / name).write_bytes(body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        got = [r.asDict() for r in oplog.read_bulk(spark, f"file://{tmp_path}/in").orderBy("request", "ordinal").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [{"request": q} | r for q, b in enumerate(bodies.values()) for r in oplog.parse_bulk(b)]
    assert [r["op"] for r in got if r["request"] == 0][-1] == "error" and len(got) == 300 + 1 + 300 + 4 + 1

    endless = (x for _ in iter(int, 1) for x in ('{"index":{"_id":"1"}}', "{}"))
    assert [r["ordinal"] for r in itertools.islice(oplog._operations(endless, "a"), 3)] == [0, 1, 2]
    columns = ["name", "id", "seq", "op", "doc", "upsert", "error", "version", "seq_no"]
    batch = lambda k: pa.RecordBatch.from_pydict({c: pa.array([{"name": "a", "id": "x", "seq": (1 << 60) + 4000 * k + i, "op": "index", "doc": "{}"}.get(c) for i in range(4000)], pa.int64() if c in ("seq", "version", "seq_no") else pa.string()) for c in columns})
    first, second = itertools.islice(oplog._folds(batch(k) for k in itertools.count()), 2)
    assert first.num_rows == second.num_rows == oplog.BATCH and second.column("_version")[-1].as_py() == 2 * oplog.BATCH and second.column("_seq_no")[-1].as_py() == (1 << 60) + 2 * oplog.BATCH - 1
