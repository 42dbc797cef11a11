"""Requests by method and path."""

import pytest

from lexisift.engine import Engine
from lexisift.facade import Facade, unwrap_types


@pytest.fixture(scope="module")
def api(spark):
    return Facade(Engine(spark))


def test_documents(api):
    assert api.request("PUT", "/posts", {"mappings": {"post": {"properties": {"title": {"type": "text"}}}}})[0] == 200
    assert api.request("PUT", "/posts")[0] == 400 and api.request("PUT", "/_bad")[0] == 400
    assert api.request("PUT", "/posts/_doc/1", {"title": "hello world"}) == (201, {"_index": "posts", "_id": "1", "_version": 1, "result": "created", "_shards": api.request("POST", "/_refresh")[1]["_shards"], "_seq_no": 1, "_primary_term": 1})
    assert api.request("PUT", "/posts/_doc/1", '{"title":"hello again"}')[1]["_version"] == 2
    assert api.request("PUT", "/posts/_create/1", {})[0] == 409 and api.request("PUT", "/posts/_doc/2", "[1]")[0] == 400
    assert api.request("POST", "/posts/_update/1", {"doc": {"n": 1}})[1]["result"] == "updated"
    assert api.request("POST", "/posts/_update/9", {"doc": {"n": 1}})[0] == 404 and api.request("POST", "/posts/_update/1", {"script": "x"})[0] == 400
    assert api.request("GET", "/posts/post/1")[1]["_source"] == {"n": 1, "title": "hello again"} and api.request("GET", "/posts/_source/1")[1] == {"n": 1, "title": "hello again"}
    assert api.request("HEAD", "/posts/_doc/7") == (404, None) and api.request("GET", "/nowhere/_doc/7")[0] == 404
    assert api.request("DELETE", "/posts/_doc/7")[0] == 404


def test_search_count_and_delete(api):
    status, got = api.request("POST", "/shop/_bulk", '{"index":{"_id":"a"}}\n{"t":"red hat","n":2}\n{"index":{"_id":"b"}}\n{"t":"blue hat","n":1}\n{"delete":{"_id":"z"}}\n')
    assert status == 200 and not got["errors"] and [next(iter(i.values()))["status"] for i in got["items"]] == [201, 201, 404]
    assert [h["_id"] for h in api.request("GET", "/shop/_search", params={"q": "hat", "sort": "n", "size": "1"})[1]["hits"]["hits"]] == ["b"]
    assert api.request("POST", "/shop/_search", {"query": {"nope": {}}})[0] == 400 and api.request("GET", "/nowhere/_search")[0] == 404
    assert api.request("GET", "/nowhere/_search", params={"ignore_unavailable": "true"})[1]["hits"]["total"]["value"] == 0
    assert api.request("POST", "/shop/_count", {"query": {"match": {"t": "red"}}})[1]["count"] == 1
    assert [d["found"] for d in api.request("POST", "/shop/_mget", {"ids": ["a", "q"]})[1]["docs"]] == [True, False]
    assert api.request("POST", "/_bulk", "nonsense")[0] == 400
    assert "green open shop" in api.request("GET", "/_cat/indices")[1] and api.request("GET", "/shop/_stats")[1]["_all"]["total"]["docs"]["count"] == 2
    assert api.request("POST", "/shop/_delete_by_query", {"query": {"match": {"t": "red"}}})[1]["deleted"] == 1
    assert api.request("GET", "/shop/_mapping")[1]["shop"]["mappings"]["properties"]["n"] == {"type": "long"}
    assert api.request("PUT", "/shop/_settings", {"x": 1})[0] == 200 and api.request("GET", "/shop/_settings")[1]["shop"]["settings"]["x"] == 1
    assert api.request("DELETE", "/shop")[0] == 200 and api.request("HEAD", "/shop") == (404, None)


def test_metadata_and_stubs(api):
    assert api.request("GET", "/")[0] == 200 and api.request("GET", "/_cluster/health")[1]["status"] == "green"
    assert api.request("HEAD", "/_template/x") == (404, None) and api.request("PUT", "/_ilm/x")[1] == {"acknowledged": True} and api.request("GET", "/_sql")[1] == {}
    assert api.request("GET", "/posts/_nope")[0] == 400 and api.request("GET", "/_alias")[1] == {}
    assert [t["token"] for t in api.request("POST", "/_analyze", {"text": ["Ciao è", "x"]})[1]["tokens"]] == ["ciao", "e", "x"]
    assert unwrap_types({"properties": {}}) == {"properties": {}}
