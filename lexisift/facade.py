"""The request surface without a server: method, path and body in, status and answer out.

Answers are documents of the size that a request asks for; anything larger is read from the engine's DataFrames.
Paths with a type name between the table and the id are accepted as well.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from .engine import Engine, IndexMissing
from .functions.values import py_string
from .plans.compiler import QueryError
from .sources.catalog import resolve, valid_name

OK = {"total": 1, "successful": 1, "skipped": 0, "failed": 0}
NODE = "lexisift"
STUBS = {"_template", "_index_template", "_ingest", "_scripts", "_ilm", "_xpack", "_license", "_security", "_ml", "_sql"}
ACK = {"acknowledged": True}


class Refused(Exception):
    def __init__(self, status: int, kind: str, reason: str):
        super().__init__(reason)
        self.status, self.kind, self.reason = status, kind, reason


def unwrap_types(mappings: dict | None) -> dict:
    """A mapping whose properties stand below a type name, without that name."""
    m = mappings or {}
    if "properties" not in m and len(m) == 1:
        (inner,) = m.values()
        if isinstance(inner, dict) and "properties" in inner:
            return inner
    return m


class Facade:
    def __init__(self, engine: Engine):
        self.engine = engine

    def request(self, method: str, path: str, body: dict | str | None = None, params: dict | None = None) -> tuple[int, object]:
        try:
            return self._route(method.upper(), [p for p in path.strip("/").split("/") if p], body, params or {})
        except Refused as e:
            return e.status, _error(e.status, e.kind, e.reason)
        except IndexMissing as e:
            return 404, _error(404, "index_not_found_exception", str(e.args[0]))
        except QueryError as e:
            return 400, _error(400, "search_phase_execution_exception", str(e))

    # --- routes

    def _route(self, method: str, seg: list[str], body, params: dict) -> tuple[int, object]:
        if not seg:
            return 200, None if method == "HEAD" else {"name": NODE, "cluster_name": NODE, "version": {"number": "8.17.0"}, "tagline": "You Know, for Search"}
        head = seg[0]
        if head in STUBS:
            return (404, None) if method == "HEAD" else (200, {} if method == "GET" else ACK)
        if head == "_cluster":
            return self._cluster(seg[1] if len(seg) > 1 else "")
        if head == "_nodes":
            return 200, {"_nodes": {"total": 1, "successful": 1, "failed": 0}, "cluster_name": NODE, "nodes": {NODE: {"name": NODE, "roles": ["data", "ingest", "master"]}}}
        if head == "_cat":
            return self._cat(seg[1] if len(seg) > 1 else "", params)
        if head in ("_aliases", "_alias"):
            return 200, ACK if head == "_aliases" else {}
        if head in ("_bulk", "_search", "_count", "_mget", "_refresh", "_flush", "_forcemerge", "_stats", "_analyze"):
            return self._on(method, "*" if head in ("_search", "_count", "_stats") else "", [head], body, params)
        if head == "favicon.ico":
            return 404, None
        return self._on(method, head, seg[1:], body, params) if len(seg) > 1 else self._index(method, head, body)

    def _on(self, method: str, name: str, rest: list[str], body, params: dict) -> tuple[int, object]:
        what = rest[0]
        if what in ("_doc", "_create"):
            return self._doc(method, name, rest[1] if len(rest) > 1 else None, body, what == "_create")
        if what == "_source":
            return self._source(method, name, rest)
        if what == "_update":
            return self._update(name, rest, _object(body))
        if what == "_search":
            return self._search(name, _object(body), params)
        if what == "_count":
            return 200, {"count": self.engine.count(name, _object(body)).first()[0], "_shards": OK}
        if what == "_bulk":
            return self._bulk(name or None, body)
        if what in ("_mapping", "_mappings"):
            return self._mapping(method, name, body)
        if what == "_settings":
            return self._settings(method, name, body)
        if what in ("_refresh", "_flush", "_forcemerge", "_cache"):
            return 200, {"_shards": OK}
        if what == "_stats":
            return self._stats(name)
        if what == "_analyze":
            text = _object(body).get("text")
            rows = self.engine.analyze([t for t in (text if isinstance(text, list) else [text]) if isinstance(t, str)]).collect()
            return 200, {"tokens": [r.asDict() for r in rows]}
        if what == "_delete_by_query":
            began = time.time()
            if not resolve(name, self.engine.indices):
                raise IndexMissing(f"no such index [{name}]")
            n = self.engine.delete_by_query(name, _object(body)).first()[0]
            return 200, {"took": int((time.time() - began) * 1000), "timed_out": False, "total": n, "deleted": n, "batches": 1, "version_conflicts": 0, "noops": 0, "failures": []}
        if what == "_mget":
            return self._mget(name or None, _object(body))
        if what in ("_open", "_close"):
            return 200, ACK
        if what in ("_alias", "_aliases"):
            return 200, {name: {"aliases": {}}}
        if what.startswith("_"):
            raise Refused(400, "illegal_argument_exception", f"unrecognized endpoint [{what}]")
        if len(rest) < 2:
            raise Refused(400, "illegal_argument_exception", f"unsupported path [{name}/{what}]")
        if rest[1] in ("_search", "_count", "_mapping"):
            return self._on(method, name, rest[1:], body, params)
        if rest[2:3] == ["_update"]:
            return self._on(method, name, ["_update", rest[1]], body, params)
        return self._on(method, name, ["_doc", *rest[1:]], body, params)

    # --- tables

    def _index(self, method: str, name: str, body) -> tuple[int, object]:
        e, names = self.engine, resolve(name, self.engine.indices)
        if method == "HEAD":
            return (200 if names else 404), None
        if method == "PUT":
            req = _object(body)
            if name in e.indices:
                raise Refused(400, "resource_already_exists_exception", f"index [{name}] already exists")
            self._named(name)
            e.create(name, unwrap_types(req.get("mappings")), req.get("settings"))
            return 200, {"acknowledged": True, "shards_acknowledged": True, "index": name}
        if not names:
            raise IndexMissing(f"no such index [{name}]")
        if method == "GET":
            return 200, {n: {"aliases": {}, "mappings": {"properties": e.indices[n].properties}, "settings": self._shown(n)} for n in names}
        if method == "DELETE":
            for n in names:
                e.delete(n)
            return 200, ACK
        raise Refused(405, "illegal_argument_exception", "unsupported method")

    def _named(self, name: str) -> None:
        if not valid_name(name):
            raise Refused(400, "invalid_index_name_exception", f"invalid index name [{name}]")

    def _shown(self, name: str) -> dict:
        own = dict(self.engine.settings(name))
        index = own.get("index")
        if not isinstance(index, (dict, type(None))):
            return own
        return own | {"index": {"number_of_shards": "1", "number_of_replicas": "0"} | (index or {}) | {"uuid": f"{NODE}-{name}", "provided_name": name}}

    def _mapping(self, method: str, name: str, body) -> tuple[int, object]:
        if method == "GET":
            if not (out := self.engine.mapping(name)):
                raise IndexMissing(f"no such index [{name}]")
            return 200, out
        self._ensure(name)
        self.engine.put_mapping(name, unwrap_types(_object(body)))
        return 200, ACK

    def _ensure(self, name: str) -> None:
        if name not in self.engine.indices:
            self._named(name)
            self.engine.create(name)

    def _settings(self, method: str, name: str, body) -> tuple[int, object]:
        names = resolve(name, self.engine.indices)
        if not names:
            raise IndexMissing(f"no such index [{name}]")
        if method == "GET":
            return 200, {n: {"settings": self._shown(n)} for n in names}
        for n in names:
            self.engine.put_settings(n, _object(body))
        return 200, ACK

    def _cluster(self, what: str) -> tuple[int, object]:
        n = len(self.engine.indices)
        if what == "health":
            return 200, {"cluster_name": NODE, "status": "green", "timed_out": False, "number_of_nodes": 1, "active_primary_shards": n, "active_shards": n, "unassigned_shards": 0, "active_shards_percent_as_number": 100.0}
        if what == "settings":
            return 200, {"persistent": {}, "transient": {}}
        return 200, {"cluster_name": NODE} | ({"status": "green", "indices": {"count": n}} if what == "stats" else {})

    def _cat(self, what: str, params: dict) -> tuple[int, object]:
        as_json = params.get("format") == "json"
        if what == "indices":
            rows = [{"health": "green", "status": "open", "index": r["_index"], "uuid": f"{NODE}-{r['_index']}", "pri": "1", "rep": "0", "docs.count": str(r["docs"]), "docs.deleted": "0", "store.size": "0b", "pri.store.size": "0b"} for r in self.engine.cat_indices().collect()]
            if as_json:
                return 200, rows
            names = "health status index uuid pri rep docs.count docs.deleted store.size pri.store.size\n"
            return 200, (names if "v" in params else "") + "".join(" ".join(r.values()) + "\n" for r in rows)
        if what == "health":
            return 200, [{"cluster": NODE, "status": "green"}] if as_json else f"{NODE} green\n"
        if what == "nodes":
            return 200, [{"name": NODE, "node.role": "dim", "master": "*"}] if as_json else f"{NODE} dim *\n"
        return 200, ""

    def _stats(self, name: str) -> tuple[int, object]:
        rows = {r["_index"]: r["docs"] for r in self.engine.stats(name).collect()}
        part = lambda n: {"docs": {"count": n, "deleted": 0}}
        both = lambda n: {"primaries": part(n), "total": part(n)}
        return 200, {"_shards": OK, "_all": both(rows.pop("_all", 0)), "indices": {k: both(n) for k, n in rows.items()}}

    # --- documents

    def _held(self, name: str, doc_id: str | None):
        x = self.engine._one(name)
        df = x.df.filter(F.col("_id") == (doc_id or ""))
        source = F.col("_source") if x.json else F.to_json(F.struct(*[f"`{c}`" for c in x.source_columns()]))
        return df.select(source.alias("source"), (F.col("_version") if x.json else F.lit(1)).alias("version"), (F.col("_seq_no") if x.json else F.lit(0)).alias("seq")).first()

    def _doc(self, method: str, name: str, doc_id: str | None, body, create: bool) -> tuple[int, object]:
        if method in ("GET", "HEAD"):
            r = self._held(name, doc_id)
            if method == "HEAD":
                return (200 if r else 404), None
            if r is None:
                return 404, {"_index": name, "_id": doc_id or "", "found": False}
            return 200, {"_index": name, "_id": doc_id, "_version": r["version"], "_seq_no": r["seq"], "_primary_term": 1, "found": True, "_source": json.loads(r["source"])}
        if method in ("PUT", "POST"):
            self._ensure(name)
            doc = body if isinstance(body, str) else json.dumps(body or {}, ensure_ascii=False)
            try:
                fine = isinstance(json.loads(doc), dict)
            except ValueError:
                fine = False
            if not fine:
                raise Refused(400, "mapper_parsing_exception", "invalid document body")
            return self._written(name, self.engine.put(name, doc_id, doc, create).first())
        if method == "DELETE":
            self.engine._one(name)
            return self._written(name, self.engine.remove(name, doc_id or "").first())
        raise Refused(405, "illegal_argument_exception", "unsupported method")

    def _written(self, name: str, item) -> tuple[int, object]:
        if item["error"]:
            raise Refused(item["status"], item["error"], f"[{item['_id']}]: {item['error']}")
        if item["result"] == "not_found":
            return 404, {"_index": name, "_id": item["_id"], "result": "not_found", "_shards": OK}
        version = 1
        if item["result"] != "deleted":
            version = self.engine.stores[name].snapshot().filter(F.col("_id") == item["_id"]).first()["_version"]
        return item["status"], {"_index": name, "_id": item["_id"], "_version": version, "result": item["result"], "_shards": OK, "_seq_no": version, "_primary_term": 1}

    def _source(self, method: str, name: str, rest: list[str]) -> tuple[int, object]:
        if len(rest) < 2:
            raise Refused(400, "illegal_argument_exception", "missing document id")
        r = self._held(name, rest[1])
        if r is None:
            raise Refused(404, "resource_not_found_exception", f"document [{rest[1]}] not found")
        return 200, None if method == "HEAD" else json.loads(r["source"])

    def _update(self, name: str, rest: list[str], req: dict) -> tuple[int, object]:
        if len(rest) < 2:
            raise Refused(400, "illegal_argument_exception", "missing document id")
        if req.get("doc") is None and req.get("script") is not None:
            raise Refused(400, "illegal_argument_exception", "scripted updates are not supported")
        self._ensure(name)
        return self._written(name, self.engine.update(name, rest[1], req.get("doc"), req.get("upsert"), req.get("doc_as_upsert") is True).first())

    def _bulk(self, name: str | None, body) -> tuple[int, object]:
        try:
            rows = self.engine.bulk(body or "", name).collect()
        except ValueError as e:
            raise Refused(400, "parse_exception", str(e)) from None
        out = []
        for r in rows:
            item = {"_index": r["_index"], "_id": r["_id"], "status": r["status"]}
            item |= {"error": {"type": r["error"], "reason": r["error"]}} if r["error"] else {"result": r["result"], "_shards": OK, "_version": 1, "_seq_no": 0, "_primary_term": 1}
            out.append({r["op"]: item})
        return 200, {"took": 0, "errors": any(r["error"] for r in rows), "items": out}

    def _mget(self, name: str | None, req: dict) -> tuple[int, object]:
        rows = self.engine.mget(name, req.get("docs") or [], [py_string(i) for i in req.get("ids") or []]).collect()
        return 200, {"docs": [{"_index": r["_index"], "_id": r["_id"], "found": r["found"]} | ({"_source": json.loads(r["_source"])} if r["found"] else {}) for r in rows]}

    def _search(self, name: str, body: dict, params: dict) -> tuple[int, object]:
        number = lambda k: int(params[k]) if str(params.get(k, "")).lstrip("-").isdigit() else None
        began = time.time()
        r = self.engine.search(name, body, q=params.get("q"), size=number("size"), offset=number("from"), sort=params.get("sort"), ignore_unavailable=params.get("ignore_unavailable") == "true")
        return 200, {"took": 0, "_shards": OK} | r.to_dict() | {"took": int((time.time() - began) * 1000)}


def _object(body) -> dict:
    if isinstance(body, str):
        try:
            body = json.loads(body) if body.strip() else {}
        except ValueError as e:
            raise Refused(400, "parse_exception", str(e)) from None
    return body or {}


def _error(status: int, kind: str, reason: str) -> dict:
    cause = {"type": kind, "reason": reason}
    return {"error": {"root_cause": [cause]} | cause, "status": status}
