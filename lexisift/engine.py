"""The engine: a catalog of searchable tables and the operations on them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis
from .operators.search import SearchResult, search
from .plans.compiler import Context, compile_query
from .plans.schema import Index, leaves, paths_of, typed_properties
from .sources import documents, oplog, postings
from .sources.catalog import resolve, valid_name
from .sources.shared import settled
from .sources.store import Store


class IndexMissing(KeyError):
    """No table of the expression exists."""


class Engine:
    """Typed tables are registered as they are; JSON documents come in as operations and are kept in a store."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.indices: dict[str, Index] = {}
        self.stores: dict[str, Store] = {}
        self.rounds: dict[str, int] = {}

    # --- catalog

    def register(self, name: str, df: DataFrame, id_col: str, mapping: dict | None = None) -> Index:
        """A typed table. mapping: {"properties": ...}, which replaces the inferred types of the fields it names."""
        if not valid_name(name):
            raise ValueError(f"invalid index name [{name}]")
        stored = paths_of(df.schema)
        properties = typed_properties(df.schema) | ((mapping or {}).get("properties") or {})
        self.indices[name] = Index(name, df.withColumn("_id", F.col(f"`{id_col}`").cast("string")), properties, stored, key=id_col)
        return self.indices[name]

    def attach(self, name: str, field: str, folder: str, build: bool = False) -> None:
        """Let searches of a text field read its inverted index table in `folder` instead of the texts. build: write it first.

        The table is that of the rows as they are; after a write or a delete the field's texts are read again.
        """
        x = self._one(name)
        if build:
            postings.build(x, field, folder)
        x.lists[field] = postings.Postings(self.spark, folder)

    def create(self, name: str, mapping: dict | None = None, settings: dict | None = None) -> Index:
        """An empty JSON table."""
        if not valid_name(name):
            raise ValueError(f"invalid index name [{name}]")
        if name in self.indices:
            raise ValueError(f"index [{name}] exists")
        self.stores[name] = Store(self.spark)
        return self._refresh(name, (mapping or {}).get("properties") or {}, settings or {})

    def delete(self, name: str) -> None:
        self._one(name)
        del self.indices[name]
        self.stores.pop(name, None)

    def exists(self, expression: str) -> bool:
        return bool(resolve(expression, self.indices))

    def mapping(self, expression: str) -> dict:
        return {n: {"mappings": {"properties": self.indices[n].properties}} for n in resolve(expression, self.indices)}

    def put_mapping(self, name: str, body: dict) -> None:
        """Replaces the top-level fields it names; documents stay as they are."""
        x = self._one(name)
        x.properties = x.properties | (body.get("properties") or {})
        x.types = leaves(x.properties)

    def settings(self, name: str) -> dict:
        return self._one(name).settings

    def put_settings(self, name: str, body: dict) -> None:
        x = self._one(name)
        x.settings = x.settings | body

    def _one(self, name: str) -> Index:
        if name not in self.indices:
            raise IndexMissing(f"no such index [{name}]")
        return self.indices[name]

    def _resolved(self, expression: str, lenient: bool = False) -> list[Index]:
        names = resolve(expression, self.indices)
        if not names and expression not in ("*", "_all") and not lenient:
            raise IndexMissing(f"no such index [{expression}]")
        return [self.indices[n] for n in names]

    # --- reading

    def search(self, expression: str, body: dict | None = None, *, q: str | None = None, size: int | None = None, offset: int | None = None, sort: str | None = None, ignore_unavailable: bool = False) -> SearchResult:
        """q, size, offset and sort are what a request's address may add; q and sort give way to the body."""
        body = dict(body or {})
        if size is not None:
            body["size"] = size
        if offset is not None:
            body["from"] = offset
        if q and not body.get("query"):
            body["query"] = {"query_string": {"query": q}}
        if sort and not body.get("sort"):
            body["sort"] = [sort]
        return search(self.spark, self._resolved(expression, ignore_unavailable), body)

    def matches(self, expression: str, query: dict | None = None) -> DataFrame:
        """(_index, _id) of all that a query matches."""
        out = None
        for x in self._resolved(expression, lenient=True):
            ctx = Context(x)
            c = compile_query(ctx, query)
            df = ctx.frame(c.plain)
            df = (df if c.exact else df.filter(c.match)).select(F.lit(x.name).alias("_index"), "_id")
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], "_index string, _id string")

    def count(self, expression: str, body: dict | None = None) -> DataFrame:
        """One row: `count`. A table that isn't there counts 0."""
        return self.matches(expression, (body or {}).get("query")).agg(F.count(F.lit(1)).alias("count"))

    def get(self, name: str, doc_id: str) -> DataFrame:
        x = self._one(name)
        return x.df.filter(x.has_id([doc_id]))

    def mget(self, name: str | None, docs: Iterable[dict] = (), ids: Iterable[str] = ()) -> DataFrame:
        """(position, _index, _id, found, _source) in the order asked; documents as JSON."""
        asked = [(d.get("_index") or name, str(d["_id"])) for d in docs] + [(name, str(i)) for i in ids]
        want = self.spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(asked)], "position int, _index string, _id string")
        held = None
        for n in sorted({n for n, _ in asked if n in self.indices}):
            x = self.indices[n]
            source = F.col("_source") if x.json else F.to_json(F.struct(*[f"`{c}`" for c in x.source_columns()]))
            part = x.df.filter(x.has_id([d for m, d in asked if m == n])).select(F.lit(n).alias("__n"), F.col("_id").alias("__d"), source.alias("_source"))
            held = part if held is None else held.unionByName(part)
        if held is None:
            return want.select("*", F.lit(False).alias("found"), F.lit(None).cast("string").alias("_source"))
        out = want.join(held, (want["_index"] == held["__n"]) & (want["_id"] == held["__d"]), "left")
        return out.select("position", "_index", "_id", F.col("__n").isNotNull().alias("found"), "_source").orderBy("position")

    def analyze(self, texts: str | list[str]) -> DataFrame:
        """(token, position, start_offset, end_offset); positions go on across texts, offsets are 0 and the token's bytes."""
        given = [texts] if isinstance(texts, str) else list(texts)
        df = self.spark.createDataFrame([(given,)], "t array<string>")
        toks = F.flatten(F.transform("t", analysis.tokens))
        return df.select(F.posexplode(toks).alias("position", "token")).select("token", F.lit("<ALPHANUM>").alias("type"), "position", F.lit(0).alias("start_offset"), F.octet_length("token").alias("end_offset"))

    def stats(self, expression: str = "_all") -> DataFrame:
        """(_index, docs): a row for each table and one for all of them."""
        out = None
        for x in self._resolved(expression, lenient=True):
            df = x.df.agg(F.count(F.lit(1)).alias("docs")).select(F.lit(x.name).alias("_index"), "docs")
            out = df if out is None else out.unionByName(df)
        if out is None:
            return self.spark.createDataFrame([], "_index string, docs long")
        return out.rollup("_index").agg(F.sum("docs").alias("docs")).select(F.coalesce("_index", F.lit("_all")).alias("_index"), "docs")

    def cat_indices(self) -> DataFrame:
        return self.stats().filter("_index <> '_all'").orderBy("_index")

    # --- writing

    def _refresh(self, name: str, properties: dict, settings: dict) -> Index:
        self.indices[name] = Index(name, self.stores[name].view().drop("_index"), properties, None, settings)
        return self.indices[name]

    def ingest(self, name: str, ops: DataFrame) -> DataFrame:
        """Apply operations (seq, op, id, doc, upsert) to a JSON table, which is made if it isn't there; gives an item for each.

        What they changed is written to the shared folder; documents that they don't touch aren't written again.
        """
        if name not in self.indices:
            self.create(name)
        x = self._one(name)
        if not x.json:
            raise ValueError(f"[{name}] is a typed table: its rows come from its source")
        start = self.rounds.get(name, 0) << 40  # operations of later calls come after
        self.rounds[name] = self.rounds.get(name, 0) + 1
        ops = ops.withColumn("_index", F.lit(name)).withColumn("seq", F.col("seq") + F.lit(start))
        applied = settled(oplog.apply_operations(self.stores[name].snapshot(), ops))
        self.stores[name].write(applied)
        written = applied.filter("op <> 'base' and op <> 'delete' and error is null").select(F.col("seq").alias("_seq_no"), "_source")
        properties = documents.infer(documents.flattened(written), x.properties)
        self._refresh(name, properties, x.settings)
        return oplog.items(applied).withColumn("seq", F.col("seq") - F.lit(start))

    def bulk(self, body: str, default_index: str | None = None) -> DataFrame:
        """A bulk body: operations on any tables, in order; an item for each. ValueError for a malformed action, after those before it."""
        rows = oplog.parse_bulk(body, default_index)
        out = None
        for name in dict.fromkeys(r["_index"] for r in rows if r["op"] != "error" and r["_index"]):
            mine = [(r["ordinal"], r["op"], r["id"], r["doc"], r["upsert"], r["error"]) for r in rows if r["_index"] == name]
            ops = self.spark.createDataFrame(mine, "seq long, op string, id string, doc string, upsert string, error string")
            if not valid_name(name):
                got = ops.select("seq", "op", F.lit(name).alias("_index"), F.col("id").alias("_id"), F.lit(400).alias("status"), F.lit(None).cast("string").alias("result"), F.lit("invalid_index_name_exception").alias("error"))
            elif name not in self.indices and all(r[1] == "delete" for r in mine):
                got = ops.select("seq", "op", F.lit(name).alias("_index"), F.col("id").alias("_id"), F.lit(404).alias("status"), F.lit("not_found").alias("result"), F.lit(None).cast("string").alias("error"))
            else:
                got = self.ingest(name, ops)
            out = got if out is None else out.unionByName(got)
        if rows and rows[-1]["op"] == "error":
            raise ValueError(rows[-1]["error"])
        return (out if out is not None else self.spark.createDataFrame([], "seq long, op string, _index string, _id string, status int, result string, error string")).orderBy("seq")

    def put(self, name: str, doc_id: str | None, doc: dict | str, create: bool = False) -> DataFrame:
        return self._write(name, "create" if create else "index", doc_id or oplog.auto_id(), doc)

    def update(self, name: str, doc_id: str, doc: dict | None = None, upsert: dict | None = None, doc_as_upsert: bool = False) -> DataFrame:
        return self._write(name, "update", doc_id, doc, upsert if upsert is not None else doc if doc_as_upsert else None)

    def remove(self, name: str, doc_id: str) -> DataFrame:
        return self._write(name, "delete", doc_id, None)

    def _write(self, name: str, op: str, doc_id: str, doc, upsert=None) -> DataFrame:
        text = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return self.ingest(name, self.spark.createDataFrame([(0, op, doc_id, text(doc), text(upsert))], "seq long, op string, id string, doc string, upsert string"))

    def delete_by_query(self, expression: str, body: dict | None = None) -> DataFrame:
        """One row: `deleted`. No query deletes everything. Tables go on without the matched rows; their sources stay."""
        gone = settled(self.matches(expression, (body or {}).get("query")))
        for x in self._resolved(expression, lenient=True):
            ids = gone.filter(F.col("_index") == x.name).select(F.col("_id").alias("__d"))
            if x.json:
                self.stores[x.name].remove(gone.filter(F.col("_index") == x.name))
                self._refresh(x.name, x.properties, x.settings)
            else:
                x.df = x.df.join(ids, x.df["_id"] == ids["__d"], "left_anti")
                x.lists = {}
        return gone.agg(F.count(F.lit(1)).alias("deleted"))

    # --- persistence

    def save(self, path: str) -> None:
        """Each JSON table as a folder of Parquet with its mapping beside it."""
        for name, store in self.stores.items():
            store.snapshot().write.mode("overwrite").parquet(f"{path}/{name}/docs")
            meta = json.dumps({"mappings": {"properties": self.indices[name].properties}, "settings": self.indices[name].settings}, ensure_ascii=False)
            self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}/meta")

    def load(self, path: str, names: Iterable[str]) -> None:
        for name in names:
            meta = json.loads(self.spark.read.text(f"{path}/{name}/meta").first()[0])
            self.stores[name] = Store(self.spark, self.spark.read.schema(oplog.SNAPSHOT).parquet(f"{path}/{name}/docs"))
            self._refresh(name, meta["mappings"]["properties"], meta["settings"])
