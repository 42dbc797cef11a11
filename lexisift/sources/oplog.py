"""Writes as operations on snapshots: bulk requests, an append-only log, and what is left after it.

An operation is a row (_index, seq, op, id, doc, upsert), op one of index, create, update and delete. A log holds
(_index, seq, op, id, src) with op put or del, in Parquet, and is only ever appended to or compacted into a new folder.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import valid_name
from .documents import merge_json, parse

OPS = "request long, ordinal long, _index string, op string, id string, doc string, upsert string, error string"
#: Operations that go back to the JVM at once.
BATCH = 10_000
SNAPSHOT = "_index string, _id string, _version long, _seq_no long, _source string"
APPLIED = "_index string, _id string, _version long, _seq_no long, _source string, seq long, op string, status int, result string, error string"


def auto_id() -> str:
    return f"ls-{time.time_ns()}-{uuid.uuid4().hex[:8]}"


def parse_bulk(body: str, default_index: str | None = None) -> list[dict]:
    """The operations of one bulk body. A malformed action ends it; what comes before stands, and a row with an error follows."""
    return list(_operations(body.split("\n"), default_index))


def _operations(body: Iterable[str], default_index: str | None) -> Iterator[dict]:
    """parse_bulk of the body's lines, of which no more than two are held."""
    lines = (y for x in body if (y := x.strip()))
    n = 0

    def fail(reason: str) -> dict:
        return {"ordinal": n, "_index": None, "op": "error", "id": None, "doc": None, "upsert": None, "error": reason}

    for line in lines:
        try:
            action = json.loads(line)
        except ValueError as e:
            yield fail(f"malformed action line: {e}")
            return
        op = next((k for k in ("index", "create", "update", "delete") if isinstance(action, dict) and isinstance(action.get(k), dict)), None)
        if op is None:
            yield fail("action line missing operation")
            return
        meta = action[op]
        row = {"ordinal": n, "_index": meta.get("_index") or default_index, "op": op, "id": meta.get("_id") or "", "doc": None, "upsert": None, "error": None}
        if op != "delete":
            src = next(lines, None)
            if src is None:
                yield fail(f"missing source line for {op}")
                return
            row |= _source(op, src)
            if not valid_name(row["_index"] or ""):
                row["error"] = "invalid_index_name_exception"
            elif not row["id"] and op != "update":
                row["id"] = auto_id()
        yield row
        n += 1


def _source(op: str, src: str) -> dict:
    try:
        doc = parse(src)
    except ValueError:
        return {"doc": src, "error": "parse_exception" if op == "update" else "mapper_parsing_exception"}
    if not isinstance(doc, dict):
        return {"doc": src, "error": "mapper_parsing_exception"}
    if op != "update":
        return {"doc": src}
    from .documents import dump

    part = lambda k: dump(doc[k]) if isinstance(doc.get(k), dict) else None
    if part("doc") is None and doc.get("script") is not None:
        return {"error": "illegal_argument_exception"}
    return {"doc": part("doc"), "upsert": part("upsert") or (part("doc") if doc.get("doc_as_upsert") is True else None)}


def bulk_operations(bodies: DataFrame, default_index: str | None = None) -> DataFrame:
    """Operations of bulk bodies (request, body), in parallel over the requests. A body is one value: files are read by read_bulk."""

    def run(it):
        for data in it:
            rows = [{"request": int(q)} | r for q, b in zip(data["request"], data["body"]) for r in parse_bulk(b or "", default_index)]
            if rows:
                yield pd.DataFrame(rows)[["request", "ordinal", "_index", "op", "id", "doc", "upsert", "error"]]

    return bodies.select(F.col("request").cast("long"), "body").mapInPandas(run, OPS)


def read_bulk(spark: SparkSession, path: str, default_index: str | None = None) -> DataFrame:
    """Bulk files, each one request; the order of requests is that of their paths.

    The lines of a file come to one task, in order, and are parsed as they come, so that no more of a file than a batch of lines is in memory.
    """

    def lines_of(it):
        for data in it:
            yield from zip(data["request"], data["value"])

    def run(it):
        for request, lines in groupby(lines_of(it), lambda x: x[0]):
            rows = _operations((x for _, x in lines), default_index)
            while some := list(islice(rows, BATCH)):
                yield pd.DataFrame([{"request": int(request)} | r for r in some])[["request", "ordinal", "_index", "op", "id", "doc", "upsert", "error"]]

    files = spark.read.text(path, lineSep="\n")
    order = spark.createDataFrame(list(enumerate(sorted(files.inputFiles()))), "request long, p string")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # rises within a split
    lines = files.select("value", F.input_file_name().alias("q"), F.col("_metadata.file_block_start").alias("__b"), row.alias("__r"))
    lines = lines.join(order, F.col("p") == F.col("q")).select("request", "__b", "__r", "value")
    return lines.repartition("request").sortWithinPartitions("request", "__b", "__r").select("request", "value").mapInPandas(run, OPS)


def sequence(ops: DataFrame, start: int = 0) -> DataFrame:
    """`seq` from a request number and an ordinal (below 2**31), so that no global sort is needed."""
    return ops.withColumn("seq", F.lit(start) + F.shiftleft(F.col("request"), 31) + F.col("ordinal"))


def latest(log: DataFrame) -> DataFrame:
    """The snapshot of a log of puts and deletes: the last operation of each id wins, and deleted ids are gone.

    Puts behind the last delete of their id are aggregated with partial results; _version counts them. Only deletes are joined to them.
    """
    gone = log.filter("op = 'del'").groupBy(F.col("_index").alias("__i"), F.col("id").alias("__d")).agg(F.max("seq").alias("__gone"))
    puts = log.filter("op = 'put'").join(gone, (F.col("_index") == F.col("__i")) & (F.col("id") == F.col("__d")), "left")
    puts = puts.filter(F.col("__gone").isNull() | (F.col("seq") > F.col("__gone")))
    held = puts.groupBy("_index", "id").agg(F.max(F.struct("seq", "src")).alias("last"), F.count(F.lit(1)).alias("_version"))
    return held.select("_index", F.col("id").alias("_id"), "_version", F.col("last.seq").alias("_seq_no"), F.col("last.src").alias("_source"))


def _fold(rows: Iterable[tuple]) -> Iterator[tuple]:
    """All operations on one id in order; a row for each with the outcome, and the snapshot's state after it."""
    source, version, seq = None, 0, None
    for name, id_, at, op, doc, upsert, error, held, held_seq in rows:
        if op == "base":
            source, version, seq = doc, held, held_seq
            yield name, id_, version, seq, source, at, op, 200, "base", None
            continue
        status, result = 200, None
        if error is not None:
            status = 400
        elif op == "delete":
            status, result = (200, "deleted") if source is not None else (404, "not_found")
            source, version = None, 0
        elif op == "create" and source is not None:
            status, error = 409, "version_conflict_engine_exception"
        elif op in ("index", "create"):
            status, result = (200, "updated") if source is not None else (201, "created")
            source, version, seq = doc, version + 1, at
        elif source is None and upsert is None:
            status, error = 404, "document_missing_exception"
        elif source is None:
            source, version, seq, result = upsert, 1, at, "created"
        elif doc is None:
            status, error = 400, "mapper_parsing_exception"
        else:
            source, version, seq, result = merge_json(source, doc), version + 1, at, "updated"
        yield name, id_, version, seq if source is not None else None, source, at, op, status, result, error


def _folds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Operations sorted by name, id and seq, folded by id as they come; an id's operations may span batches."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in APPLIED.split(", "))])
    rows = (r for data in it for r in zip(*[c.to_pylist() for c in data.columns]))
    out = (r for _, own in groupby(rows, lambda r: r[:2]) for r in _fold(own))
    while some := list(islice(out, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), schema)], schema=schema)


def apply_operations(snapshot: DataFrame | None, ops: DataFrame) -> DataFrame:
    """A row for each operation with its outcome (status, result, error) and the document after it; `base` rows are the snapshot's.

    Operations on one id are folded in order, those on different ids in parallel; of an id with very many, no more than a batch is in memory.
    """
    columns = ["_index", "seq", "op", "id", "doc", "upsert", "error"]
    have = ops.columns
    rows = ops.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns], F.lit(None).cast("long").alias("version"), F.lit(None).cast("long").alias("seq_no"))
    rows = rows.filter("op <> 'error'")
    if snapshot is not None:
        touched = rows.select(F.col("_index").alias("__i"), F.col("id").alias("__d")).distinct()
        base = snapshot.join(touched, (F.col("_index") == F.col("__i")) & (F.col("_id") == F.col("__d")), "left_semi")
        base = base.select("_index", F.lit(-(1 << 62)).alias("seq"), F.lit("base").alias("op"), F.col("_id").alias("id"), F.col("_source").alias("doc"), F.lit(None).cast("string").alias("upsert"), F.lit(None).cast("string").alias("error"), F.col("_version").alias("version"), F.col("_seq_no").alias("seq_no"))
        rows = rows.unionByName(base)
    rows = rows.select(F.col("_index").alias("name"), "id", F.col("seq").cast("long").alias("seq"), "op", "doc", "upsert", "error", "version", "seq_no")
    return rows.repartition("name", "id").sortWithinPartitions("name", "id", "seq").mapInArrow(_folds, APPLIED)


def after(snapshot: DataFrame | None, applied: DataFrame) -> DataFrame:
    """The snapshot after applied operations: untouched documents and the last state of the others."""
    last = applied.groupBy("_index", "_id").agg(F.max_by(F.struct("_version", "_seq_no", "_source"), "seq").alias("s"))
    new = last.filter("s._source is not null").select("_index", "_id", "s.*")
    if snapshot is None:
        return new
    old = snapshot.join(last.select(F.col("_index").alias("__i"), F.col("_id").alias("__d")), (F.col("_index") == F.col("__i")) & (F.col("_id") == F.col("__d")), "left_anti")
    return old.select(*new.columns).unionByName(new)


def items(applied: DataFrame) -> DataFrame:
    """The answer of a bulk request, an item for each operation."""
    return applied.filter("op <> 'base'").select("seq", "op", "_index", "_id", "status", "result", "error")


def changes(applied: DataFrame, unseen: bool = False) -> DataFrame:
    """What operations changed, as puts and deletes. unseen: there may be documents that they weren't applied to, so deletes of missing ones count."""
    changed = applied.filter("op <> 'base' and error is null" + ("" if unseen else " and result <> 'not_found'"))
    return changed.select("_index", "seq", F.when(F.col("op") == "delete", "del").otherwise("put").alias("op"), F.col("_id").alias("id"), F.col("_source").alias("src"))


def append_log(applied: DataFrame, path: str) -> None:
    changes(applied).write.mode("append").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_index string, seq long, op string, id string, src string").parquet(path)


def read_json_log(spark: SparkSession, path: str, index: str) -> DataFrame:
    """A log of JSON lines {"op", "id", "src"}; lines that can't be read are skipped.

    The order is that of the files' paths and of the lines in them: seq is the number of the split (a part of a file, by path and place) and the line in it,
    whatever order the splits are read in.
    """
    place = [F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b")]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # rises within a split
    lines = spark.read.text(path).select("value", *place, row.alias("__r"))
    splits = spark.read.text(path).select(*place).distinct()  # a row for each split
    splits = splits.select(F.col("__f").alias("__f2"), F.col("__b").alias("__b2"), F.row_number().over(Window.orderBy("__f", "__b")).cast("long").alias("__n"))
    lines = lines.join(splits, (F.col("__f") == F.col("__f2")) & (F.col("__b") == F.col("__b2")))
    lines = lines.select((F.shiftleft("__n", 33) + F.col("__r")).alias("seq"), F.from_json("value", "op string, id string").alias("x"), F.get_json_object("value", "$.src").alias("src"))
    return lines.filter("x.op in ('put', 'del') and x.id is not null and (x.op = 'del' or src is not null)").select(F.lit(index).alias("_index"), "seq", "x.op", "x.id", "src")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """The live documents of a log as puts in a new folder; versions start over."""
    live = latest(read_log(spark, path))
    live.select("_index", F.col("_seq_no").alias("seq"), F.lit("put").alias("op"), F.col("_id").alias("id"), F.col("_source").alias("src")).write.mode("errorifexists").parquet(to)
