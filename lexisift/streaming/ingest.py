"""Structured Streaming of operations into a log: micro-batches of bulk bodies or operations are appended as they come.

There is no event time and nothing is late: the last operation of an id wins, in the order of micro-batches, of requests in them and of
operations in a request. A batch that runs again after a failure writes the same rows under its own folder, which it replaces, so the log holds each
operation once. Creates and partial updates need the document that they meet: it is read from what earlier batches logged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import oplog


def applied(ops: DataFrame, batch: int, log: DataFrame | None = None) -> DataFrame:
    """Operations with their outcome (oplog.APPLIED). ops: (_index, request, ordinal, op, id, doc, upsert, error); request, upsert and error may be missing.

    seq orders batches, then the requests and operations on one id (2**40 of them in a batch). log: what earlier batches logged.
    """
    for name, kind in (("request", "long"), ("upsert", "string"), ("error", "string")):
        if name not in ops.columns:
            ops = ops.withColumn(name, F.lit(None).cast(kind))
    own = Window.partitionBy("_index", "id").orderBy(F.coalesce("request", F.lit(0).cast("long")), "ordinal")
    ops = ops.withColumn("seq", F.shiftleft(F.lit(batch).cast("long"), 40) + F.row_number().over(own))
    held = None
    if log is not None:
        ids = ops.select(F.col("_index").alias("__i"), F.col("id").alias("__d")).distinct()
        held = oplog.latest(log.join(ids, (F.col("_index") == F.col("__i")) & (F.col("id") == F.col("__d")), "left_semi"))
    return oplog.apply_operations(held, ops)


def stream_log(ops: DataFrame, path: str, checkpoint: str, then: Callable[[int], None] | None = None, items: str | None = None) -> StreamingQuery:
    """Append a stream of operations (see `applied`) to the log folders under `path`, one a batch. items: a folder for the outcome of each operation.

    Requests of one micro-batch need a rising `request` if they touch the same id; without it, ordinals must rise over the batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            log = None
            if number and (items or batch.filter("op in ('create', 'update')").limit(1).count()):
                log = spark.read.schema("_index string, seq long, op string, id string, src string, batch long").parquet(path).filter(F.col("batch") < number).drop("batch")
            done = applied(batch, number, log)
            oplog.changes(done, unseen=log is None).write.mode("overwrite").parquet(f"{path}/batch={number}")
            if items:
                oplog.items(done).write.mode("overwrite").parquet(f"{items}/batch={number}")
        finally:
            batch.unpersist()
        if then:
            then(number)

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
