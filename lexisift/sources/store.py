"""The documents of a JSON table: a base and a delta of later writes, merged when they are read.

A write adds what it changed to the delta, deletes as rows without a source, so its cost is that of the documents it touches and of the writes since the last
merge; after MERGE_AFTER writes base and delta become a new base. Documents are flattened when they are written, not when they are searched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import documents, oplog
from .shared import settled

MERGE_AFTER = 32


def _flat(rows: DataFrame) -> DataFrame:
    return documents.flattened(rows).drop("_kinds")


def _without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    gone = ids.select(F.col("_index").alias("__i"), F.col("_id").alias("__d"))
    return rows.join(gone, (rows["_index"] == gone["__i"]) & (rows["_id"] == gone["__d"]), "left_anti")


class Store:
    def __init__(self, spark: SparkSession, rows: DataFrame | None = None):
        """rows: a snapshot (oplog.SNAPSHOT)."""
        self.base = _flat(spark.createDataFrame([], oplog.SNAPSHOT)) if rows is None else settled(_flat(rows))
        self.delta: DataFrame | None = None
        self.writes = 0

    def view(self) -> DataFrame:
        """The live documents, with `_values`."""
        if self.delta is None:
            return self.base
        return _without(self.base, self.delta).unionByName(self.delta.filter("_source is not null"))

    def snapshot(self) -> DataFrame:
        return self.view().drop("_values")

    def write(self, applied: DataFrame) -> None:
        """applied: operations with the state after them (oplog.APPLIED)."""
        last = applied.groupBy("_index", "_id").agg(F.max_by(F.struct("_version", "_seq_no", "_source"), "seq").alias("s"))
        self._add(last.select("_index", "_id", "s.*"))

    def remove(self, ids: DataFrame) -> None:
        """ids: (_index, _id)."""
        none = F.lit(None)
        self._add(ids.select("_index", "_id", none.cast("long").alias("_version"), none.cast("long").alias("_seq_no"), none.cast("string").alias("_source")).distinct())

    def _add(self, rows: DataFrame) -> None:
        new = settled(_flat(rows))
        self.delta = new if self.delta is None else settled(_without(self.delta, new).unionByName(new))
        self.writes += 1
        if self.writes >= MERGE_AFTER:
            self.base, self.delta, self.writes = settled(self.view()), None, 0
