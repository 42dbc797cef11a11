"""Exact ranks in skewed groups: each row's place among the rows of its group in a pseudo-random order.

A group is cut into hash ranges, so that a hot group is no larger a task than the others. The ranges are
counted (partial sums before the shuffle) and their running counts joined to the rows, which the window
has already placed by (group, range): the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_RANGE = 20_000


def group_key(x: Column) -> Column:
    """A string that is never null: '' for null, else '=' and the value."""
    return F.when(x.isNull(), "").otherwise(F.concat(F.lit("="), x.cast("string")))


def ranked(df: DataFrame, group: str, order: str, ties: list[Column], rows: int, more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df with `__rank`, from 0 in its group, by the hash column `order` and then ties.

    rows: the number of rows of df, for the number of ranges. group must not be null. more: adds columns to
    the spans (group, __range, __before, __n: ranks __before to __before + __n - 1), which the rows then have too.
    """
    ranges = max(1, -(-rows // PER_RANGE))
    keyed = df.withColumn("__range", F.pmod(F.shiftrightunsigned(order, 20), F.lit(ranges)))
    spans = keyed.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    spans = spans.withColumn("__before", F.sum("__n").over(Window.partitionBy(group).orderBy("__range")) - F.col("__n"))
    spans = more(spans) if more else spans
    spans = spans.select(F.col(group).alias("__g"), F.col("__range").alias("__r"), *[c for c in spans.columns if c not in (group, "__range", "__n")])
    own = Window.partitionBy(group, "__range").orderBy(order, *ties)
    out = keyed.withColumn("__i", F.row_number().over(own) - 1)
    out = out.join(spans, (out[group] == spans["__g"]) & (out["__range"] == spans["__r"]))
    return out.withColumn("__rank", F.col("__before") + F.col("__i")).drop("__g", "__r", "__i", "__before", "__range")
