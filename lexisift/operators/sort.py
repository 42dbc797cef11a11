"""Sort specifications and keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.schema import Index

FIRST = 1e308


@dataclass(frozen=True)
class SortSpec:
    field: str
    desc: bool
    missing: str = "_last"


def parse_sort(raw) -> list[SortSpec] | None:
    """None: by score. A bare "_score" string sorts ascending, its object form descending."""
    if raw is None:
        return None
    specs: list[SortSpec] = []
    for item in raw if isinstance(raw, list) else [raw]:
        if isinstance(item, str):
            name, order = item, "asc"
            if item.find(":") > 0:
                name, _, order = item.partition(":")
            specs.append(SortSpec(name, order != "asc" if name == "_score" else order == "desc"))
        elif isinstance(item, dict):
            for name, o in item.items():
                desc, missing = name == "_score", "_last"
                if isinstance(o, str):
                    desc = o == "desc"
                elif isinstance(o, dict):
                    desc = o["order"] == "desc" if isinstance(o.get("order"), str) else desc
                    missing = o["missing"] if isinstance(o.get("missing"), str) else missing
                specs.append(SortSpec(name, desc, missing))
    if not specs or (len(specs) == 1 and specs[0].field == "_score" and specs[0].desc):
        return None
    return specs


def sort_key(index: Index, spec: SortSpec, score: Column) -> Column:
    """struct(num, str): the number of a value that has one, else its string; of many values the least, or greatest if descending."""
    none = F.struct(F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str"))
    if spec.field == "_score":
        return F.struct(score.cast("double").alias("num"), F.lit(None).cast("string").alias("str"))
    v = index.sortable(spec.field)
    out = none
    if v is not None:
        pick = F.array_max if spec.desc else F.array_min
        num = pick(v.numbers()) if v.many else v.numbers()
        text = v.kind in ("string", "json")
        string = (pick(v.strings()) if v.many else v.strings()) if text else F.lit(None).cast("string")
        out = F.struct(num.alias("num"), F.when(num.isNull(), string).alias("str"))
    if spec.missing == "_first":
        sentinel = FIRST if spec.desc else -FIRST
        first = F.struct(F.lit(sentinel).alias("num"), F.lit(None).cast("string").alias("str"))
        if v is not None and v.kind == "string":  # beside strings the sentinel compares by its digits
            first = F.struct(F.lit(None).cast("double").alias("num"), F.lit(f"{sentinel:020.6f}").alias("str"))
        out = F.when(out["num"].isNull() & out["str"].isNull(), first).otherwise(out)
    return out


def order_by(specs: list[SortSpec] | None, keys: list[str]) -> list[Column]:
    tail = [F.col("_index").asc(), F.col("_id").asc()]
    if specs is None:
        return [F.col("_score").desc(), *tail]
    out = []
    for spec, k in zip(specs, keys):
        num, text = F.col(f"{k}.num"), F.col(f"{k}.str")
        out += [num.desc_nulls_last(), text.desc_nulls_last()] if spec.desc else [num.asc_nulls_last(), text.asc_nulls_last()]
    return [*out, *tail]
