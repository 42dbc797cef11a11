"""JSON documents: flattening to dotted paths, dynamic mapping and partial updates.

Number literals are kept as written, which Spark's JSON reader doesn't, so these three run in Python over
Arrow batches; everything after them is in JVM expressions over the flattened values.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import py_date_millis
from ..plans.schema import dynamic_type, leaves, put

FLAT = "values map<string,array<string>>, kinds map<string,string>"


class Literal(str):
    """A number as it is written."""

    __slots__ = ()


def parse(raw: str):
    return json.loads(raw, parse_int=Literal, parse_float=Literal, parse_constant=Literal)


def dump(v) -> str:
    """JSON text, numbers as they were written."""
    if isinstance(v, Literal):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dump, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def flatten(doc: dict) -> dict[str, list]:
    """Path -> leaf values: arrays add to their path, nulls and empty containers leave nothing."""
    out: dict[str, list] = {}

    def walk(path: str, v) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                walk(f"{path}.{k}" if path else k, x)
        elif isinstance(v, list):
            for x in v:
                walk(path, x)
        elif v is not None:
            out.setdefault(path, []).append(v)

    walk("", doc)
    return out


def kind_of(v) -> str:
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, Literal):
        return "double" if set(v) & set(".eE") else "long"
    return "text" if py_date_millis(v) is None else "date"


def deep_merge(base: dict, over: dict) -> dict:
    """Objects merge into objects; anything else, null included, replaces."""
    for k, v in over.items():
        base[k] = deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v
    return base


def merge_json(base: str, over: str) -> str:
    return dump(deep_merge(parse(base), parse(over)))


def _flat(sources: pd.Series) -> pd.DataFrame:
    values, kinds = [], []
    for raw in sources:
        try:
            doc = parse(raw) if raw is not None else {}
        except ValueError:
            doc = {}
        flat = flatten(doc) if isinstance(doc, dict) else {}
        values.append({p: [str(x).lower() if isinstance(x, bool) else str(x) for x in v] for p, v in flat.items()})
        kinds.append({p: kind_of(v[0]) for p, v in flat.items()})
    return pd.DataFrame({"values": values, "kinds": kinds})


def flattened(docs: DataFrame) -> DataFrame:
    """docs with `_values` (path -> literals) and `_kinds` (path -> kind of the first value) of `_source`."""
    return docs.withColumn("__flat", F.pandas_udf(_flat, FLAT)("_source")).select("*", F.col("__flat.values").alias("_values"), F.col("__flat.kinds").alias("_kinds")).drop("__flat")


def infer(docs: DataFrame, properties: dict | None = None, seq: str = "_seq_no") -> dict:
    """The mapping after docs: an unmapped path gets the type of the first value seen, in the order of seq. A row for each path is collected."""
    out = json.loads(json.dumps(properties or {}))
    first = docs.select(seq, F.explode("_kinds").alias("path", "kind")).groupBy("path").agg(F.min_by("kind", seq).alias("kind"), F.min(seq).alias("seq"))
    for r in sorted(first.collect(), key=lambda r: (r["seq"], r["path"])):
        if not leaves(out).get(r["path"]):
            put(out, r["path"], dynamic_type(r["kind"]))
    return out
