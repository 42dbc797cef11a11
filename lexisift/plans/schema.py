"""Mappings: field types, declared or inferred, and where the values of a path are found."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import Values, kind_of, py_string, zone_of

LONGS = {"long", "integer", "short", "byte", "unsigned_long"}
#: What may be shuffled to tokenize it on all cores.
SPREAD_BYTES = 256 << 20
DOUBLES = {"double", "float", "half_float", "scaled_float"}


def normal_type(name: str) -> str:
    if name in ("string", ""):
        return "text"
    return "long" if name in LONGS else "double" if name in DOUBLES else name


def leaves(properties: dict, prefix: str = "") -> dict[str, str]:
    """Path -> type of a mapping's `properties`, sub-fields included."""
    out: dict[str, str] = {}
    for name, spec in properties.items():
        path = f"{prefix}{name}"
        kind = spec.get("type") or ""
        if spec.get("properties"):
            out |= leaves(spec["properties"], f"{path}.")
        elif kind not in ("", "object", "nested"):
            out[path] = normal_type(kind)
        for sub, s in (spec.get("fields") or {}).items():
            out[f"{path}.{sub}"] = normal_type(s.get("type") or "")
    return out


def dynamic_type(kind: str) -> dict:
    """The field that the first value of an unmapped path declares."""
    return {"type": "text", "fields": {"keyword": {"type": "keyword"}}} if kind == "text" else {"type": kind}


def put(properties: dict, path: str, spec: dict) -> None:
    """Place a field at a dotted path, through objects; a leaf on the way is left alone."""
    *heads, last = path.split(".")
    for h in heads:
        properties = properties.setdefault(h, {"properties": {}}).setdefault("properties", {})
    properties.setdefault(last, spec)


def typed_properties(schema: T.StructType) -> dict:
    """The mapping of a typed table: strings are text with a keyword, the other types as they are."""
    out: dict = {}
    for f in schema.fields:
        t = f.dataType
        while isinstance(t, T.ArrayType):
            t = t.elementType
        if isinstance(t, T.StructType):
            out[f.name] = {"properties": typed_properties(t)}
        elif kind := kind_of(t):
            out[f.name] = dynamic_type({"string": "text", "bool": "boolean", "time": "date"}.get(kind, kind))
    return out


def paths_of(schema: T.StructType) -> dict[str, Values]:
    """Dotted path -> stored values, through structs and arrays; nested arrays are one list."""
    out: dict[str, Values] = {}

    def walk(path: str, raw: Column, t: T.DataType, many: bool):
        while isinstance(t, T.ArrayType):
            raw, many, t = (F.flatten(raw), True, t.elementType) if many else (raw, True, t.elementType)
        if isinstance(t, T.StructType):
            for f in t.fields:
                child, deep = raw.getField(f.name), f.dataType
                if many and isinstance(deep, T.ArrayType):
                    child, deep = F.flatten(F.filter(child, lambda x: x.isNotNull())), deep.elementType
                walk(f"{path}.{f.name}", child, deep, many)
        elif kind := kind_of(t):
            out[path] = Values(F.filter(raw, lambda x: x.isNotNull()) if many else raw, kind, many, zone=zone_of(t))

    for f in schema.fields:
        walk(f.name, F.col("`" + f.name.replace("`", "``") + "`"), f.dataType, False)
    return out


@dataclass
class Index:
    """One searchable table. df has `_id` (string) and either typed columns or, in JSON mode, `_source` and `_values`.

    properties: the mapping. stored: the values of typed paths; None in JSON mode. key: the column that `_id` is made of.
    lists: inverted index tables by text field, which searches read instead of the texts.
    """

    name: str
    df: DataFrame
    properties: dict
    stored: dict[str, Values] | None = None
    settings: dict = field(default_factory=dict)
    key: str | None = None
    lists: dict = field(default_factory=dict)

    def __post_init__(self):
        self.types = leaves(self.properties)
        self._splits: int | None = None

    def spread(self, df: DataFrame) -> DataFrame:
        """df over all cores, where a table of up to SPREAD_BYTES comes in fewer splits than there are: tokenizing costs more than moving it. A larger table stays as
        it is read, on clusters of any size. The rows are the same."""
        if self._splits is None and int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
            self._splits = 1 << 30
        if self._splits is None:
            plan = self.df._jdf.queryExecution().executedPlan()
            # only of a plain scan is the number of splits known without running anything
            self._splits = 1 << 30 if plan.nodeName() == "AdaptiveSparkPlan" else self.df._jdf.queryExecution().toRdd().getNumPartitions()
        cores = df.sparkSession.sparkContext.defaultParallelism
        return df.repartition(cores) if self._splits < cores else df

    @property
    def json(self) -> bool:
        return self.stored is None

    def type(self, path: str) -> str:
        return self.types.get(path, "")

    def has_id(self, ids: list) -> Column:
        """Whether a row has one of the ids. They are compared as the stored type, so that the reader knows them; one that no stored value is written as matches nothing."""
        texts = list(dict.fromkeys(map(py_string, ids)))
        kind = self.df.schema[self.key].dataType if self.key in self.df.columns else None
        if isinstance(kind, T.IntegralType):
            bits = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32}.get(type(kind), 64)
            own = [int(t) for t in texts if t.lstrip("-").isascii() and t.lstrip("-").isdigit() and str(int(t)) == t and -(1 << bits - 1) <= int(t) < 1 << bits - 1]
            return F.col(f"`{self.key}`").isin(own) if own else F.lit(False)
        column = F.col(f"`{self.key}`") if isinstance(kind, T.StringType) else F.col("_id")
        return column.isin(texts) if texts else F.lit(False)

    def values(self, path: str) -> Values | None:
        """The values stored under exactly this path."""
        if self.json:
            return Values(F.try_element_at(F.col("_values"), F.lit(path)), "json", True, self.type(path) == "boolean")
        return self.stored.get(path)

    def posted(self, path: str) -> Values | None:
        """The values behind a searchable field: of sub-fields, only `keyword` is filled."""
        if path.endswith(".keyword") and self.type(path) == "keyword" and self.type(path[: -len(".keyword")]) == "text":
            return self.values(path[: -len(".keyword")])
        parent = path.rpartition(".")[0]
        if parent and self.type(parent) == "text" and self.type(path):
            return None
        return self.values(path)

    def or_parent(self, path: str) -> Values | None:
        """As aggregations look fields up: the path, else what comes before its last dot."""
        if self.json:
            own, up = self.values(path), self.values(path.rpartition(".")[0]) if "." in path else None
            if up is None or self.type(path.rpartition(".")[0]) == "":
                return own
            return Values(F.coalesce(own.raw, up.raw), "json", True, up.flags)
        return self.values(path) or (self.values(path.rpartition(".")[0]) if "." in path else None)

    def sortable(self, path: str) -> Values | None:
        base = path.removesuffix(".keyword")
        if self.json and base != path:
            return Values(F.coalesce(self.values(path).raw, self.values(base).raw), "json", True, self.type(base) == "boolean")
        return self.values(path) or self.values(base)

    def under(self, path: str) -> list[Values]:
        """The values of the path and of all paths below it."""
        if self.json:
            return []
        return [v for p, v in self.stored.items() if p == path or p.startswith(f"{path}.")]

    def texts(self) -> list[str]:
        return sorted(p for p, t in self.types.items() if t == "text")

    def source_columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("_id", "_values", "_version", "_seq_no")]
