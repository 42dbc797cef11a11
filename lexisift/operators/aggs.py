"""The aggregation tree: one grouped aggregate for each bucket node, its metrics in the same pass.

Every node's result is a DataFrame with a row a bucket: a column for the key of each bucket above it (named as
that node), `key`, `doc_count` and a column for each metric below. A tree is addressed by "a>b" paths. Documents aren't kept by
bucket: below a bucket, rows are grouped by the keys on the way down. Only a multi-valued bucket field is exploded, and values of
multi-valued metric fields are reduced within their row first, so that no level counts a row twice.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import option, py_number, py_string, py_text, truncated, utc_text
from ..plans.compiler import QueryError

METRICS = ("min", "max", "avg", "sum", "stats", "value_count", "cardinality")
BUCKETS = ("terms", "filter", "filters", "range", "histogram", "date_histogram", "global")
UNITS = {"year": "year", "1y": "year", "month": "month", "1M": "month", "week": "week", "1w": "week", "hour": "hour", "1h": "hour", "minute": "minute", "1m": "minute"}


@dataclass
class Node:
    name: str
    kind: str
    body: dict
    children: list[Node] = field(default_factory=list)
    path: str = ""

    @property
    def metric(self) -> bool:
        return self.kind in METRICS


def parse(aggs: dict | None, above: str = "") -> list[Node]:
    out = []
    for name, spec in (aggs or {}).items():
        kinds = [k for k in spec if k not in ("aggs", "aggregations", "meta")]
        if len(kinds) != 1:
            raise QueryError(f"aggregation [{name}]: one type is wanted")
        kind, path = kinds[0], f"{above}>{name}" if above else name
        if kind not in METRICS + BUCKETS:
            raise QueryError(f"unknown aggregation [{kind}]")
        if kind == "filters" and not isinstance(spec[kind].get("filters"), dict):
            raise QueryError("filters: a map of named filters is wanted")
        if kind == "histogram" and option(spec[kind], "interval", 0) <= 0:
            raise QueryError("histogram: the interval must be above 0")
        sub = spec.get("aggs", spec.get("aggregations")) if not kind in METRICS else None  # noqa: E713
        out.append(Node(name, kind, spec[kind] or {}, parse(sub, path), path))
    return out


def walk(nodes: list[Node]):
    for n in nodes:
        yield n
        yield from walk(n.children)


@dataclass(frozen=True)
class Need:
    """A column that the tree reads: form s (strings), n (numbers), d (date millis), c (number of values) or q (a query's match)."""

    form: str
    what: str


def needs(nodes: list[Node]) -> list[Need]:
    out: dict[Need, None] = {}
    for n in walk(nodes):
        path = py_text(n.body.get("field")) if n.kind not in ("filter", "filters", "global") else ""
        if n.kind in ("terms", "cardinality"):
            out[Need("s", path)] = None
        elif n.kind == "date_histogram":
            out[Need("d", path)] = None
        elif n.kind == "value_count":
            out[Need("c", path)] = None
        elif n.kind in ("range", "histogram", "min", "max", "avg", "sum", "stats"):
            out[Need("n", path)] = None
        elif n.kind == "filter":
            out[Need("q", f"{n.path}")] = None
        elif n.kind == "filters":
            for k in n.body["filters"]:
                out[Need("q", f"{n.path}\0{k}")] = None
    return list(out)


@dataclass
class Result:
    """kind and columns of one node's DataFrame; other: for terms, the documents beyond the returned buckets (by the keys above)."""

    node: Node
    df: DataFrame
    keys: list[str]
    other: DataFrame | None = None


class Tree:
    """columns: where each Need is found, and whether it is an array. every: the rows for `global`."""

    def __init__(self, nodes: list[Node], rows: DataFrame, columns: dict[Need, tuple[str, bool]], every: Callable[[], DataFrame], typed: Callable[[str], str]):
        self.rows, self.columns, self.every, self.typed = rows, columns, every, typed
        self.results: dict[str, Result] = {}
        self.taken: list[str] = []
        metrics = [n for n in nodes if n.metric]
        if metrics:
            df = self._metrics_only(rows, metrics)
            for n in metrics:
                self.results[n.path] = Result(n, df.select(F.col(n.name)), [])
        for n in nodes:
            if not n.metric:
                self._bucket(n, rows, [])

    def _at(self, form: str, what: str) -> tuple[Column, bool]:
        name, many = self.columns[Need(form, what)]
        return F.col(name), many

    # --- metrics

    def _metric(self, n: Node, on: Column | None = None) -> Column | None:
        """An aggregate over the rows where `on` holds; None for a distinct count over many-valued rows."""
        path = py_text(n.body.get("field"))
        pick = (lambda x: x) if on is None else (lambda x: F.when(on, x))
        if n.kind == "value_count":
            return F.coalesce(F.sum(pick(self._at("c", path)[0])), F.lit(0)).cast("long").alias(n.name)
        if n.kind == "cardinality":
            s, many = self._at("s", path)
            return None if many else F.count_distinct(pick(s)).alias(n.name)
        x, many = self._at("n", path)
        if many:
            x = F.array_compact(x)
            low, high, total, count = F.array_min(x), F.array_max(x), F.aggregate(x, F.lit(0.0), lambda a, v: a + v), F.coalesce(F.size(x), F.lit(0))
            total = F.when(count > 0, total)
        else:
            low, high, total, count = x, x, x, x.isNotNull().cast("int")
        low, high, total, count = F.min(pick(low)), F.max(pick(high)), F.sum(pick(total)), F.coalesce(F.sum(pick(count)), F.lit(0)).cast("long")
        mean = F.when(count > 0, F.try_divide(total, count))
        out = {"min": low, "max": high, "sum": total, "avg": mean}.get(n.kind)
        if out is None:
            out = F.struct(count.alias("count"), low.alias("min"), high.alias("max"), mean.alias("avg"), F.coalesce(total, F.lit(0.0)).alias("sum"))
        return out.alias(n.name)

    def _distincts(self, df: DataFrame, rows: DataFrame, metrics: list[Node], keys: list[str]) -> DataFrame:
        """Adds distinct counts of many-valued fields: the only metrics that need rows of their own."""
        for n in metrics:
            s, many = self._at("s", py_text(n.body.get("field"))) if n.kind == "cardinality" else (None, False)
            if many:
                own = rows.select(*keys, F.explode(s).alias("__v")).groupBy(*keys).agg(F.count_distinct("__v").alias(n.name))
                df = self._left(df, own, keys).withColumn(n.name, F.coalesce(n.name, F.lit(0)).cast("long")) if keys else df.crossJoin(F.broadcast(own))  # one row: no groups
        return df

    def _metrics_only(self, rows: DataFrame, metrics: list[Node]) -> DataFrame:
        plain = [m for n in metrics if (m := self._metric(n)) is not None]
        df = rows.agg(*plain, F.count(F.lit(1)).alias("__rows"))
        return self._distincts(df, rows, metrics, [])

    # --- buckets

    def _bucket(self, n: Node, rows: DataFrame, keys: list[str]) -> None:
        metrics, below = [c for c in n.children if c.metric], [c for c in n.children if not c.metric]
        if n.kind in ("filter", "filters", "range", "global"):
            self._flags(n, rows, keys, metrics, below)
        else:
            self._grouped(n, rows, keys, metrics, below)

    def _keyed(self, n: Node) -> tuple[Column, bool]:
        """The key of a row, or an array of its distinct keys."""
        path = py_text(n.body.get("field"))
        if n.kind == "terms":
            s, many = self._at("s", path)
            return (F.array_distinct(s), True) if many else (s, False)
        if n.kind == "histogram":
            x, many = self._at("n", path)
            step = option(n.body, "interval", 0)
            f = lambda v: F.floor(v / step) * F.lit(step)
        else:
            x, many = self._at("d", path)
            unit = UNITS.get(next((py_text(n.body.get(k)) for k in ("calendar_interval", "fixed_interval", "interval") if py_text(n.body.get(k))), ""), "day")
            f = lambda v: truncated(v, unit)
        return (F.array_distinct(F.transform(F.array_compact(x), f)), True) if many else (f(x), False)

    def _grouped(self, n: Node, rows: DataFrame, keys: list[str], metrics: list[Node], below: list[Node]) -> None:
        key, many = self._keyed(n)
        label = self._label(n, keys)
        rows = rows.withColumn(label, F.explode(key) if many else key)
        if not many:
            rows = rows.filter(F.col(label).isNotNull())
        plain = [m for c in metrics if (m := self._metric(c)) is not None]
        df = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("doc_count"), *plain)
        df, other = self._top(n, df, keys, label) if n.kind == "terms" else (df.orderBy(*keys, label), None)
        if n.kind == "terms" and (below or any(self._at("s", py_text(c.body.get("field")))[1] for c in metrics if c.kind == "cardinality")):
            rows = self._semi(rows, df.select(*keys, label), [*keys, label])
        df = self._distincts(df, rows, metrics, [*keys, label])
        if n.kind == "terms":
            df = df.orderBy(*keys, *self._order(n, label))
        out = df
        if n.kind == "date_histogram":
            stamp = utc_text(F.col(label), "T", "Z", always=True)
            out = df.select(*keys, F.col(label).alias("key"), stamp.alias("key_as_string"), "doc_count", *[c.name for c in metrics])
        else:
            out = df.select(*keys, F.col(label).alias("key"), "doc_count", *[c.name for c in metrics])
        self.results[n.path] = Result(n, out, keys, other)
        for c in below:
            self._bucket(c, rows, [*keys, label])

    def _label(self, n: Node, keys: list[str]) -> str:
        name = n.name
        while name in keys or name in self.taken or name in ("key", "doc_count"):
            name += "_"
        return name

    def _order(self, n: Node, label: str) -> list[Column]:
        """By count, equal counts by key upwards in either direction, or by key as a string."""
        by, asc = "_count", False
        if isinstance(n.body.get("order"), dict):
            for k, v in n.body["order"].items():
                by, asc = k, py_text(v) == "asc"
        if by == "_key":
            return [F.col(label).asc() if asc else F.col(label).desc()]
        return [F.col("doc_count").asc() if asc else F.col("doc_count").desc(), F.col(label).asc()]

    def _top(self, n: Node, df: DataFrame, keys: list[str], label: str) -> tuple[DataFrame, DataFrame]:
        size = int(option(n.body, "size", 10))
        size = size if size > 0 else 10
        total = df.groupBy(*keys).agg(F.sum("doc_count").alias("__all"))
        if keys:
            top = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*self._order(n, label)))).filter(F.col("__r") <= size).drop("__r")
        else:
            top = df.orderBy(*self._order(n, label)).limit(size)
        kept = top.groupBy(*keys).agg(F.sum("doc_count").alias("__top"))
        both = self._left(total, kept, keys) if keys else total.crossJoin(F.broadcast(kept))  # one row each: no groups
        return top, both.select(*keys, F.coalesce(F.col("__all") - F.coalesce("__top", F.lit(0)), F.lit(0)).alias("sum_other_doc_count"))

    def _left(self, a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
        renamed = b.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)})
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{i}")) for i, k in enumerate(keys)])
        return a.join(renamed, on, "left").drop(*[f"__r_{i}" for i in range(len(keys))])

    def _semi(self, rows: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
        kept = kept.select(*[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)])
        on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)])
        return rows.join(kept, on, "left_semi")

    def _conditions(self, n: Node) -> list[tuple[str, Column, dict]]:
        """(key, whether a row is in the bucket, what else the bucket shows)."""
        if n.kind == "global":
            return [("global", F.lit(True), {})]
        if n.kind == "filter":
            return [("filter", self._at("q", n.path)[0], {})]
        if n.kind == "filters":
            return [(k, self._at("q", f"{n.path}\0{k}")[0], {}) for k in sorted(n.body["filters"])]
        x, many = self._at("n", py_text(n.body.get("field")))
        if many:
            x = F.get(F.array_compact(x), F.lit(0))
        out = []
        for r in n.body.get("ranges") or []:
            if not isinstance(r, dict):
                continue
            lo, hi = (None if r.get(k) is None else py_number(r[k]) or 0.0 for k in ("from", "to"))
            c = x.isNotNull()
            c = c if lo is None else c & (x >= lo)
            c = c if hi is None else c & (x < hi)
            key = r["key"] if isinstance(r.get("key"), str) else f"{_edge(lo)}-{_edge(hi)}"
            out.append((key, F.coalesce(c, F.lit(False)), {"from": lo, "to": hi}))
        return out

    def _global_below(self, n: Node, rows: DataFrame, keys: list[str]) -> None:
        """All documents again for each bucket above: aggregated once, and the finished buckets repeated for each."""
        outer, self.results = self.results, {}
        taken, self.taken = self.taken, [*self.taken, *keys]
        self._flags(n, rows, [], [c for c in n.children if c.metric], [c for c in n.children if not c.metric])
        inner, self.results, self.taken = self.results, outer, taken
        above = rows.select(*keys).distinct()

        def repeated(df: DataFrame) -> DataFrame:
            out = df.withColumn("__o", F.monotonically_increasing_id()).crossJoin(above)  # rows of bucket lists on both sides, no documents
            return out.orderBy(*keys, "__o").select(*keys, *df.columns)

        for path, r in inner.items():
            self.results[path] = Result(r.node, repeated(r.df), [*keys, *r.keys], repeated(r.other) if r.other is not None else None)

    def _flags(self, n: Node, rows: DataFrame, keys: list[str], metrics: list[Node], below: list[Node]) -> None:
        """Buckets that are known beforehand: conditional aggregates in one pass, so empty ones stay."""
        if n.kind == "global" and keys:
            return self._global_below(n, rows, keys)
        if n.kind == "global":
            rows = self.every()
        conditions = self._conditions(n)
        label, columns, places, many = self._label(n, keys), [], [], []
        if not conditions:
            conditions = [("", F.lit(False), {})]
        flags = [f"__b{len(keys)}_{i}" for i in range(len(conditions))]
        rows = rows.withColumns({f: c for f, (_, c, _) in zip(flags, conditions)})
        for i, (key, _, more) in enumerate(conditions):
            on, own = F.col(flags[i]), []
            columns.append(F.count_if(on).alias(f"__c{i}"))
            for c in metrics:
                m = self._metric(c, on)
                if m is None:
                    many.append((i, c))  # counted below, from rows of their own
                else:
                    columns.append(m.alias(f"__m{i}_{c.name}"))
                own.append(F.col(f"__m{i}_{c.name}").alias(c.name))
            edges = [F.lit(more[e]).cast("double").alias(e) for e in ("from", "to") if n.kind == "range"] if more or n.kind != "range" else [F.lit(None).cast("double").alias(e) for e in ("from", "to")]
            places.append(F.struct(F.lit(i).alias("__i"), F.lit(key).alias("key"), *edges, F.col(f"__c{i}").alias("doc_count"), *own))
        df = (rows.groupBy(*keys) if keys else rows).agg(*columns)
        for i, c in many:
            name = f"__m{i}_{c.name}"
            each = rows.filter(flags[i]).select(*keys, F.explode(self._at("s", py_text(c.body.get("field")))[0]).alias("__v"))
            each = (each.groupBy(*keys) if keys else each).agg(F.count_distinct("__v").alias(name))
            df = self._left(df, each, keys).withColumn(name, F.coalesce(name, F.lit(0)).cast("long")) if keys else df.crossJoin(F.broadcast(each))  # one row: no groups
        df = df.select(*keys, F.explode(F.array(*places)).alias("__b")).select(*keys, "__b.*").orderBy(*keys, "__i").drop("__i")
        if n.kind == "range" and not (n.body.get("ranges") or []):
            df = df.limit(0)
        self.results[n.path] = Result(n, df, keys)
        if below:
            inside = F.array_compact(F.array(*[F.when(F.col(f), F.lit(i)) for i, f in enumerate(flags)]))
            names = F.array(*[F.lit(k) for k, _, _ in conditions])
            split = rows.withColumn(label, F.explode(F.transform(inside, lambda i: F.get(names, i))))
            for c in below:
                self._bucket(c, split, [*keys, label])


def _edge(x: float | None) -> str:
    if x is None:
        return "*"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    return f"{x:.1f}" if x == int(x) else _shortest(x)


def _shortest(x: float) -> str:
    """The fewest digits that give x back, with an exponent below 1e-4 and from 1e21 on."""
    if 1e-4 <= abs(x) < 1e21:
        return py_string(x)
    m, _, e = repr(x).partition("e")
    return f"{m}e{int(e):+03d}"
