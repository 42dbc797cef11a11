"""The search pipeline: match, minimal score, aggregations, post filter, sort, page, projection."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Values
from ..plans.compiler import Clause, Context, compile_query, every
from ..plans.schema import Index
from . import aggs as G
from .highlight import highlight
from .sort import order_by, parse_sort, sort_key
from .source_filter import json_filter, keep, patterns

KNOWN = {"query", "from", "size", "sort", "_source", "highlight", "aggs", "aggregations", "post_filter", "min_score", "track_total_hits"}


@dataclass
class SearchResult:
    """Lazy results. hits: the page; matched: all rows after the post filter; aggs: by the path of the node ("a", "a>b")."""

    hits: DataFrame
    matched: DataFrame
    by_score: bool
    tree: G.Tree | None = None
    nodes: list[G.Node] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    with_source: bool = True
    json_source: bool = False
    ignored: list[str] = field(default_factory=list)

    @property
    def aggs(self) -> dict[str, DataFrame]:
        return {p: r.df for p, r in self.tree.results.items()} if self.tree else {}

    @property
    def others(self) -> dict[str, DataFrame]:
        return {p: r.other for p, r in self.tree.results.items() if r.other is not None} if self.tree else {}

    def _summary(self) -> tuple[int, float | None]:
        """Total and greatest score, by one scan."""
        n, most = self.matched.agg(F.count(F.lit(1)), F.max("_score")).first()
        return n, most if self.by_score else None

    @property
    def total(self) -> int:
        return self.matched.count()

    @property
    def max_score(self) -> float | None:
        return self.matched.agg(F.max("_score")).first()[0] if self.by_score else None

    def to_dict(self) -> dict:
        """The response as one document; runs the queries. For pages and bucket lists, which requests bound."""
        rows = self.hits.collect()
        source = [c for c in self.hits.columns if c not in ("_index", "_id", "_score", "sort", "highlight")]
        out = []
        for r in rows:
            hit = {"_index": r["_index"], "_id": r["_id"], "_score": r["_score"] if self.by_score else None}
            if not self.by_score:
                hit["sort"] = [None if k is None else k["num"] if k["num"] is not None else k["str"] for k in r["sort"]]
            if self.with_source:
                hit["_source"] = json.loads(r["_source"]) if self.json_source else {c: plain(r[c]) for c in source if r[c] is not None}
            if "highlight" in self.hits.columns and r["highlight"]:
                hit["highlight"] = r["highlight"]
            out.append(hit)
        total, most = self._summary()
        env = {"timed_out": False, "hits": {"total": {"value": total, "relation": "eq"}, "max_score": most if rows else None, "hits": out}}
        if self.tree:
            # the columns that aggregations read are kept for all nodes of the request, in memory or on disk; a lost part is made again
            self.tree.rows.persist()
            try:
                held = {p: [r.asDict() for r in x.df.collect()] for p, x in self.tree.results.items()}
                rest = {p: [r.asDict() for r in x.collect()] for p, x in self.others.items()}
            finally:
                self.tree.rows.unpersist()
            env["aggregations"] = {n.name: self._agg(n, {}, held, rest) for n in self.nodes}
        return env

    def _agg(self, n: G.Node, above: dict, held: dict, rest: dict):
        if n.metric:
            return _metric_value(n, held[n.path][0][n.name])
        keys = self.tree.results[n.path].keys
        mine = [r for r in held[n.path] if all(r[k] == above[k] for k in keys)]
        label = self.tree._label(n, keys)

        def bucket(r: dict) -> dict:
            out = {k: r[k] for k in ("key", "key_as_string", "from", "to", "doc_count") if r.get(k) is not None}
            if n.kind == "terms":
                out["key"] = self._typed_key(n, r["key"])
            for c in n.children:
                out[c.name] = _metric_value(c, r[c.name]) if c.metric else self._agg(c, above | {label: r["key"]}, held, rest)
            return out

        made = [bucket(r) for r in mine]
        if n.kind in ("filter", "global"):
            return {k: v for k, v in made[0].items() if k != "key"} if made else {"doc_count": 0}
        if n.kind == "filters":
            return {"buckets": {b["key"]: {k: v for k, v in b.items() if k != "key"} for b in made}}
        out: dict = {"buckets": made}
        if n.kind == "terms":
            other = [r["sum_other_doc_count"] for r in rest[n.path] if all(r[k] == above[k] for k in keys)]
            out = {"doc_count_error_upper_bound": 0, "sum_other_doc_count": other[0] if other else 0} | out
        return out

    def _typed_key(self, n: G.Node, key: str):
        kind = self.tree.typed(n.body.get("field", ""))
        try:
            return float(key) if kind in ("long", "double") else key == "true" if kind == "boolean" and key in ("true", "false") else key
        except ValueError:
            return key


def _metric_value(n: G.Node, v):
    return v.asDict() if n.kind == "stats" else {"value": v}


def plain(v):
    """A Row, date or decimal as JSON has it."""
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v if isinstance(v, (str, bool, int, float, dict)) else str(v)


def search(spark: SparkSession, indices: list[Index], body: dict) -> SearchResult:
    specs = parse_sort(body.get("sort"))
    nodes = G.parse(body.get("aggs", body.get("aggregations")))
    wanted, includes, excludes = patterns(body.get("_source"))
    least = float(body.get("min_score") or 0)
    sides = [_Side(x, body, nodes, specs, least, (wanted, includes, excludes)) for x in indices]
    if not sides:
        empty = spark.createDataFrame([], "_index string, _id string, _score double")
        return SearchResult(empty, empty, specs is None, names=[], with_source=wanted)
    keys = [f"__k{i}" for i in range(len(specs or []))]
    hits = _union([s.hits for s in sides])
    start, size = max(0, int(body.get("from") or 0)), int(body["size"]) if body.get("size") is not None else 10
    page = hits.orderBy(*order_by(specs, keys))
    page = page.offset(start) if start else page
    page = page.limit(size) if size >= 0 else page
    shown = [c for c in page.columns if not c.startswith("__")]
    if specs is not None:
        page = page.select(*[F.col(f"`{c}`") for c in shown], F.array(*keys).alias("sort"))
    else:
        page = page.select(*[F.col(f"`{c}`") for c in shown])
    matched = hits.select("_index", "_id", "_score")
    tree = None
    if nodes:
        columns = _columns(sides, nodes)
        tree = G.Tree(nodes, _union([s.rows(columns) for s in sides]), columns, lambda: _union([s.everything(columns) for s in sides]), lambda f: next((t for s in sides if (t := s.index.type(f) or s.index.type(f.rpartition(".")[0]))), ""))
    return SearchResult(page, matched, specs is None, tree, nodes, [x.name for x in indices], wanted, any(x.json for x in indices), sorted(set(body) - KNOWN))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


class _Side:
    """The part of a request that one table answers."""

    def __init__(self, index: Index, body: dict, nodes: list[G.Node], specs, least: float, source):
        self.index, self.ctx, self.nodes = index, Context(index), nodes
        self.query = compile_query(self.ctx, body.get("query"))
        post = compile_query(self.ctx, body["post_filter"]) if body.get("post_filter") else None
        self.flags = {need: self._flag(need) for need in G.needs(nodes) if need.form == "q"}
        self.least = least
        self.matched = self._match(self.query)
        df = self.matched.filter(post.match) if post is not None else self.matched
        wanted, includes, excludes = source
        top = index.source_columns() if wanted else []
        chosen = [F.col("`" + c + "`") for c in (top if index.json else keep(top, includes, excludes))]
        if index.json and wanted and (includes or excludes):
            chosen = [json_filter(includes, excludes)(F.col("_source")).alias("_source")]
        extra = [sort_key(index, s, F.col("_score")).alias(f"__k{i}") for i, s in enumerate(specs or [])]
        if body.get("highlight"):
            marks = highlight(index, body["highlight"], body.get("query"))
            extra.append((F.lit(None).cast("map<string,array<string>>") if marks is None else marks).alias("highlight"))
        self.hits = df.select(F.lit(index.name).alias("_index"), "_id", "_score", *[c for c in chosen], *extra)

    def _match(self, q: Clause) -> DataFrame:
        df = self.ctx.frame(q.plain)
        if not q.exact:
            df = df.filter(q.match)
        df = df.withColumn("_score", q.score.cast("double"))
        return df.filter(~(F.col("_score") < self.least))

    def _flag(self, need: G.Need) -> Column:
        path, _, name = need.what.partition("\0")
        node = next(n for n in G.walk(self.nodes) if n.path == path)
        return compile_query(self.ctx, node.body["filters"][name] if name else node.body).match

    def value(self, need: G.Need) -> tuple[Column | None, bool]:
        if need.form == "q":
            return self.flags[need], False
        v: Values | None = self.index.or_parent(need.what)
        if v is None:
            return None, False
        return {"s": v.strings, "n": v.numbers, "d": v.millis, "c": v.count}[need.form](), v.many and need.form != "c"

    def _helpers(self, df: DataFrame, columns: dict[G.Need, tuple[str, bool]]) -> DataFrame:
        out = []
        for need, (name, many) in columns.items():
            x, own = self.value(need)
            kind = {"s": "string", "n": "double", "d": "long", "c": "int", "q": "boolean"}[need.form]
            if x is None:
                x = F.lit(None).cast(f"array<{kind}>" if many else kind)
            elif many and not own:
                x = F.array_compact(F.array(x))
            out.append(x.alias(name))
        return df.select(F.lit(self.index.name).alias("_index"), *out)

    def rows(self, columns) -> DataFrame:
        return self._helpers(self.matched, columns)

    def everything(self, columns) -> DataFrame:
        return self._helpers(self.ctx.frame(every().plain), columns)


def _columns(sides: list[_Side], nodes: list[G.Node]) -> dict[G.Need, tuple[str, bool]]:
    """A column for each thing the tree reads; an array if it is one in any table."""
    return {need: (f"__a{i}", any(s.value(need)[1] for s in sides)) for i, need in enumerate(G.needs(nodes))}
