"""Queries as column expressions: a predicate and a score over one scan of a table.

A clause is (match, score, plain). `plain` are predicates over stored columns only that `match` implies; they are
applied to the scan itself, before any text is tokenized, so that they reach the Parquet reader.

What a clause needs beside the stored columns is registered in the Context: token arrays of text fields, made once a
row, and statistics of the whole table (document frequencies, lengths, fuzzy candidates), made by one
aggregate that gives one row, whatever the table holds. A text field with an inverted index table (Index.lists) isn't tokenized: its clauses
are columns that are aggregated by document from the lists of the request's terms, and joined by id; the statistics come from those tables too.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions.values import Values, option, py_number, py_string, py_text
from .schema import Index

K1, B = 1.2, 0.75
POSTING_BYTES = 1024
#: Spellings of a keyword that are looked up as they are stored; beyond it, rows are folded one by one.
VARIANTS = 1000


class QueryError(ValueError):
    """A request that can't be understood."""


@dataclass(frozen=True)
class Clause:
    match: Column
    score: Column
    plain: tuple[Column, ...] = ()
    exact: bool = False  # match is the conjunction of plain

    @staticmethod
    def of(test: Column, boost: float = 1.0, plain: bool = True) -> Clause:
        """A constant score where test is true. On the scan the test stands as it is: a null there is as good as false, and the reader knows it."""
        return Clause(F.coalesce(test, F.lit(False)), F.lit(float(boost)), (test,) if plain else (), plain)

    def bare(self) -> Column:
        """The conjunction of plain."""
        return _all(self.plain)


def nothing() -> Clause:
    return Clause.of(F.lit(False))


def every(boost: float = 1.0) -> Clause:
    return Clause(F.lit(True), F.lit(float(boost)), (), True)


class Context:
    """What the clauses of a request need of one table."""

    def __init__(self, index: Index):
        self.index = index
        taken = {c.lower() for c in index.df.columns}
        self.prefix = "__"
        while any(c.startswith(self.prefix) for c in taken):
            self.prefix += "_"
        self.arrays: dict[str, tuple[str, Values]] = {}
        self.joined: dict[str, str] = {}
        self.counts: dict[tuple[str, str | None], str] = {}
        self.aggregates: dict[str, tuple[str, Column]] = {}
        self.fuzzy: dict[tuple, str] = {}
        self.lists: dict[str, dict[tuple, tuple[str, Column, Column]]] = {}
        self.near: dict[tuple, str] = {}
        self.list_stats: dict[str, dict[str, tuple[str, Column]]] = {}
        self.known: dict[tuple[str, str], list[str] | None] = {}

    # --- registered columns

    def stored(self, path: str, v: Values, values: list[str]) -> None:
        """Finds what the column of a keyword holds of these strings: each itself, or else those that are equal when folded (None: more than VARIANTS).

        A scan of that column, which the reader prunes, and a second one for strings that aren't stored; once a request.
        """
        new = [x for x in dict.fromkeys(values) if (path, x) not in self.known]
        if not new:
            return
        column = self.index.df.select(v.raw.alias("x"))
        found = {r["x"] for r in column.filter(F.col("x").isin([x for x in new if len(x.encode()) <= POSTING_BYTES])).distinct().collect()}  # at most a row for each string
        rest = {x: A.py_normalize(x) for x in new if x not in found}
        alike, many = {}, False
        if rest:
            folded = A.normalize(F.col("x"))
            rows = column.filter(folded.isin(list(set(rest.values()))) & (F.octet_length("x") <= POSTING_BYTES)).distinct().limit(VARIANTS + 1).select("x", folded.alias("f")).collect()
            for r in rows if len(rows) <= VARIANTS else ():
                alike.setdefault(r["f"], []).append(r["x"])
            many = len(rows) > VARIANTS
        for x in new:
            self.known[path, x] = [x] if x in found else None if many else sorted(alike.get(rest[x], []))

    def searchable(self, path: str) -> bool:
        return self.index.type(path) in ("text", "keyword") and self.index.posted(path) is not None

    def tokens(self, path: str) -> Column | None:
        """The terms of a text or keyword field; nulls separate the values of a text."""
        v = self.index.posted(path)
        if v is None or self.index.type(path) not in ("text", "keyword"):
            return None
        if path not in self.arrays:
            self.arrays[path] = (f"{self.prefix}t{len(self.arrays)}", v)
        return F.col(self.arrays[path][0])

    def text(self, path: str) -> Column:
        """The tokens as one string, each between spaces; where values meet stands more than that."""
        self.tokens(path)
        self.joined.setdefault(path, f"{self.prefix}j{len(self.joined)}")
        return F.col(self.joined[path])

    def tf(self, path: str, term: str | None) -> Column:
        """How often a term stands in the field, made once a row; without a term, the number of tokens."""
        return F.col(self.counts.setdefault((path, term), f"{self.prefix}c{len(self.counts)}"))

    def stat(self, key: str, value: Column) -> Column:
        if key not in self.aggregates:
            self.aggregates[key] = (f"{self.prefix}s{len(self.aggregates)}", value)
        return F.col(self.aggregates[key][0])

    def candidates(self, path: str, term: str, most: int) -> Column:
        """Map of the dictionary's terms within `most` edits of term (itself not among them) to (edits, document frequency)."""
        return F.col(self.fuzzy.setdefault((path, term, most), f"{self.prefix}f{len(self.fuzzy)}"))

    def field(self, path: str) -> Field:
        return ListField(self, path) if path in self.index.lists else Field(self, path)

    def listed(self, path: str, key: tuple, terms: Column, value: Column) -> Column:
        """A column by document: an aggregate over the rows of the field's lists; terms: which rows it is about."""
        held = self.lists.setdefault(path, {})
        held.setdefault(key, (f"{self.prefix}p{len(self.lists)}_{len(held)}", terms, value))
        return F.col(held[key][0])

    def list_stat(self, path: str, key: str, value: Column) -> Column:
        """An aggregate of the whole lists of the request's terms (key: the term), or a column of the field's statistics."""
        held = self.list_stats.setdefault(path, {})
        held.setdefault(key, (f"{self.prefix}q{list(self.list_stats).index(path)}_{len(held)}", value))
        return F.col(held[key][0])

    def near_terms(self, path: str, term: str, most: int) -> Column:
        """By document, the best score of the dictionary's terms within `most` edits of term, itself not among them."""
        return F.col(self.near.setdefault((path, term, most), f"{self.prefix}e{len(self.near)}"))

    # --- frames

    def with_lists(self, df: DataFrame) -> DataFrame:
        """df with what was registered of the lists, joined by id. Where a match needs a term, Catalyst makes the join an inner one."""
        own = f"{self.prefix}id"
        for path, held in self.lists.items():
            rows = self.index.lists[path].lists.filter(_any(terms for _, terms, _ in held.values()))
            made = rows.groupBy(F.col("_id").alias(own)).agg(*[value.alias(name) for name, _, value in held.values()])
            df = df.join(made, df["_id"] == made[own], "left").drop(own)
        for (path, term, most), name in self.near.items():
            p = self.index.lists[path]
            edits = F.levenshtein(A.latin1(F.col("term")), F.lit(A.py_latin1(term)), most)
            near = p.dictionary().withColumn("d", edits).filter((F.col("term") != term) & (F.col("d") > 0))
            some = [r["term"] for r in near.select("term").limit(VARIANTS + 1).collect()]
            rows = p.lists.filter(F.col("term").isin(some)) if len(some) <= VARIANTS else p.lists
            rows = rows.select("term", "_id", "freq", "len").join(near, "term").crossJoin(F.broadcast(p.stats))  # stats is one row
            mean = F.greatest(F.col("total") / F.greatest("n", F.lit(1)), F.lit(1.0))
            score = _idf(F.col("n"), F.col("doc_freq")) * _bm25_weight(F.col("freq"), F.col("len"), mean) * (1 - 0.25 * F.col("d"))
            made = rows.groupBy(F.col("_id").alias(own)).agg(F.max(F.when(score > 0, score)).alias(name))
            df = df.join(made, df["_id"] == made[own], "left").drop(own)
        return df

    def with_tokens(self, df: DataFrame) -> DataFrame:
        if not self.arrays:
            return df
        df = self.index.spread(df)
        made = {}
        for path, (name, v) in self.arrays.items():
            if self.index.type(path) == "keyword":
                s = v.strings() if v.many else F.array_compact(F.array(v.strings()))
                made[name] = F.transform(s, lambda x: F.when(F.octet_length(x) <= POSTING_BYTES, x))
            else:
                # a number that the optimizer can't know keeps it from copying the tokenizer into each use
                made[name] = F.coalesce(A.token_array(v.strings(), v.many), F.when(F.monotonically_increasing_id() >= 0, F.array().cast("array<string>")))
        df = df.withColumns(made)
        if self.joined:
            none = F.monotonically_increasing_id() < 0
            df = df.withColumns({j: F.when(none, "").otherwise(F.concat(F.lit(" "), F.array_join(self.arrays[p][0], " ", "\n"), F.lit(" "))) for p, j in self.joined.items()})
        if self.counts:
            once = F.monotonically_increasing_id() >= 0  # as above: not copied into each use
            made = {}
            for (path, term), name in self.counts.items():
                tok = F.col(self.arrays[path][0])
                many = self.index.posted(path).many and self.index.type(path) == "text"
                size = F.size(F.array_compact(tok) if many else tok) if term is None else F.size(tok) - F.size(F.array_remove(tok, term))
                made[name] = F.when(once, F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)))
            df = df.withColumns(made)
        return df

    def frame(self, plain: tuple[Column, ...] = ()) -> DataFrame:
        """The table with all registered columns. Statistics come from the whole table, rows from what `plain` lets through."""
        df = self.index.df
        for p in plain:
            df = df.filter(p)
        df = self.with_lists(self.with_tokens(df))
        for stats in self.statistics():
            df = df.crossJoin(F.broadcast(stats))  # one row by construction: an aggregate without groups
        return df

    def statistics(self) -> list[DataFrame]:
        out = []
        for path, held in self.list_stats.items():
            p = self.index.lists[path]
            terms = {k: x for k, x in held.items() if k not in ("n", "mean")}
            if terms:
                out.append(p.lists.filter(F.col("term").isin([k[1:] for k in terms])).agg(*[x.alias(name) for name, x in terms.values()]))
            out.append(p.stats.select(*[x.alias(name) for k, (name, x) in held.items() if k not in terms]))
        if self.aggregates:
            out.append(self.with_tokens(self.index.df).agg(*[x.alias(name) for name, x in self.aggregates.values()]))
        for path in dict.fromkeys(p for p, _, _ in self.fuzzy):
            terms = self.with_tokens(self.index.df).select(F.explode(F.array_distinct(self.arrays[path][0])).alias("term"))
            df = terms.filter("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
            made = []
            for (p, term, most), name in self.fuzzy.items():
                if p == path:
                    edits = F.levenshtein(A.latin1(F.col("term")), F.lit(A.py_latin1(term)), most)
                    hit = (F.col("term") != term) & (edits > 0)
                    entry = F.when(hit, F.struct(F.col("term"), F.struct(edits.alias("d"), F.col("n"))))
                    made.append(F.map_from_entries(F.collect_list(entry)).alias(name))
            out.append(df.agg(*made))
        return out


# --- scoring


def _bm25_weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


class Field:
    """BM25 over one text or keyword field."""

    def __init__(self, ctx: Context, path: str):
        self.ctx, self.path, self.tok = ctx, path, ctx.tokens(path)
        self.length = ctx.tf(path, None)
        self.n_docs = ctx.stat(f"n:{path}", F.count_if(self.length > 0))
        self.mean = F.greatest(ctx.stat(f"l:{path}", F.coalesce(F.sum(self.length), F.lit(0))) / F.greatest(self.n_docs, F.lit(1)), F.lit(1.0))

    def has(self, term: str) -> Column:
        return self.ctx.tf(self.path, term) > 0

    def _weight(self, tf: Column) -> Column:
        return _bm25_weight(tf, self.length, self.mean)

    def prefixed(self, start: str) -> Column:
        return self.ctx.text(self.path).contains(f" {start}")

    def like(self, pattern: str) -> Column:
        return A.latin1(self.ctx.text(self.path)).rlike("(?s)[ \n]" + A.glob_regex(pattern, "[^ \n]*", "[^ \n]") + "(?=[ \n])")

    def adjacent(self, terms: list[str], prefix: bool) -> Column:
        # each token stands between single spaces, so adjacent terms are a substring
        return self.ctx.text(self.path).contains(" " + " ".join(terms) + ("" if prefix else " "))

    def positions(self, term: str, prefix: bool) -> Column:
        hit = (lambda x: x.startswith(term)) if prefix else (lambda x: x == term)
        return F.filter(F.transform(self.tok, lambda x, i: F.when(hit(x), i).otherwise(-1)), lambda p: p >= 0)

    def bm25(self, term: str, boost: float) -> Column:
        df = self.ctx.stat(f"df:{self.path}:{term}", F.count_if(self.has(term)))
        return F.lit(float(boost)) * _idf(self.n_docs, df) * self._weight(self.ctx.tf(self.path, term))

    def fuzzy(self, term: str, most: int, boost: float) -> Clause:
        """The greatest of the exact score and the candidates' scores, these less a quarter for each edit."""
        cands = self.ctx.candidates(self.path, term, most)
        near = F.filter(F.map_entries(cands), lambda e: F.array_contains(self.tok, e["key"]))

        def one(e: Column) -> Column:
            tf = F.size(self.tok) - F.size(F.array_remove(self.tok, e["key"]))
            return F.lit(float(boost)) * _idf(self.n_docs, e["value"]["n"]) * self._weight(tf) * (1 - 0.25 * e["value"]["d"])

        best = F.array_max(F.filter(F.transform(near, one), lambda s: s > 0))
        exact = F.when(self.has(term), self.bm25(term, boost))
        score = F.greatest(best, exact)
        return Clause(score.isNotNull(), F.coalesce(score, F.lit(0.0)))


class ListField(Field):
    """BM25 over a text field's inverted index table: no text is read."""

    def __init__(self, ctx: Context, path: str):
        self.ctx, self.path = ctx, path
        self.n_docs = ctx.list_stat(path, "n", F.col("n"))
        self.mean = ctx.list_stat(path, "mean", F.greatest(F.col("total") / F.greatest("n", F.lit(1)), F.lit(1.0)))

    @property
    def length(self) -> Column:
        return self.ctx.listed(self.path, ("len",), F.lit(False), F.max("len"))

    def _of(self, term: str, what: str) -> Column:
        own = F.col("term") == term
        return self.ctx.listed(self.path, (what, term), own, F.max(F.when(own, F.col(what))))

    def has(self, term: str) -> Column:
        return self._of(term, "freq").isNotNull()

    def bm25(self, term: str, boost: float) -> Column:
        df = self.ctx.list_stat(self.path, f"={term}", F.count_if(F.col("term") == term))
        return F.lit(float(boost)) * _idf(self.n_docs, df) * self._weight(self._of(term, "freq"))

    def fuzzy(self, term: str, most: int, boost: float) -> Clause:
        score = F.greatest(F.lit(float(boost)) * self.ctx.near_terms(self.path, term, most), F.when(self.has(term), self.bm25(term, boost)))
        return Clause(score.isNotNull(), F.coalesce(score, F.lit(0.0)))

    def prefixed(self, start: str) -> Column:
        own = F.startswith(F.col("term"), F.lit(start))
        return self.ctx.listed(self.path, ("prefix", start), own, F.count_if(own)) > 0

    def like(self, pattern: str) -> Column:
        own = A.latin1(F.col("term")).rlike(_regex_any(A.glob_regex(pattern, ".*", ".")))
        return self.ctx.listed(self.path, ("like", pattern), own, F.count_if(own)) > 0

    def positions(self, term: str, prefix: bool) -> Column:
        if not prefix:
            return self._of(term, "pos")
        own = F.startswith(F.col("term"), F.lit(term))
        return self.ctx.listed(self.path, ("places", term), own, F.flatten(F.collect_list(F.when(own, F.col("pos")))))

    def adjacent(self, terms: list[str], prefix: bool) -> Column:
        """A place of the first term at which the others follow one by one; the rows of documents with all of them."""
        rest = [self.positions(t, prefix and k == len(terms) - 1) for k, t in enumerate(terms)]
        follows = F.exists(rest[0], lambda p: _all(F.array_contains(x, p + k) for k, x in enumerate(rest[1:], 1)))
        return _all(x.isNotNull() for x in rest) & F.coalesce(follows, F.lit(False))


def fuzzy_distance(fuzziness: str, term: str) -> int:
    f = fuzziness.upper()
    if f in ("AUTO", "AUTO:3,6"):
        n = len(term.encode())
        return 0 if n < 3 else 1 if n < 6 else 2
    return int(f) if f in ("1", "2") else 0


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _all(columns) -> Column:
    columns = list(columns)
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(True)


def _any(columns) -> Column:
    columns = list(columns)
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def _where(c: Clause) -> Column:
    return F.when(c.match, c.score).otherwise(0.0)


def union_sum(parts: list[Clause]) -> Clause:
    if not parts:
        return nothing()
    return parts[0] if len(parts) == 1 else Clause(_any(p.match for p in parts), _sum([_where(p) for p in parts]))


def intersect_sum(parts: list[Clause]) -> Clause:
    if not parts:
        return nothing()
    return Clause(_all(p.match for p in parts), _sum([p.score for p in parts]), tuple(x for p in parts for x in p.plain), all(p.exact for p in parts))


def union_max(parts: list[Clause]) -> Clause:
    """The best score; rows whose best isn't above 0 don't match."""
    if not parts:
        return nothing()
    best = F.greatest(*[_where(p) for p in parts]) if len(parts) > 1 else _where(parts[0])
    return Clause(best > 0, best)


# --- leaves


def match_field(ctx: Context, path: str, text: str, operator: str = "or", fuzziness: str = "", boost: float = 1.0) -> Clause:
    terms = A.py_tokens(text)
    if not terms:
        return nothing()
    if ctx.index.type(path) == "keyword":
        return keyword_equals(ctx, path, text, boost)
    if not ctx.searchable(path):
        return nothing()
    f, parts = ctx.field(path), []
    for t in terms:
        most = fuzzy_distance(fuzziness, t) if fuzziness not in ("", "0") else 0
        parts.append(f.fuzzy(t, most, boost) if most else Clause(f.has(t), f.bm25(t, boost)))
    return intersect_sum(parts) if operator == "and" else union_sum(parts)


def keyword_equals(ctx: Context, path: str, value: str, boost: float = 1.0) -> Clause:
    """The exact value; where no row of the table has it, values that are equal when folded."""
    v = ctx.index.posted(path)
    if v is None:
        return nothing()
    posted = len(value.encode()) <= POSTING_BYTES
    if v.kind == "string" and not v.many:
        ctx.stored(path, v, [value])
        if (held := ctx.known[path, value]) is not None:
            return Clause.of(v.raw == held[0] if len(held) == 1 else v.raw.isin(held) if held else F.lit(False), boost)
        return Clause.of((A.normalize(v.raw) == A.py_normalize(value)) & (F.octet_length(v.raw) <= POSTING_BYTES), boost)
    exact = v.any(lambda _, s: s == value, number=False) if posted else F.lit(False)
    fold = v.any(lambda _, s: (A.normalize(s) == A.py_normalize(value)) & (F.octet_length(s) <= POSTING_BYTES), number=False)
    found = ctx.stat(f"has:{path}:{value}", F.coalesce(F.bool_or(exact), F.lit(False)))
    no = F.lit(False)
    return Clause(F.coalesce(exact, no) | (~found & F.coalesce(fold, no)), F.lit(float(boost)))


def term_filter(ctx: Context, path: str, value, boost: float = 1.0) -> Clause:
    kind, text = ctx.index.type(path), py_string(value)
    if kind == "keyword":
        return keyword_equals(ctx, path, text, boost)
    if kind == "text":
        if not ctx.searchable(path):
            return nothing()
        return Clause.of(ctx.field(path).has(A.py_normalize(text)), boost, plain=False)
    v = ctx.index.values(path)
    if v is None:
        return nothing()
    want = py_number(value)
    if want is not None and not v.many:  # a comparison that the reader understands
        if v.kind in ("long", "double"):
            return Clause.of(v.raw == (F.lit(int(want)) if want.is_integer() and abs(want) < 2**53 else F.lit(want)), boost)
        if v.kind == "time" and isinstance(value, str) and math.isfinite(want):
            at, end = v.moment(int(want) * 1000), v.moment((int(want) + 1) * 1000)
            if at is not None and end is not None:
                return Clause.of((v.raw >= at) & (v.raw < end), boost)
    return Clause.of(v.any(lambda n, s: ((n == want) | (s == text)) if want is not None else s == text, number=want is not None), boost)


def in_range(v: Values, bounds: dict[str, object]) -> Column:
    """Whether a value meets all bounds: as numbers where both sides have one, else as strings."""
    compare = {"gte": lambda a, b: a >= b, "gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "lt": lambda a, b: a < b}
    numbers = [py_number(b) for b in bounds.values()]
    if not v.many and v.kind in ("long", "double") and None not in numbers:
        return _all([compare[k](v.raw, F.lit(int(n)) if n.is_integer() and abs(n) < 2**53 else F.lit(n)) for k, n in zip(bounds, numbers)])
    if not v.many and v.kind == "time" and None not in numbers and all(map(math.isfinite, numbers)):
        # stored times are finer than a millisecond; they compare by their milliseconds
        at = [v.moment(round(n * 1000) + (1000 if k in ("gt", "lte") else 0)) for k, n in zip(bounds, numbers)]
        if None not in [x if x is None else 0 for x in at]:
            return _all([v.raw >= x if k in ("gte", "gt") else v.raw < x for k, x in zip(bounds, at)])
    if not v.many and v.kind == "string" and not any(py_number(b) is not None for b in bounds.values()):
        return _all([compare[k](v.raw, F.lit(py_string(b))) for k, b in bounds.items()])

    def test(n: Column, s: Column) -> Column:
        out = []
        for k, b in bounds.items():
            number, text = py_number(b), compare[k](s, F.lit(py_string(b)))
            out.append(text if number is None else F.when(n.isNotNull(), compare[k](n, F.lit(number))).otherwise(text))
        return _all(out)

    return v.any(test)


def _regex_any(pattern: str) -> str:
    return f"(?s)^{pattern}$"


def pattern_clause(ctx: Context, path: str, value, boost: float, wildcard: bool) -> Clause:
    pattern = py_string(value)
    folded, kind = A.py_normalize(pattern), ctx.index.type(path)
    if kind == "text":
        if not ctx.searchable(path):
            return nothing()
        f = ctx.field(path)
        if wildcard:
            tests = [f.like(p) for p in dict.fromkeys((pattern, folded))]
        elif pattern:
            tests = [f.prefixed(p) for p in dict.fromkeys((pattern, folded)) if " " not in p and "\n" not in p]
        else:
            tests = [F.size(ctx.tokens(path)) > 0]
        return Clause.of(_any(tests), boost, plain=False)

    def test(s: Column) -> Column:
        if wildcard:
            return A.latin1(s).rlike(_regex_any(A.glob_regex(pattern, ".*", "."))) | A.latin1(A.normalize(s)).rlike(_regex_any(A.glob_regex(folded, ".*", ".")))
        return F.startswith(s, F.lit(pattern)) | F.startswith(A.normalize(s), F.lit(folded))

    if kind == "keyword":
        v = ctx.index.posted(path)
        return Clause.of(v.any(lambda _, s: test(s) & (F.octet_length(s) <= POSTING_BYTES), number=False), boost) if v else nothing()
    v = ctx.index.values(path)
    return Clause.of(v.any(lambda _, s: test(s), number=False), boost) if v else nothing()


def phrase_clause(ctx: Context, path: str, text: str, slop: int, boost: float, prefix: bool) -> Clause:
    terms = A.py_tokens(text)
    if not terms or not ctx.searchable(path):
        return nothing()
    f = ctx.field(path)
    if len(terms) == 1 and not prefix:
        return Clause(f.has(terms[0]), f.bm25(terms[0], boost))
    keyword = ctx.index.type(path) == "keyword"
    if keyword and len(terms) > 1:
        return nothing()
    base = f.bm25(terms[0], boost)
    score = F.when(f.has(terms[0]) & (base != 0), base).otherwise(float(boost)) * len(terms)
    if len(terms) == 1:
        m = F.exists(f.tok, lambda t: F.coalesce(t.startswith(terms[0]), F.lit(False))) if keyword else f.prefixed(terms[0])
        return Clause(m, score)
    if slop <= 0:
        return Clause(f.adjacent(terms, prefix), score)

    def positions(k: int) -> Column:
        return f.positions(terms[k], prefix and k == len(terms) - 1)

    rest = [positions(k) for k in range(1, len(terms))]

    def reaches(p: Column) -> Column:
        """The first position of each next term within the slop, in turn; null where there is none."""
        return F.aggregate(F.array(*rest), p, lambda acc, ps: F.array_min(F.filter(ps, lambda q: (q > acc) & (q <= acc + 1 + slop)))).isNotNull()

    return Clause(_all(f.has(t) for t in terms[: -1 if prefix else None]) & F.coalesce(F.exists(positions(0), reaches), F.lit(False)), score)


def field_boost(spec: str) -> tuple[str, float]:
    head, sep, tail = spec.rpartition("^")
    if sep and head:
        try:
            if float(tail) > 0:
                return head, float(tail)
        except ValueError:
            pass
    return spec, 1.0


def multi_match(ctx: Context, body: dict) -> Clause:
    text, boost = py_text(body.get("query")), option(body, "boost", 1)
    kind = body["type"] if isinstance(body.get("type"), str) else "best_fields"
    fields = [py_text(f) for f in body["fields"]] if isinstance(body.get("fields"), list) else []
    parts = []
    for spec in fields or ctx.index.texts():
        path, own = field_boost(spec)
        if kind == "phrase":
            parts.append(phrase_clause(ctx, path, text, 0, own * boost, False))
        else:
            parts.append(match_field(ctx, path, text, _operator(body, "operator"), py_text(body.get("fuzziness")), own * boost))
    return union_sum(parts) if kind == "most_fields" else union_max(parts)


def _operator(body: dict, key: str) -> str:
    return body[key].lower() if isinstance(body.get(key), str) else "or"


def strip_operators(text: str) -> str:
    """AND, OR, NOT and the signs become a space wherever they stand; the scan goes on behind each."""
    out, i = [], 0
    while i < len(text):
        hit = next((w for w in ("AND", "OR", "NOT", '"', "+", "-") if text.startswith(w, i)), None)
        out.append(" " if hit else text[i])
        i += len(hit) if hit else 1
    return "".join(out)


def query_string(ctx: Context, body: dict) -> Clause:
    sub = {"query": strip_operators(py_text(body.get("query"))), "operator": _operator(body, "default_operator")}
    if "fields" in body:
        sub["fields"] = body["fields"]
    if isinstance(body.get("default_field"), str) and body["default_field"] not in ("", "*"):
        sub["fields"] = [body["default_field"]]
    return multi_match(ctx, sub)


# --- compounds


def bool_query(ctx: Context, body: dict) -> Clause:
    def clauses(key: str) -> list[Clause]:
        if key not in body:
            return []
        v = body[key]
        if not isinstance(v, (list, dict)):
            raise QueryError(f"bool.{key}: a clause or a list of clauses is wanted")
        return [compile_query(ctx, c) for c in (v if isinstance(v, list) else [v]) if isinstance(c, dict)]

    must, filters, should, must_not = (clauses(k) for k in ("must", "filter", "should", "must_not"))
    restricted = bool(must or filters)
    least = 1 if should and not restricted else 0
    if "minimum_should_match" in body and (n := py_number(body["minimum_should_match"])) is not None:
        least = int(n)
    match = [c.match for c in must + filters]
    plain = [p for c in must + filters for p in c.plain]
    exact = all(c.exact for c in must + filters + must_not)
    scores = [c.score for c in must]
    if should:
        if not restricted:
            least = max(least, 1)
        if least == 1:
            match.append(_any(c.match for c in should))
            if all(c.exact for c in should):
                plain.append(_any(c.bare() for c in should))
            else:
                exact = False
        elif least > 1:
            match.append(_sum([c.match.cast("int") for c in should]) >= least)
            exact = False
        scores += [_where(c) for c in should]
    for c in must_not:
        match.append(~c.match)
        if c.exact:
            plain.append(~c.match)
    score, boost = _sum(scores) if scores else F.lit(0.0), option(body, "boost", 1)
    return Clause(_all(match), score * boost if boost != 1 else score, tuple(plain), exact)


def dis_max(ctx: Context, body: dict) -> Clause:
    parts = [compile_query(ctx, q) for q in body.get("queries") or [] if isinstance(q, dict)]
    out, tie = union_max(parts), option(body, "tie_breaker", 0)
    if tie > 0 and len(parts) > 1:
        out = Clause(out.match, out.score + tie * (_sum([_where(p) for p in parts]) - out.score))
    return out


def field_factor(ctx: Context, spec: dict) -> Column:
    v = ctx.index.values(py_text(spec.get("field")))
    x = F.lit(option(spec, "missing", 1))
    if v is not None:
        x = F.coalesce(v.first(), x)
    x = x * option(spec, "factor", 1)
    nan = F.lit(float("nan"))

    def log(f: Callable[[Column], Column], y: Column) -> Column:
        return F.when(y > 0, f(y)).when(y == 0, F.lit(float("-inf"))).otherwise(nan)

    return {
        "log": lambda: F.log10(F.greatest(x, F.lit(1e-9))),
        "log1p": lambda: log(F.log10, x + 1),
        "log2p": lambda: log(F.log10, x + 2),
        "ln": lambda: F.log(F.greatest(x, F.lit(1e-9))),
        "ln1p": lambda: F.when(x > -1, F.log1p(x)).when(x == -1, F.lit(float("-inf"))).otherwise(nan),
        "ln2p": lambda: log(F.log, x + 2),
        "square": lambda: x * x,
        "sqrt": lambda: F.sqrt(F.greatest(x, F.lit(0.0))),
        "reciprocal": lambda: F.when(x != 0, F.try_divide(F.lit(1.0), x)).otherwise(x),
    }.get(spec.get("modifier"), lambda: x)()


def function_score(ctx: Context, body: dict) -> Clause:
    inner = compile_query(ctx, body.get("query") if isinstance(body.get("query"), dict) else {})
    factors = []
    for f in body.get("functions") if isinstance(body.get("functions"), list) else []:
        if isinstance(f, dict):
            w = F.lit(option(f, "weight", 1))
            if isinstance(f.get("field_value_factor"), dict):
                w = w * field_factor(ctx, f["field_value_factor"])
            if isinstance(f.get("filter"), dict):
                w = F.when(compile_query(ctx, f["filter"]).match, w).otherwise(1.0)
            factors.append(w)
    if "weight" in body and py_number(body["weight"]) is not None:
        factors.append(F.lit(py_number(body["weight"])))
    if isinstance(body.get("field_value_factor"), dict):
        factors.append(field_factor(ctx, body["field_value_factor"]))
    if not factors:
        return inner
    factor, base = reduce(lambda a, b: a * b, factors), inner.score
    score = {"sum": base + factor, "replace": factor, "max": F.greatest(base, factor), "min": F.least(base, factor), "avg": (base + factor) / 2}.get(body.get("boost_mode"), base * factor)
    return Clause(inner.match, score, inner.plain, inner.exact)


def field_and_options(kind: str, body) -> tuple[str, object, dict]:
    """{field: value} or {field: {options}}; `boost` and `_name` beside it don't count."""
    named = {k: v for k, v in body.items() if k not in ("boost", "_name")} if isinstance(body, dict) else {}
    if len(named) != 1:
        raise QueryError(f"{kind}: one field is wanted")
    ((path, v),) = named.items()
    return (path, None, v) if isinstance(v, dict) else (path, v, {})


def _match(ctx, body):
    path, v, o = field_and_options("match", body)
    text = py_text(o.get("query")) if o else py_text(v)
    return match_field(ctx, path, text, _operator(o, "operator"), py_text(o.get("fuzziness")), option(o, "boost", 1))


def _phrase(prefix):
    def run(ctx, body):
        path, v, o = field_and_options("match_phrase", body)
        return phrase_clause(ctx, path, py_text(o.get("query")) if o else py_text(v), int(option(o, "slop", 0)), option(o, "boost", 1), prefix)

    return run


def _term(ctx, body):
    path, v, o = field_and_options("term", body)
    if o:
        v = o["value"] if o.get("value") is not None else o.get("term")
    return term_filter(ctx, path, v, option(o, "boost", 1))


def _terms(ctx, body):
    for path, values in body.items():
        if path != "boost" and isinstance(values, list):
            own = ctx.index.posted(path) if ctx.index.type(path) == "keyword" else None
            if own is not None and own.kind == "string" and not own.many:
                ctx.stored(path, own, [py_string(v) for v in values])
            parts = [term_filter(ctx, path, v) for v in values]
            exact = all(p.exact for p in parts)
            return Clause.of(_any(p.bare() if exact else p.match for p in parts), 1, plain=exact)
    return nothing()


def _range(ctx, body):
    path, _, o = field_and_options("range", body)
    if not o:
        raise QueryError("range: bounds are wanted")
    v, bounds = ctx.index.values(path), {k: o[k] for k in ("gte", "gt", "lte", "lt") if o.get(k) is not None}
    if v is None:
        return nothing()
    return Clause.of(in_range(v, bounds) if bounds else v.count() > 0, option(o, "boost", 1))


def _exists(ctx, body):
    path = py_text(body.get("field"))
    if not path:
        raise QueryError("exists: a field is wanted")
    if ctx.index.json:
        below = F.exists(F.map_keys("_values"), lambda k: (k == path) | k.startswith(f"{path}."))
        return Clause.of(below)
    return Clause.of(_any((v.count() > 0) if v.many else v.raw.isNotNull() for v in ctx.index.under(path)))


def _pattern(wildcard):
    def run(ctx, body):
        path, v, o = field_and_options("prefix/wildcard", body)
        if o:
            v = next((o[k] for k in ("value", "wildcard", "prefix") if o.get(k) is not None), None)
        return pattern_clause(ctx, path, v, option(o, "boost", 1), wildcard)

    return run


def _fuzzy(ctx, body):
    path, v, o = field_and_options("fuzzy", body)
    if o:
        v = o.get("value")
    return match_field(ctx, path, py_string(v), "or", py_text(o.get("fuzziness")) or "AUTO", option(o, "boost", 1))


def _ids(ctx, body):
    values = body.get("values")
    return Clause.of(ctx.index.has_id(values)) if isinstance(values, list) and values else nothing()


def _constant(ctx, body):
    inner = body.get("filter") if isinstance(body.get("filter"), dict) else body.get("query") if isinstance(body.get("query"), dict) else {}
    c = compile_query(ctx, inner)
    return Clause(c.match, F.lit(option(body, "boost", 1)), c.plain, c.exact)


KINDS: dict[str, Callable[[Context, dict], Clause]] = {
    "match_all": lambda ctx, b: every(option(b, "boost", 1)),
    "match_none": lambda ctx, b: nothing(),
    "match": _match,
    "match_phrase": _phrase(False),
    "match_phrase_prefix": _phrase(True),
    "multi_match": multi_match,
    "query_string": query_string,
    "simple_query_string": query_string,
    "term": _term,
    "terms": _terms,
    "range": _range,
    "exists": _exists,
    "prefix": _pattern(False),
    "wildcard": _pattern(True),
    "fuzzy": _fuzzy,
    "ids": _ids,
    "bool": bool_query,
    "constant_score": _constant,
    "dis_max": dis_max,
    "function_score": function_score,
    "nested": lambda ctx, b: compile_query(ctx, b.get("query")),
}


def compile_query(ctx: Context, node: dict | None) -> Clause:
    """A query as a clause; no query matches every row."""
    if not node:
        return every()
    if not isinstance(node, dict) or len(node) != 1:
        raise QueryError("a query is an object with one key")
    ((kind, body),) = node.items()
    if kind not in KINDS:
        raise QueryError(f"unknown query [{kind}]")
    return KINDS[kind](ctx, body if isinstance(body, dict) else {})
