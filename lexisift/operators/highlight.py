"""Highlighting: which terms a query names, and their marks in the stored text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions.values import py_text
from ..plans.compiler import fuzzy_distance

_WORD = r"[A-Za-z0-9\x{80}-\x{10FFFF}]"
SEGMENT = rf"{_WORD}+|[^A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+"
_FIELDS = {"match", "match_phrase", "match_phrase_prefix", "term", "fuzzy", "prefix", "wildcard"}
_ANY = {"multi_match", "query_string", "simple_query_string"}


def query_terms(query) -> tuple[dict[str, list[str]], bool]:
    """Terms by field ('*': any field) of all clauses, excluding ones included, and whether a clause is fuzzy."""
    out: dict[str, list[str]] = {}
    fuzzy = False

    def add(path: str, text: str) -> None:
        out.setdefault(path, []).extend(A.py_tokens(text))

    def walk(node) -> None:
        nonlocal fuzzy
        if isinstance(node, list):
            for x in node:
                walk(x)
        elif isinstance(node, dict):
            for kind, body in node.items():
                if kind in _FIELDS and isinstance(body, dict):
                    fuzzy |= kind == "fuzzy"
                    for path, v in body.items():
                        if isinstance(v, dict):
                            text = py_text(v.get("query")) or py_text(v.get("value"))
                            fuzzy |= py_text(v.get("fuzziness")) not in ("", "0")
                        else:
                            text = py_text(v)
                        add(path.removesuffix(".keyword"), text)
                elif kind in _ANY and isinstance(body, dict):
                    add("*", py_text(body.get("query")))
                    fuzzy |= py_text(body.get("fuzziness")) not in ("", "0")
                elif kind not in _FIELDS | _ANY:
                    walk(body)

    walk(query)
    return out, fuzzy


def mark(text: Column, terms: list[str], pre: str, post: str, fuzzy: bool) -> Column:
    """The text with its matching words marked; null if none matches.

    A word here is a run of ASCII letters, digits and any other characters beyond ASCII.
    """
    parts = F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(0))

    def hit(seg: Column) -> Column:
        folded = A.normalize(seg)
        out = folded.isin(terms)
        if fuzzy:
            for t in terms:
                if most := fuzzy_distance("AUTO", t):
                    out = out | (F.levenshtein(A.latin1(folded), F.lit(A.py_latin1(t)), most) >= 0)
        return out & seg.rlike(_WORD)

    marked = F.transform(parts, lambda s: F.when(hit(s), F.concat(F.lit(pre), s, F.lit(post))).otherwise(s))
    # a marked text is longer; a text of which nothing is marked is as long as before
    joined = F.array_join(marked, "")
    has_token = F.size(A.tokens(text)) > 0
    return F.when(has_token & (F.length(joined) > F.length(text) if pre + post else F.exists(parts, hit)), joined)


def highlight(index, spec: dict, query) -> Column | None:
    """Map of path to its marked values, of those paths that have any."""
    terms, fuzzy = query_terms(query)
    pre = (spec.get("pre_tags") or ["<em>"])[0]
    post = (spec.get("post_tags") or ["</em>"])[0]
    fields = spec.get("fields") or {}
    known = list(index.stored) if not index.json else [p for p, t in index.types.items() if not (p.endswith(".keyword") and index.type(p[: -len(".keyword")]) == "text")]
    pairs = []
    for want in fields:
        for path in [p for p in known if _glob(want, p)] if set(want) & {"*", "?"} else [want]:
            own = list(dict.fromkeys(terms.get(path.removesuffix(".keyword"), []) + terms.get("*", [])))
            v = index.values(path)
            if not own or v is None:
                continue
            texts = v.strings() if v.many else F.array_compact(F.array(v.strings()))
            pairs.append(F.struct(F.lit(path), _marked(texts, own, pre, post, fuzzy)))
    if not pairs:
        return None
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: F.size(e["col2"]) > 0))


def _marked(texts: Column, terms: list[str], pre: str, post: str, fuzzy: bool) -> Column:
    return F.filter(F.transform(texts, lambda x: mark(x, terms, pre, post, fuzzy)), lambda x: x.isNotNull())


def _glob(pattern: str, text: str) -> bool:
    return re.fullmatch("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern), text, re.S) is not None
