"""Scores against a small model in plain Python, on random corpora with repeated, empty and null texts."""

import math
import random

import pytest

from lexisift.engine import Engine
from lexisift.functions.analysis import py_tokens

WORDS = ["alfa", "beta", "gamma", "delta", "epsilon", "caffè", "ab"]


def corpus(seed):
    rng = random.Random(seed)
    out = [(i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))) for i in range(40)]
    return [*out, (40, ""), (41, None), (42, out[0][1]), (43, "alfa " * 300), (44, "?!")]


class Model:
    def __init__(self, docs):
        self.toks = {str(i): py_tokens(t or "") for i, t in docs}
        self.n = sum(bool(t) for t in self.toks.values())
        self.mean = max(1.0, sum(map(len, self.toks.values())) / max(self.n, 1))

    def term(self, term, boost=1.0):
        have = {i: t.count(term) for i, t in self.toks.items() if term in t}
        idf = math.log(1 + (self.n - len(have) + 0.5) / (len(have) + 0.5))
        return {i: boost * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(self.toks[i]) / self.mean)) for i, tf in have.items()}

    def match(self, text, every=False, boost=1.0):
        parts = [self.term(t, boost) for t in py_tokens(text)]
        keys = set.intersection(*map(set, parts)) if every else set().union(*parts)
        return {i: sum(p.get(i, 0) for p in parts) for i in keys}

    def phrase(self, text, slop):
        terms, out = py_tokens(text), {}
        for i, toks in self.toks.items():
            for start in [p for p, t in enumerate(toks) if t == terms[0]]:
                prev = start
                for t in terms[1:]:
                    prev = next((q for q, x in enumerate(toks) if x == t and prev < q <= prev + 1 + slop), None)
                    if prev is None:
                        break
                if prev is not None:
                    out[i] = self.term(terms[0])[i] * len(terms)
                    break
        return out


@pytest.fixture(scope="module", params=[3, 11])
def both(request, spark):
    docs = corpus(request.param)
    e = Engine(spark)
    e.register("c", spark.createDataFrame(docs, "id long, text string"), "id")
    return e, Model(docs)


def close(e, query, want):
    got = {r["_id"]: r["_score"] for r in e.search("c", {"query": query, "size": -1, "_source": False}).hits.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_match(both):
    e, m = both
    close(e, {"match": {"text": "alfa beta alfa"}}, m.match("alfa beta alfa"))
    close(e, {"match": {"text": {"query": "CAFFE gamma", "operator": "AND", "boost": 2}}}, m.match("caffè gamma", True, 2))


@pytest.mark.parametrize(("text", "slop"), [("alfa beta", 0), ("alfa gamma beta", 2), ("delta delta", 1), ("beta alfa ab", 3)])
def test_phrase(both, text, slop):
    e, m = both
    close(e, {"match_phrase": {"text": {"query": text, "slop": slop}}}, m.phrase(text, slop))


def test_bool(both):
    e, m = both
    a, b, c = m.match("alfa"), m.match("beta gamma"), m.match("delta")
    want = {i: (a[i] + b.get(i, 0)) * 3 for i in a if i not in c}
    close(e, {"bool": {"must": [{"match": {"text": "alfa"}}], "should": [{"match": {"text": "beta gamma"}}], "must_not": [{"match": {"text": "delta"}}], "boost": 3}}, want)


def test_fuzzy(both):
    e, m = both
    near = {"delta": 1}
    want = {i: s * (1 - 0.25 * near["delta"]) for i, s in m.term("delta").items()}
    close(e, {"fuzzy": {"text": {"value": "delt", "fuzziness": "1"}}}, want)


def test_dis_max(both):
    e, m = both
    a, b = m.match("alfa"), m.match("beta")
    want = {i: max(a.get(i, 0), b.get(i, 0)) + 0.5 * min(a.get(i, 0), b.get(i, 0)) for i in a.keys() | b.keys()}
    close(e, {"dis_max": {"queries": [{"match": {"text": "alfa"}}, {"match": {"text": "beta"}}], "tie_breaker": 0.5}}, want)


def test_postings_score_like_the_compiled_query(both, spark, tmp_path):
    from lexisift.sources.postings import Postings, build

    e, m = both
    build(e.indices["c"], "text", f"file://{tmp_path}/p")
    p = Postings(spark, f"file://{tmp_path}/p")
    for text, operator in (("alfa beta alfa", "or"), ("CAFFÈ gamma", "and"), ("zzz", "or"), ("?", "or")):
        got = {r["_id"]: r["score"] for r in p.match(text, operator).collect()}
        want = m.match(text, operator == "and") if py_tokens(text) else {}
        assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)
    assert p.doc_freq("alfa").first()[0] == len(m.term("alfa"))
    plan = p.match("alfa")._jdf.queryExecution().toString()
    assert "In(term" in plan or "EqualTo(term,alfa)" in plan
