import random

import pytest
from pyspark.sql import functions as F

from lexisift.llm import line_dedup

from .brute import line_dedup as brute


def run(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df, **kw).collect()}


def random_docs(seed, n=70, lines=14):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(12)]
    runs = [[rng.choice(pool) for _ in range(rng.randint(3, 30))] for _ in range(4)]
    out = []
    for i in rng.sample(range(1000), n):
        body = []
        for _ in range(rng.randint(1, lines)):
            body += rng.choice(runs) if rng.random() < 0.3 else [rng.choice([rng.choice(pool), f"own {i} {rng.random()}", "", "  "])]
        out.append((i, "\n".join(body)))
    return out


@pytest.mark.parametrize(("seed", "words"), [(1, 8), (2, 1), (3, 30)])
def test_against_brute_force(spark, seed, words):
    docs = random_docs(seed)
    want = {i: t for i, t in brute(docs, words).items() if t is not None}
    assert run(spark, docs, min_words=words) == want


def test_long_repeats_and_periods(spark):
    docs = [(1, "\n".join(["same line over and over again and again"] * 300)), (2, "\n".join(f"x{i % 3} some words here" for i in range(200))), (3, "\n".join(f"x{i % 3} some words here" for i in range(150)) + "\nend")]
    want = {i: t for i, t in brute(docs).items() if t is not None}
    assert run(spark, docs) == want and want[1].count("\n") == 0


def test_planted_passage(spark):
    passage = "\n".join(" ".join(f"p{k}w{j}" for j in range(12)) for k in range(6))
    docs = [(i, f"intro of document {i} alone\n{passage}\noutro of document {i} alone") for i in range(40)]
    got = run(spark, docs)
    assert passage in got[0] and all(got[i] == f"intro of document {i} alone\noutro of document {i} alone" for i in range(1, 40))


def test_edges(spark, edge, plain_edge, empty):
    got = line_dedup.dedup_lines(edge).collect()
    assert set(line_dedup.dedup_lines(edge).columns) == set(edge.columns)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by[1]) == 2 and by[1][0]["text"] == by[1][1]["text"]  # repeated rows aren't each other's copies
    assert 2 not in by and 8 not in by or by.get(8)[0]["text"] == "one"  # all of 2 is a copy; 8 is too short to go
    assert by[3][0]["text"] is None and by[4][0]["text"] == "" and by[None][0]["text"].endswith("again")
    assert 9 not in by and len(by[6][0]["text"]) > 200_000 and by[1][0]["runs"] == "extra runs"
    assert line_dedup.dedup_lines(empty).count() == 0
    plain = line_dedup.dedup_lines(plain_edge, count="n_deleted")
    assert plain.columns[-1] == "n_deleted" and plain.agg(F.sum("n_deleted")).first()[0] == 0


def test_previous_lengths():
    text = "abababcab"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0] + [next((k for k in range(len(text)) if text[a : a + k + 1] != text[b : b + k + 1] or max(a, b) + k >= len(text)), 0) for a, b in zip(order, order[1:])]
    got = dict(zip(order, line_dedup.previous_lengths(order, lcp)))
    for i in range(len(text)):
        want = max((k for j in range(i) for k in range(len(text) - i + 1) if text[j : j + k] == text[i : i + k] and len(text[i : i + k]) == k), default=0)
        assert got[i] == want


def test_a_line_in_half_of_all_rows(spark):
    """A line, and a passage of three, in 50 % of 40,000 documents: no task is much larger than the others."""
    passage = "\n".join(f"licensed to anyone under the terms of part {k} of this text" for k in range(3))
    hot = "all rights in this text are reserved to those who wrote it"
    docs = [(i, f"own line of {i} with words of its own {i}\n{hot if i % 4 == 1 else passage}" if i % 2 else f"only own words here {i} {i} {i} a b c d") for i in range(40_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: t if i % 2 == 0 or i in (1, 3) else t.split("\n")[0] for i, t in docs}
