import random
import re

import numpy as np
import pytest

from lexisift.llm import jaccard_join as J

from .brute import shingles

WHITE = re.compile(r"[ \t\n\r\f\v]+")


def near_docs(seed, families, copies, words=60):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    out, i = [], 0
    for _ in range(families):
        base = rng.choices(vocabulary, k=rng.randint(5, words))
        for _ in range(rng.randint(1, copies)):
            own = [w if rng.random() > rng.choice([0, 0.02, 0.1]) else rng.choice(vocabulary) for w in base]
            out.append((i * 7 % 10007, " ".join(own)))
            i += 1
    return out


def brute_links(docs, threshold=0.6):
    """{(id, words): (class_id, n_copies, n_links)} from [(id, text)]: every pair of texts, exactly."""
    texts = {}
    for i, t in docs:
        if i is not None:
            texts.setdefault(" ".join(WHITE.split((t or "").lower())).strip(), set()).add(i)
    sets = {w: shingles(w) for w in texts if w}
    near = {w: {v for v in sets if v != w and len(sets[w] & sets[v]) >= threshold * len(sets[w] | sets[v]) - 1e-9} for w in sets}
    out = {}
    for w, ids in texts.items():
        if not w:
            out |= {(i, w): (i, 0, 0) for i in ids}
            continue
        seen, todo = {w}, [w]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out |= {(i, w): (min(min(texts[v]) for v in seen), len(ids) - 1, len(near[w])) for i in ids}
    return out


def rows(df):
    return sorted((r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in df.collect())


def wanted(docs):
    return sorted((i, *v) for (i, _), v in brute_links(docs).items())


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_recall_and_exactness(spark, seed):
    docs = near_docs(seed, 60, 8)
    want, got = wanted(docs), rows(J.links(frame(spark, docs)))
    assert [r[::2] for r in got] == [r[::2] for r in want] or sum(a == b for a, b in zip(got, want)) >= 0.95 * len(want)
    assert all(g[3] <= w[3] and g[2] == w[2] for g, w in zip(got, want))
    total = sum(w[3] for w in want)
    assert sum(g[3] for g in got) >= 0.95 * total > 50


def test_no_link_is_lost_where_texts_are_alike(spark):
    """Near copies of 0.75 at least: classes and links are those of all pairs."""
    rng = random.Random(8)
    docs = []
    for f in range(30):
        base = [f"f{f}w{i}" for i in range(120)]
        for c in range(rng.randint(1, 9)):
            docs.append((len(docs), " ".join([*base[: 120 - rng.randint(0, 6)], *[f"own{c}"] * (c % 3)])))
    assert rows(J.links(frame(spark, docs))) == wanted(docs)


@pytest.mark.parametrize(("members", "most"), [(7, 1 << 20), (2048, 900), (7, 900), (5, 1)])
def test_large_groups_are_cut_into_blocks(spark, monkeypatch, members, most):
    monkeypatch.setattr(J, "MEMBERS", members)
    monkeypatch.setattr(J, "GRAMS", most)
    base = [f"v{i}" for i in range(300)]
    docs = [(i, " ".join([*base, f"own{i}"])) for i in range(60)]
    assert rows(J.links(frame(spark, docs))) == [(i, 0, 0, 59) for i in range(60)]
    assert [r["doc_id"] for r in J.keep_one(frame(spark, docs)).collect()] == [0]


def test_a_third_of_all_rows_in_one_group(spark):
    """Half copies of one text, half texts that differ in a word; a text of 2 MB among them."""
    base = " ".join(f"v{i}" for i in range(80))
    docs = [(i, base if i % 2 else f"{base} own{i}") for i in range(1, 2001)] + [(i, " ".join(f"d{i}w{j}" for j in range(12))) for i in range(3000, 7000)]
    docs += [(9000 + i, " ".join(f"long{j}" for j in range(250_000 + i))) for i in range(2)]
    got = {r["doc_id"]: r for r in J.links(frame(spark, docs).repartition(8)).collect()}
    assert len(got) == len(docs)
    assert all((got[i]["class_id"], got[i]["n_copies"], got[i]["n_links"]) == (1, 999 if i % 2 else 0, 1000) for i in range(1, 2001))
    assert all((got[i]["class_id"], got[i]["n_copies"], got[i]["n_links"]) == (i, 0, 0) for i in range(3000, 7000))
    assert got[9001]["class_id"] == 9000 and got[9000]["n_links"] == 1


def test_parts():
    live, n = np.array([True, False, True, True, True]), np.array([5, 100, 5, 5, 5])
    assert J.parts(live, n, 5, 10).tolist() == [0, 0, 0, 1, 1] and J.parts(live, n, 5, 1000).tolist() == [0] * 5
    assert J.parts(live, n, 3, 1000).tolist() == [0, 0, 0, 1, 1] and J.parts(live, n, 3, 1).tolist() == [0, 1, 1, 2, 3]


def test_keep_one_leaves_one_of_each_group(spark):
    docs = near_docs(5, 40, 10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r["doc_id"] for r in J.keep_one(df).collect()}
    assert kept == {r["class_id"] for r in J.links(df).collect()}


def test_pruning_bounds():
    need = J.least_matches(0.6, 0.002)
    assert need == sorted(need) and len(need) == J.HASHES // J.STEP
    rng = np.random.default_rng(3)
    for s, floor in ((0.6, 0.97), (0.75, 0.999)):
        pairs = np.arange(4000)
        sig = np.zeros((8000, J.HASHES), dtype=np.uint16)
        sig[4000:] = rng.random((4000, J.HASHES)) > s
        assert len(J.prune(sig, pairs, pairs + 4000, need)) >= floor * 4000
    sig[4000:] = rng.random((4000, J.HASHES)) > 0.3
    assert len(J.prune(sig, pairs, pairs + 4000, need)) < 0.01 * 4000


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r["k"]: r["root"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_edges(spark, edge, edge_rows, empty):
    got = rows(J.links(edge))
    assert got == wanted([(i, t) for i, t, *_ in edge_rows])
    by = {r[0]: r[1:] for r in got}
    assert by[2] == (1, 1, by[1][2]) and by[8] == (7, 1, 0) and by[3] == (3, 0, 0) and by[4] == (4, 0, 0) and by[5] == (5, 0, 0)
    kept = J.keep_one(edge)
    assert set(kept.columns) == set(edge.columns)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    # repeated rows of the one that stays stay; rows without an id or a word stay
    drop = {2, 8} | ({9} if by[9][0] == 1 else set())
    assert [i for none, i in ids if not none] == sorted(i for i, *_ in edge_rows if i is not None and i not in drop) and ids[-1] == (True, 0)
    assert J.links(empty).count() == 0 and J.keep_one(empty).count() == 0
    two = [(1, "a b c d e f"), (1, "x y z"), (1, "x y  Z"), (2, "a b c d e f"), (3, "x y z")]
    assert rows(J.links(frame(spark, two))) == wanted(two) == [(1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0)]


def test_keep_one_drops_only_the_text_that_is_a_duplicate(spark):
    a, b, c = "a b c d e f", "x y z u v w", "own words of the third text"
    rows = [(1, a), (5, a), (5, a), (5, b), (7, b), (9, a), (9, c), (9, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"], str(r["text"])) for r in J.keep_one(df).collect())
    assert kept == sorted([(1, a), (5, b), (9, c), (9, ""), (9, "None")])
    near = [(1, " ".join(f"v{i}" for i in range(200))), (2, " ".join(f"v{i}" for i in range(199)) + " last"), (2, c), (3, c)]
    assert {tuple(r) for r in J.keep_one(spark.createDataFrame(near, "doc_id long, text string")).collect()} == {near[0], near[2]}
