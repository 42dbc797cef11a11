import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexisift.llm import packing

from .brute import best_fit_bins


def lengths(seed, n, capacity):
    rng = random.Random(seed)
    return Counter(min(capacity, max(1, int(rng.lognormvariate(3.2, 1.0)))) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize(("n", "capacity"), [(5, 10), (300, 64), (3000, 200)])
def test_plan_places_every_piece_once(seed, n, capacity):
    counts = lengths(seed, n, capacity)
    plan = packing.solve(dict(counts), capacity)
    used = Counter()
    for parts, m in plan:
        assert sum(parts) <= capacity and m > 0
        for x in parts:
            used[x] += m
    assert used == counts
    assert sum(m for _, m in plan) <= max(best_fit_bins(list(counts.elements()), capacity) * 1.02, best_fit_bins(list(counts.elements()), capacity) + 1)


def test_exact_complements_come_first():
    plan = packing.solve({7: 2, 3: 1, 2: 1, 1: 1, 10: 1}, 10)
    assert sorted(plan) == sorted([((10,), 1), ((7, 3), 1), ((7, 2, 1), 1)])
    assert packing.solve({5: 5}, 10) == [((5, 5), 2), ((5,), 1)]
    assert packing.solve({6: 1, 2: 1, 1: 1}, 9) == [((6, 2, 1), 1)]
    assert packing.solve({4: 3, 3: 2, 2: 1}, 9) == packing.solve({2: 1, 3: 2, 4: 3}, 9) and packing.solve({}, 9) == []


def test_slots_cover_all_ranks():
    counts = lengths(9, 500, 50)
    held = {}
    for x, a, m, first, k in packing.slots(packing.solve(dict(counts), 50)):
        for r in range(a, a + m):
            assert (x, r) not in held
            held[x, r] = first + (r - a) // k
    assert Counter(x for x, _ in held) == counts
    load = Counter()
    for (x, _), b in held.items():
        load[b] += x
    assert max(load.values()) <= 50


def check(rows, want, capacity):
    """want: multiset of (id, length); every piece is in one bin, and documents are cut without gaps."""
    got, spans = Counter(), {}
    for r in rows:
        assert r["used"] == sum(r["lengths"]) <= capacity
        for i, s, n in zip(r["doc_ids"], r["starts"], r["lengths"]):
            spans.setdefault(i, []).append((s, n))
    for i, own in spans.items():
        got[i] += sum(n for _, n in own)
    assert got == want and len({r["bin_id"] for r in rows}) == len(rows)


def test_pack(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 3, 17, 60, 99, 100, 101, 250])) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), capacity=100).collect()
    check(got, Counter({i: len(t.split()) for i, t in rows}), 100)
    pieces = [x for _, t in rows for x in [100] * (len(t.split()) // 100) + [len(t.split()) % 100] if x]
    assert len(got) <= 1.02 * best_fit_bins(pieces, 100)


def test_length_column(spark):
    docs = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 0), (5, -2)], "doc_id long, n int")
    got = packing.pack(docs, capacity=10, length=F.col("n")).collect()
    assert [(sorted(r["doc_ids"]), r["used"]) for r in got] == [([1, 2], 10)]


def test_edges(edge, empty):
    got = packing.pack(edge, capacity=1000).collect()
    want = Counter()
    for i, t in ((r["doc_id"], r["text"]) for r in edge.collect()):
        if (t or "").split():
            want[i] += len(t.split())
    check(got, want, 1000)
    assert packing.pack(empty).count() == 0
