from collections import Counter

import numpy as np
import pytest

from lexisift.llm import mixing


def test_quotas_are_the_largest_mix_in_proportion():
    assert mixing.quotas({"a": 100, "b": 10}, {"a": 1, "b": 1}) == {"a": 10, "b": 10}
    assert mixing.quotas({"a": 100, "b": 10}, {"a": 3, "b": 1}) == {"a": 30, "b": 10}
    assert mixing.quotas({"a": 5, "b": 5}, {"a": 2, "b": 1, "missing": 9}) == {"a": 5, "b": 2}
    assert mixing.quotas({"a": 5}, {"b": 1}) == {} and mixing.quotas({}) == {}
    tempered = mixing.quotas({"a": 10_000, "b": 100})
    assert tempered["b"] == 100 and abs(tempered["a"] - 100 * 100**0.7) <= 1


def test_the_tree_splits_exactly_and_without_bias():
    blocks = np.array([900, 90, 0, 10])
    parts = np.array([mixing.split(blocks, 10, seed=s) for s in range(300)])
    assert (parts.sum(axis=1) == blocks).all() and (parts >= 0).all()
    assert (parts.sum(axis=2) == 100).all()
    assert np.abs(parts.mean(axis=0) - blocks / 10).max() < 1.0
    # the variance of a hypergeometric draw, not of a fixed share
    want = 100 * 0.09 * 0.91 * (900 / 999)
    assert abs(parts[:, :, 1].var() / want - 1) < 0.25


def test_subtrees_are_the_same_tree(spark, monkeypatch):
    blocks = np.array([700, 41, 0, 259])
    whole = mixing.split(blocks, 37, 5)
    parts = mixing.subtrees(blocks, 37, 5, most=4)
    assert (np.vstack([mixing.split(np.array(h), n, 5, a) for a, n, h, _ in parts]) == whole).all() and len(parts) > 8
    monkeypatch.setattr(mixing.subtrees, "__defaults__", (mixing.SEED, 4))
    got = mixing.block_spans(spark, blocks, 37, ["a", "b", "c", "d"], 5).collect()
    ends = whole.cumsum(axis=0)
    want = {("abcd"[j], k, ends[k, j] - whole[k, j], ends[k, j]) for k in range(37) for j in range(4) if whole[k, j]}
    assert {tuple(r) for r in got} == want


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i}", "en", "abc"[min(i % 7, 2)], i) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_mix_holds_its_quotas_without_repeats(docs):
    weights = {"a": 1, "b": 1, "c": 2}
    rows = mixing.mix(docs, weights, rows_per_shard=200, block=16).collect()
    held = {"a": 429, "b": 429, "c": 2142}
    want = mixing.quotas(held, weights)
    assert Counter(r["source"] for r in rows) == want and len({r["doc_id"] for r in rows}) == len(rows)
    shards = -(-sum(want.values()) // 200)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) == set(range(shards))
    for own in by.values():
        assert sorted(r["position"] for r in own) == list(range(len(own)))
        # the shuffle leaves no source in one stretch
        order = [r["source"] for r in sorted(own, key=lambda r: r["position"])]
        assert sum(a != b for a, b in zip(order, order[1:])) > len(order) / 4
    blocks = {s: -(-want[s] // 16) for s in want}
    plan = mixing.split(np.array([blocks[s] for s in sorted(blocks)]), shards)
    for k, own in by.items():
        n = Counter(r["source"] for r in own)
        for j, s in enumerate(sorted(blocks)):
            assert plan[k, j] * 16 - 15 <= n[s] + (plan[k, j] == 0) * 15 and n[s] <= plan[k, j] * 16


def test_same_seed_same_mix(docs):
    one, two = (sorted(map(tuple, mixing.mix(d, rows_per_shard=500).collect())) for d in (docs, docs.repartition(7)))
    assert one == two
    assert sorted(map(tuple, mixing.mix(docs, rows_per_shard=500, seed=3).collect())) != one


def test_edges(edge, empty):
    got = mixing.mix(edge, {None: 1, "a": 1, "b": 1, "c": 1, "": 1})
    assert set(got.columns) == set(edge.columns)
    assert Counter(r["source"] for r in got.collect()) == {None: 1, "a": 1, "b": 1, "c": 1, "": 1}
    assert {r["k"] for r in got.collect()} == {"extra k"} and {r["__s"] for r in got.collect()} == {"extra __s"}
    assert mixing.mix(empty).count() == 0 and mixing.mix(edge, {"nowhere": 1}).count() == 0 and mixing.mix(edge, {}).count() == 0


def test_a_tiny_source_does_not_shrink_the_others(spark):
    assert mixing.quotas({"a": 1_000_000, "b": 1}, epochs=4) == {"a": 1_000_000, "b": 4}
    assert mixing.quotas({"a": 500, "b": 500}, epochs=4) == {"a": 500, "b": 500}
    assert mixing.quotas({"a": 100, "b": 10}, {"a": 1, "b": 1}, size=100) == {"a": 50, "b": 10}
    assert mixing.quotas({"a": 100, "b": 10}, {"a": 1, "b": 1}, size=60, epochs=2) == {"a": 30, "b": 20}
    rows = [(i, f"text {i}", None if i == 0 else "b" if i < 100 else "a") for i in range(30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = {r["source"]: (r["rows"], r["drawn"]) for r in mixing.kept(df, epochs=4).collect()}
    assert report == {None: (1, 4), "b": (99, 396), "a": (29_900, 29_900)}
    some = mixing.kept(df, {"a": 1, "b": 1}, size=500, epochs=3).collect()
    assert {r["source"]: r["drawn"] for r in some} == {None: 0, "a": 250, "b": 250}
    for kw, want in (({"epochs": 4}, {i: 4 if i < 100 else 1 for i in range(30_000)}), ({"weights": {"b": 1}, "size": 250, "epochs": 3}, None)):
        got = mixing.mix(df, **kw).collect()
        n = Counter(r["doc_id"] for r in got)
        if want:
            assert n == want
        else:  # each row twice or thrice, no row more than another by two
            assert len(n) == 99 and sorted(Counter(n.values()).items()) == [(2, 47), (3, 52)]
        assert len({(r["shard"], r["position"]) for r in got}) == len(got)


def test_op1_keeps_every_document(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "rare" if i == 0 else "a") for i in range(1000)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op1_mixing(spark, str(tmp_path)).select("doc_id").distinct().count() == 1000


def brute_mix(rows, hashes, quota, rows_per_shard, block, seed):
    """{(doc_id, shard, position): times}: ranks, tree, blocks and local shuffle row by row. rows: (doc_id, source); hashes: the order of each row, and a function for the shuffle."""
    import xxhash

    def chained(*values):
        """Spark's xxhash64 of longs, ints and strings."""
        h = 42
        for v in values:
            data = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            h = xxhash.xxh64_intdigest(data, h)
        return h - (1 << 64) if h >> 63 else h

    def tree(a, b, have):
        if b - a == 1:
            return {a: have}
        mid = (a + b) // 2
        left = np.random.default_rng([seed, a, b]).multivariate_hypergeometric(have, int(have.sum()) * (mid - a) // (b - a), method="marginals")
        return tree(a, mid, left) | tree(mid, b, have - left)

    names, out = list(quota), []
    shards = max(1, -(-sum(quota.values()) // rows_per_shard))
    plan = tree(0, shards, np.array([-(-quota[s] // block) for s in names]))
    ranges = max(1, -(-len(rows) // 20_000))
    for j, s in enumerate(names):
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (((hashes[r[0]] % (1 << 64)) >> 20) % ranges, hashes[r[0]], r[0]))
        owner = [k for k in range(shards) for _ in range(int(plan[k][j]))]
        for rank in range(quota[s]):
            out.append((own[rank % len(own)][0], owner[rank // block], chained((seed + 1, 4), (rank, 8), f"={s}"), f"={s}", rank))
    got = Counter()
    for k in range(shards):
        for position, r in enumerate(sorted((r for r in out if r[1] == k), key=lambda r: r[2:])):
            got[r[0], k, position] += 1
    return got


@pytest.mark.parametrize("how", [{}, {"epochs": 3}, {"weights": {"a": 2, "c": 1}, "size": 900, "epochs": 2}])
def test_against_a_draw_row_by_row(docs, how):
    from pyspark.sql import functions as F

    seed = 23
    rows = [(r["doc_id"], r["source"]) for r in docs.collect()]
    hashes = {r[0]: r[1] for r in docs.select("doc_id", F.xxhash64(F.lit(seed), "doc_id", "text")).collect()}
    quota = mixing.quotas(Counter(s for _, s in rows), how.get("weights"), size=how.get("size"), epochs=how.get("epochs"))
    got = mixing.mix(docs, rows_per_shard=150, block=16, seed=seed, **how)
    assert Counter((r["doc_id"], r["shard"], r["position"]) for r in got.collect()) == brute_mix(rows, hashes, quota, 150, 16, seed)


def test_texts_come_back_as_they_were(spark):
    texts = [None, "", "a", "Ünïcödé ß 漢字 🙂\n\t", "long " * 400_000, "\x00 nul"]
    df = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["text"] for r in mixing.mix(df).collect()} == dict(enumerate(texts))
    other = df.withColumn("text", df["doc_id"])  # not a string: as it is
    assert {r["text"] for r in mixing.mix(other).collect()} == set(range(len(texts)))
