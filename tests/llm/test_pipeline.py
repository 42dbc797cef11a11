from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline as P
from lexisift.llm import jaccard_join, language_id, mixing, packing, registered
from tests.conftest import compare

from .brute import groups, line_dedup, near_pairs


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    (_, identify), (_, dedup), (_, near), (_, mix), (_, pack) = P.STAGES
    held = []
    for stage in (identify, dedup, near, mix):
        docs = stage(spark, docs, small)
        assert docs.columns == columns
        docs = jaccard_join.cut(docs)
        held.append({r["doc_id"]: r for r in docs.collect()})
    names, logp = language_id.train(spark.read.parquet(f"{small}/documents.parquet"))
    said = language_id.decide(*language_id.score([r["text"] for r in rows.values()], logp), names)
    assert held[0].keys() == {i for i, n, c in zip(rows, said["n_grams"], said["confidence"]) if n > 0 and c >= 0.5}
    want = {i: t for i, t in line_dedup([(i, r["text"]) for i, r in held[0].items()]).items() if t is not None}
    assert {i: r["text"] for i, r in held[1].items()} == want and all(r["n_chars"] == len(r["text"]) for r in held[1].values())
    texts = [(i, r["text"]) for i, r in held[1].items()]
    root = groups([i for i, _ in texts], near_pairs(texts))
    assert held[2].keys() == {i for i, r in root.items() if i == r}
    sources = Counter(r["source"] for r in held[2].values())
    assert Counter(r["source"] for r in held[3].values()) == mixing.quotas(dict(sources)) and held[3].keys() <= held[2].keys()
    bins = pack(spark, docs, small).collect()
    used = Counter()
    for b in bins:
        assert b["used"] == sum(b["lengths"]) <= packing.CAPACITY
        for i, n in zip(b["doc_ids"], b["lengths"]):
            used[i] += n
    assert used == Counter({i: len(r["text"].split()) for i, r in held[3].items() if r["text"].split()})


def test_run(spark, small):
    out = P.run(spark, small)
    assert out.columns == ["bin_id", "doc_ids", "starts", "lengths", "used"] and out.count() > 0


def test_stages_take_any_rows(spark, edge, edge_rows, empty, plain_edge):
    """Nulls, empty and long texts, ties, repeated rows and columns that are called like helpers; then no row at all, and no n_chars."""
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs, held = edge, []
    for _, stage in P.STAGES[:-1]:
        docs = jaccard_join.cut(stage(spark, docs, ""))
        assert docs.columns == edge.columns and docs.schema["n_chars"].dataType == edge.schema["n_chars"].dataType
        assert all(r[c] == f"extra {c}" for r in docs.collect() for c in edge.columns if c not in names)
        held.append(Counter(tuple(r[c] for c in names) for r in docs.collect()))
    given = Counter(edge_rows)
    assert held[0] <= given and all(r[1] for r in held[0]) and sum(held[0].values()) >= 8
    want = line_dedup([(i, t) for i, t, *_ in held[0] if i is not None])
    assert held[1] == Counter({(r[0], t, r[2], r[3], len(t)): n for r, n in held[0].items() if (t := r[1] if r[0] is None else want[r[0]]) is not None})
    ids = [i for i, *_ in held[1] if i is not None]
    root = groups(ids, near_pairs([(i, t) for i, t, *_ in held[1]]))
    assert held[2] == Counter({r: n for r, n in held[1].items() if r[0] is None or root[r[0]] == r[0]})
    sources = Counter()
    for r, n in held[2].items():
        sources[r[3]] += n
    drawn = Counter()
    for r, n in held[3].items():
        drawn[r[3]] += n
    quota = mixing.quotas({"" if k is None else f"={k}": n for k, n in sources.items()})
    assert held[3] <= held[2] and drawn == Counter({k: quota["" if k is None else f"={k}"] for k in sources})
    used = Counter()
    for b in P.STAGES[-1][1](spark, docs, "").collect():
        for i, n in zip(b["doc_ids"], b["lengths"]):
            used[i] += n
    words = Counter()
    for r, n in held[3].items():
        words[r[0]] += n * len(r[1].split())
    assert used == words
    nothing = empty
    for _, stage in P.STAGES:
        nothing = stage(spark, nothing, "")
    assert nothing.count() == 0
    assert P.delete_repeated_lines(spark, plain_edge.drop("n_chars"), "").columns == names[:-1]
    kept = {r["doc_id"]: r["n_chars"] for r in P.delete_repeated_lines(spark, plain_edge.withColumn("n_chars", plain_edge["doc_id"] + 100), "").collect()}
    assert kept[3] == 103 and kept[4] == 0


def test_run_leaves_one_stage_behind(spark, edge, tmp_path):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    folders = lambda: {p.name.rpartition("-")[0] for p in shared.iterdir() if p.name.rpartition("-")[0] in {n.replace(" ", "-") for n, _ in P.STAGES}}
    for p in shared.iterdir():
        if p.name.startswith(("language-ID-", "line-dedup-", "near-duplicates-", "mixing-")):
            p.rename(tmp_path / p.name)
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0 and folders() == {"mixing"}


def test_registered(spark, small):
    have = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in registered()[0]} and "pipeline" in have


@pytest.mark.parametrize("name", sorted(registered()[1]))
def test_against_sql(spark, small, duck, name):
    queries, oracles = registered()
    got, want = compare(spark, duck, queries[name], oracles[name], small)
    assert got == want
