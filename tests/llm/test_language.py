import math
import random
from collections import Counter

import numpy as np

from lexisift.llm import language_id as L

STEMS = {"aa": ["kala", "mita", "sano", "tuli", "vene"], "bb": ["stark", "bricht", "schon", "wurde", "nacht"], "cc": ["oiseau", "beaux", "quelque", "jour", "lieu"]}


def text(rng, lang, n=30):
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(["", "n", "s", "e"]) for _ in range(n))


def rows(seed, n):
    rng = random.Random(seed)
    return [(i, text(rng, lang := rng.choice(sorted(STEMS)), rng.randint(3, 40)), lang) for i in range(n)]


def test_held_out_accuracy(spark):
    train = spark.createDataFrame(rows(1, 200), "doc_id long, text string, lang string")
    names, logp = L.train(train)
    held = rows(2, 300)
    out = L.decide(*L.score([t for _, t, _ in held], logp), names)
    assert (out["lang"].to_numpy() == np.array([x for *_, x in held])).mean() > 0.99 and out["confidence"].between(1 / 3, 1).all()


def test_against_counting(spark):
    train = rows(3, 40)
    names, logp = L.train(spark.createDataFrame(train, "doc_id long, text string, lang string"), alpha=0.5)
    assert names == sorted(STEMS)
    probe = "Kala schon quelque"
    total, count = L.score([probe], logp)
    for j, lang in enumerate(names):
        want = 0.0
        for k in range(len(L.ORDERS)):
            seen = Counter(b for _, t, x in train if x == lang for b in L.grams(t)[k].tolist())
            all_ = sum(seen.values()) + 0.5 * (1 << L.BITS)
            want += sum(math.log((seen[b] + 0.5) / all_) for b in L.grams(probe)[k].tolist())
        assert abs(total[0, j] - want) < 1e-2
    assert count[0] == sum(len(g) for g in L.grams(probe))


def test_slices_lose_no_n_gram(monkeypatch):
    rng = np.random.default_rng(1)
    logp = rng.normal(size=(2, len(L.ORDERS) << L.BITS)).astype(np.float32)
    texts = ["ab", None, "", "x" * 999, "Ünïcödé 漢字 🙂 " * 50, "q"]
    whole = L.score(texts, logp)
    monkeypatch.setattr(L, "SLICE", 64)
    monkeypatch.setattr(L.batches, "__defaults__", (64,))
    cut = L.score(texts, logp)
    assert np.allclose(whole[0], cut[0], rtol=1e-5, atol=1e-2) and (whole[1] == cut[1]).all()


def test_bounded_sample(spark):
    df = spark.createDataFrame(rows(5, 600), "doc_id long, text string, lang string")
    assert L.train(df, max_train_rows=60)[0] == sorted(STEMS)


def test_edges(spark, edge, empty):
    got = {r["doc_id"]: r for r in L.identify(edge).collect()}
    assert got[3]["lang"] == got[4]["lang"] == "und" and not got[3]["accepted"] and got[1]["accepted"] and got[7]["n_grams"] == 3
    kept = L.filter_language(edge)
    assert kept.columns == edge.columns and {3, 4}.isdisjoint({r["doc_id"] for r in kept.collect()}) and kept.filter("doc_id = 1").count() == 2
    bare = L.identify(edge.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert all(r["lang"] == "und" and r["confidence"] == 0 for r in bare) and sum(r["accepted"] for r in bare) == 10
    assert L.identify(empty).count() == 0 and L.filter_language(empty).count() == 0


def test_texts_in_no_trained_language_are_rejected(spark):
    held = [(1000 + i, t, None, True) for i, t, _ in rows(8, 200)]
    foreign = ["Однажды весною, в час небывало жаркого заката, в Москве появились два гражданина. ", "在很久很久以前有一个国家住着一位年老的国王", "Litwo, ojczyzno moja, ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie. ", "#$%&*", "3141592653589793238462643383279", "deadbeef0123456789abcdef4c7a11"]
    planted = [(2000 + i, x * n, None, False) for n in (5, 60) for i, x in enumerate(foreign, 10 * n)]
    docs = [(*r, True) for r in rows(7, 400)] + held + planted
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, want boolean")
    got = {r["doc_id"]: r for r in L.identify(df).collect()}
    assert [i for i, *_, want in docs if got[i]["accepted"] != want] == []
    assert all(got[i]["lang"] == "und" and got[i]["confidence"] == 0 for i, *_ in planted)
    assert {r["doc_id"] for r in L.filter_language(df).collect()}.isdisjoint({i for i, *_ in planted})


def test_ties_go_to_the_first_language(spark):
    """Two languages with the same texts are as likely; the alphabetically first is given."""
    text = "words that both of them have in the same order and number"
    df = spark.createDataFrame([(i, text, "bb" if i % 2 else "aa") for i in range(40)], "doc_id long, text string, lang string")
    assert {(r["lang"], r["confidence"]) for r in L.identify(df).collect()} == {("aa", 0.5)}


def test_the_sample_takes_whole_texts(spark):
    """Texts that are alike at both ends and as long are drawn or left each for itself."""
    ends = "x" * 80
    df = spark.createDataFrame([(f"{ends} {i:06d} {ends}", "aa") for i in range(2000)], "text string, lang string")
    n = L.sample(df, "text", "lang", 500).count()
    assert 400 < n < 600
