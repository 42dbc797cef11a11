import itertools
import math

import pytest

from lexisift.llm import url_filter as U


def brute_split(label, cost, base):
    best = None
    for cuts in itertools.product((0, 1), repeat=len(label) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(label)]
        parts = [label[a:b] for a, b in zip(at, at[1:])]
        total = sum(cost.get(p, base + U.LETTER * len(p)) for p in parts)
        if best is None or total < best[0] - 1e-9:
            best = total, parts
    return best


@pytest.mark.parametrize("label", ["dogfood", "cheapcarsale", "xqzdog", "a", "ofthe", "therapist", "dogxqzfoodqq", "thexdogyfood"])
def test_viterbi(label):
    cost = {w: math.log(1000 / n) for w, n in {"dog": 50, "food": 40, "cheap": 9, "car": 30, "cars": 12, "sale": 8, "ale": 2, "of": 300, "the": 400, "therapist": 3, "rapist": 2, "a": 100}.items()}
    got = U.viterbi(label, cost)
    total, want = brute_split(label, cost, U.BASE)
    assert "".join(got) == label and abs(sum(cost.get(p, U.BASE + U.LETTER * len(p)) for p in got) - total) < 1e-9
    assert got == want


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, "the garden shop sells plants and news about weather casino bet pills") for i in range(200)], "doc_id long, text string")


def test_scores_follow_naive_bayes(spark, docs):
    rows = [(1, "http://casino-bet.example.com/play/now"), (2, "http://gardenshop.example.com/plants/list"), (3, "https://user@weather.example.org:80/news?today=1"), (4, "http://casinobet.example.com/play"), (5, "http://plants.example.com/news"), (6, "http://bet.example.com/play/now")]
    got = {r["page_id"]: r for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), docs).collect()}
    assert got[2]["host_words"] == "garden shop" and got[4]["host_words"] == "casino bet"
    assert got[3]["host"] == "weather.example.org"
    tokens = {1: ["casino", "bet", "/play", "/now"], 2: ["garden", "shop", "/plants", "/list"], 3: ["weather", "/news", "/today"], 4: ["casino", "bet", "/play"], 5: ["plants", "/news"], 6: ["bet", "/play", "/now"]}
    bad = {1, 6}
    names = {t for x in tokens.values() for t in x}
    count = lambda t, side: sum(x.count(t) for i, x in tokens.items() if (i in bad) == side)
    total = {s: sum(count(t, s) for t in names) for s in (True, False)}
    odds = lambda t: math.log((count(t, True) + 1) / (total[True] + len(names))) - math.log((count(t, False) + 1) / (total[False] + len(names)))
    for i, x in tokens.items():
        assert abs(got[i]["score"] - (math.log(3 / 5) + sum(map(odds, x)))) < 1e-6
    assert got[1]["blocked"] and got[4]["blocked"] and not got[2]["blocked"] and not got[5]["blocked"]


def test_edges(spark, docs, empty):
    rows = [(1, None), (2, ""), (3, "no host"), (4, "http://"), (None, "http://ads.example.com/x"), (5, "http://ads.example.com/x"), (5, "http://ads.example.com/x"), (6, "http://" + "z" * 90 + ".com/"), (7, "http://WWW.Shop.com"), (8, "http://пример.рф/a")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for c in ("host", "words", "key", "score", "label"):
        pages = pages.selectExpr("*", f"'x' AS {c}")
    got = U.filter_urls(pages, docs).collect()
    assert len(got) == 10
    by = {r["page_id"]: r for r in got}
    assert all(by[i]["host"] is None and by[i]["score"] == 0 and not by[i]["blocked"] for i in (1, 2, 3, 4))
    assert by[6]["host_words"] == "z" * 90 and by[7]["host_words"] == "shop" and by[None]["blocked"]
    assert len({(r["score"], r["blocked"]) for r in got if r["page_id"] == 5}) == 1
    assert all(r["score"] == 0 for r in U.filter_urls(pages.filter("page_id = 7"), docs).collect())
    assert U.filter_urls(pages.limit(0), docs).count() == 0
    assert {r["host_words"] for r in U.filter_urls(pages.filter("page_id = 7"), empty).collect()} == {"shop"}


def test_labelled_hosts_and_held_out_accuracy(spark):
    """Hosts of two vocabularies, none of which is a seed; half of the hosts have labels, the others are judged."""
    import random

    rng = random.Random(6)
    good, bad = ["garden", "river", "school", "museum", "bread", "music", "travel"], ["lucky", "jackpot", "spin", "roulette", "bonus", "cash", "win"]
    docs = spark.createDataFrame([(i, " ".join(good + bad)) for i in range(300)], "doc_id long, text string")
    hosts = [("".join(rng.sample(w, 2)) + f"{i}.com", w is bad) for i in range(200) for w in (good, bad)]
    pages = spark.createDataFrame([(i, f"http://{h}/page/{i % 3}") for i, (h, _) in enumerate(hosts)], "page_id long, url string")
    known = spark.createDataFrame([(h.upper(), b) for h, b in hosts[::2] + hosts[1::4]] + [(None, True), ("nowhere.com", True), (hosts[0][0], None)], "host string, unwanted boolean")
    got = {r["page_id"]: r["blocked"] for r in U.filter_urls(pages, docs, labels=known).collect()}
    held = [i for i in range(len(hosts)) if i % 4 == 3]
    assert len(got) == 400 and all(hosts[i][1] for i in held) and sum(got[i] for i in held) >= 0.98 * len(held)
    assert not any(got[i] for i in range(0, 400, 2))
    assert not any(r["blocked"] for r in U.filter_urls(pages, docs).collect())  # no seed, nothing to learn
    own = U.filter_urls(pages, docs, seeds=["jackpot"]).collect()
    assert len(own) == 400 and not any(r["blocked"] for r in own if not hosts[r["page_id"]][1])
    assert not any(r["blocked"] for r in U.filter_urls(pages, docs, labels=known.filter("not unwanted")).collect())


def test_labels_of_any_length(spark, docs):
    pages = spark.createDataFrame([(1, f"http://{'garden' * 400}shop.com/x")], "page_id long, url string")
    assert U.filter_urls(pages, docs).first()["host_words"] == " ".join(["garden"] * 400 + ["shop"])
