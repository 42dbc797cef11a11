import math
import random
import re
import unicodedata

import numpy as np

from lexisift.llm import quality_forest as Q

WORDS = [f"{a}{b}{c}" for a in ("str", "pl", "m", "qu", "th") for b in ("a", "e", "io", "u") for c in ("nd", "ter", "l", "mp", "se")]


def document(rng, good):
    if good:
        return ". ".join(" ".join(rng.choices(WORDS, k=rng.randint(6, 14))).capitalize() for _ in range(rng.randint(4, 20))) + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(rng.choices(["BUY", "NOW!!!", "$$$", "CLICK", "###", "100%"], k=60))
    return "\n".join(["menu | home | login | [x]"] * 20) if kind == 1 else " ".join([rng.choice(WORDS)] * 80)


def test_held_out_accuracy(spark):
    rng = random.Random(4)
    rows = [(i, document(rng, i % 5 > 0), int(i % 5 > 0)) for i in range(1000)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    kept = {r["doc_id"] for r in Q.scores(docs, labels).filter("kept").collect()}
    held = [(i, q) for i, _, q in rows if not i % 2]
    assert sum(i in kept for i, q in held if q) >= 0.98 * sum(q for _, q in held)
    assert sum(i not in kept for i, q in held if not q) >= 0.95 * sum(1 - q for _, q in held)


def brute_path(forest, x, root):
    node = root
    while forest.feature[node] >= 0:
        node = forest.left[node] + int(x[forest.feature[node]] >= forest.value[node])
    return forest.path[node]


def test_path_lengths():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    f = Q.Forest(x, x.min(axis=0), x.max(axis=0), trees=20, subsample=64)
    points = np.vstack([x[:20], [[9.0, 9.0, 9.0]]])
    want = [2.0 ** (-np.mean([brute_path(f, p, r) for r in f.roots]) / Q.average_path(64)) for p in points]
    assert np.allclose(f.score(points), want) and f.score(points)[-1] > f.score(points)[:-1].mean()
    assert Q.average_path(1) == 0 and Q.average_path(2) == 1 and abs(Q.average_path(256) - 10.24) < 0.01


def test_threshold_is_the_share_of_good_rows(spark):
    rows = spark.createDataFrame([(float(k) / 100, 1) for k in range(100)] + [(0.99, 0), (0.5, None)], "score double, quality int")
    assert Q.threshold(rows, 0.9) == 0.89 and Q.threshold(rows, 1.0) == 0.99
    assert Q.threshold(rows.filter("quality = 0"), 0.9) == float("inf")


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 1, 0), (9, 0, 0), (None, 0, 0), (6, None, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.scores(edge, labels).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r for r in got}
    assert not any(by[i]["kept"] for i in (3, 4, 5)) and by[1]["kept"]
    same = [r for r in got if r["doc_id"] == 1]
    assert same[0] == same[1]
    none = Q.scores(edge, labels.limit(0)).collect()
    assert all(r["kept"] and r["score"] == 0 for r in none) and len(none) == 12
    assert Q.scores(empty, labels).count() == 0


def brute_statistics(text):
    text = text or ""
    n, words, lines = max(len(text), 1), [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w], text.split("\n")
    share = lambda test: sum(map(test, text)) / n
    k = max(len(words), 1)
    return [
        share(lambda c: c in "#$%&*@^~<>{}=+\\_"), share(lambda c: unicodedata.category(c) == "Lu"), share(lambda c: c in "0123456789"), share(lambda c: c in "!?"), share(lambda c: c in "|[]/•"),
        math.log1p(sum(c not in " \t\n\x0b\f\r" for c in text) / k), max(1 - len(set(words)) / min(k, 3 * math.sqrt(k)), 0.0), len(words) / n, 1 - len(set(lines)) / max(len(lines), 1),
    ]


def test_statistics_against_plain_python(spark, edge, edge_rows):
    rng = random.Random(9)
    texts = [t for _, t, *_ in edge_rows] + [document(rng, i % 3 > 0) for i in range(60)] + ["".join(rng.choices("aB1 !|#\\_\n\tÄé•", k=200)) for _ in range(60)] + ["x" * 100_000, "A\x0bB\fC\rD"]
    rows = Q.features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_statistics(texts[r["doc_id"]])
        assert all(abs(a - b) < 1e-9 for a, b in zip(r["f"], want)), (texts[r["doc_id"]][:80], r["f"], want)


def test_growth_against_plain_recursion():
    """The same trees grown by a recursion over lists, with the same draws."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 4))
    x[:, 3] = 1.0  # a feature without a range is never split
    low, high = x.min(axis=0) - 0.5 * (np.arange(4) < 3), x.max(axis=0)
    f = Q.Forest(x, low, high, trees=6, subsample=40, depth=7, seed=3)
    draw = np.random.default_rng(3)

    def grow(rows, low, high, at):
        live = [j for j in range(4) if high[j] > low[j]]
        if at >= 7 or len(rows) < 2 or not live:
            return at + Q.average_path(len(rows))
        j = int(draw.choice(np.array(live)))
        v = draw.uniform(low[j], high[j])
        cut = lambda edge: [v if k == j else e for k, e in enumerate(edge)]
        return j, v, grow([r for r in rows if r[j] < v], low, cut(high), at + 1), grow([r for r in rows if r[j] >= v], cut(low), high, at + 1)

    def shape(node):
        if f.feature[node] < 0:
            return f.path[node]
        return int(f.feature[node]), f.value[node], shape(f.left[node]), shape(f.left[node] + 1)

    for root in f.roots:
        own = [list(x[i]) for i in draw.choice(90, 40, replace=False)]
        assert shape(root) == grow(own, list(low), list(high), 0)
