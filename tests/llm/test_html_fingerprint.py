import hashlib
import time

import pytest
from pyspark.sql import functions as F

from lexisift.llm import fingerprint, html_text

BODY = "This is a long paragraph of real text that goes on and on, with enough letters in it to surge above the rest of the page. " * 2
PAGE = f"<html><head><title>T</title><script>var a = '<p>x</p>';</script></head><body><nav><ul><li>Home</li><li>About</li></ul></nav><article><p>{BODY}</p><p>Short &amp; sweet.</p></article><footer>(c) us</footer></body></html>"


def test_html_keeps_the_dense_block(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<ul><li>a</li></ul>"), (None, "u", "plain text without markup " * 20), (5, "u", "<" * 5000), (6, "u", f"<p>{'word ' * 300_000}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("lines", "size", "shape", "kept", "text")})
    got = [(r["page_id"], r["text"], r["n_lines"]) for r in html_text.extract(df).collect()]
    assert got[0] == got[1] == (1, BODY.strip() + "\nShort & sweet.", 2)
    assert got[2] == (2, None, 0) and got[3] == (3, "", 0) and got[4] == (4, "", 0) and got[5][1].startswith("plain text") and len(got[7][1]) == 1_499_999
    assert html_text.extract(df.limit(0)).count() == 0


CASES = [
    ("Caf&eacute; it&#8217;s &#x2014; &unknown; &amp;lt; &#0; &#xD800; &#150; &NotEqualTilde; a&b &#x1F642;", "Café it’s — &unknown; &lt; \ufffd \ufffd – \u2242\u0338 a&b 🙂"),
    ("a < b and c > d <3 and 1<2", "a < b and c > d <3 and 1<2"),
    ('x <img alt="a > b" src=x> y <a title=\'p > q\' href = "z">link</a> <p class=o\'neil>end', "x  y link\nend".replace("  ", " ")),
    ("before <script>var a = 1;", "before"),
    ("before <style>p {}", "before"),
    ("before <!-- never closed <p>text</p>", "before"),
    ("<script>s = '<!--';</script>after", "after"),
    ("<SCRIPT>x</Script >after<!-- c -->more", "after more"),
    ("cut off <b class=", "cut off"),
    ("<title>T</title>body<noscript>no</noscript>", "body"),
]


def test_markup_of_all_kinds(spark):
    rows = [(i, h) for i, (h, _) in enumerate(CASES)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit("u")), surge=1).collect()}
    assert got == {i: t for i, (_, t) in enumerate(CASES)}


@pytest.mark.parametrize("bad", ["<script ", "<!-- ", "<div ", "<div a=\"", "<p a='\"", "</script ", "<", "&#", "&amp", "<p><", "x\n"])
def test_time_grows_with_the_length(spark, bad):
    """A page of a million characters of bad markup."""
    df = spark.createDataFrame([(1, "u", bad * (1_000_000 // len(bad)))], "page_id long, url string, html string")
    html_text.extract(df.limit(1)).collect()
    began = time.time()
    html_text.extract(df).collect()
    assert time.time() - began < 8


def test_back_takes_the_whole_block(spark):
    html = f"<nav><li>a</li></nav><article><h1>Heading</h1><p>Short.</p><p>Still short.</p><p>x</p><p>{BODY}</p></article><footer>f</footer>"
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    text = lambda **how: html_text.extract(df, **how).first()["text"]
    assert text() == f"x\n{BODY.strip()}"
    assert text(back=True) == f"Heading\nShort.\nStill short.\nx\n{BODY.strip()}"
    assert text(window=1) == BODY.strip() and text(surge=10_000) == ""


def wide(p):
    h = hashlib.sha256(p.encode()).hexdigest()
    w = "".join(hashlib.sha256(f"{h}:{k}".encode()).hexdigest() for k in range(4))
    return [int(w[i : i + 8], 16) for i in range(0, 256, 8)]


def brute(text):
    parts = [" ".join(p.replace("\t", " ").split(" ")).strip() for p in (text or "").split("\n")]
    vectors = [wide(" ".join(p.split())) for p in parts if p.strip()]
    return "".join(f"{sum(v[i] for v in vectors) % 2**32:08x}" for i in range(32))


def test_fingerprints(spark, edge, edge_rows, empty):
    got = fingerprint.fingerprints(edge).collect()
    assert sorted((r["doc_id"] or 0, r["fingerprint"]) for r in got) == sorted((i or 0, brute(t)) for i, t, *_ in edge_rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_copies"] == by[2]["n_copies"] == 3 and by[2]["first_doc_id"] == 1 and by[8]["first_doc_id"] == 7
    assert (by[4]["n_paragraphs"], by[4]["n_copies"], by[4]["first_doc_id"]) == (0, 0, None) and by[3]["fingerprint"] == "0" * 256
    assert fingerprint.fingerprints(empty).count() == 0


def test_homomorphism(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["b", "c"])], "x array<string>, y array<string>")
    fp = fingerprint.fingerprint
    r = df.select(
        fp(F.array(*map(F.lit, "bab"))).alias("moved"), fp(F.col("x")).alias("own"), fp(F.array(*map(F.lit, "ab"))).alias("fewer"),
        fingerprint.insert(fp(F.col("x")), F.col("y")).alias("inserted"), fp(F.concat("x", "y")).alias("both"), fingerprint.delete(fp(F.concat("x", "y")), F.col("y")).alias("deleted"), fingerprint.combine(fp(F.col("x")), fp(F.col("y"))).alias("combined"),
    ).first()
    assert r["moved"] == r["own"] == r["deleted"] != r["fewer"] and r["inserted"] == r["both"] == r["combined"]
