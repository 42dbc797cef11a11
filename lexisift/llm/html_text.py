"""HTML extraction by line-block distribution.

Markup is stripped so that block tags end a line and sectioning tags end a block (more empty lines
than a window holds). The distribution is the sum of text lengths (without white space) over a
window of WINDOW lines from each line on. Text surges where the sum reaches SURGE and dives where it
falls below DIVE; the lines from each surge point up to its dive point are kept.

The distribution is written as a string with one letter a line (H at or above SURGE, M between, L
below DIVE), in which the kept spans are the matches of ``H[HM]*``. All is in JVM expressions, without a shuffle, and in time
that grows with the length, whatever the markup: no pattern starts again behind a place that it has read to the end from.

Markup
- comments, scripts, styles, titles and noscripts are hidden with what is in them; one that isn't closed hides the rest, as in browsers.
- a tag is `<` and a letter, `/`, `!` or `?`, up to the `>` that isn't in a quoted value. Any other `<` is text. A tag that isn't closed goes up to the end.
- entities are decoded once: decimal and hexadecimal ones and the named ones of HTML 5, if they end with a semicolon; unknown names stay as written.
  A no-break space is a space.

Defined results
- null html: null text, 0 lines; empty html or no surge: empty text, 0 lines.
- repeated rows: alike, each on its own; null ids and urls are kept. Pages are taken whole, however long. Extra columns are ignored. No page, no row.
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, table

WINDOW, SURGE, DIVE = 3, 120, 1
HIDDEN = [r"(?s)<!--.*?-->", r"(?is)<(script)\b.*?</script\s*>", r"(?is)<(style)\b.*?</style\s*>", r"(?is)<(title)\b.*?</title\s*>", r"(?is)<(noscript)\b.*?</noscript\s*>"]
SECTION = r"(?i)</?(article|section|nav|header|footer|main|aside|div|table|ul|ol|dl|form|body|head|html)\b[^>]*>"
BLOCK = r"(?i)</?(p|h[1-6]|li|dt|dd|tr|br|hr|pre|blockquote|option|figure|figcaption|address)\b[^>]*>"
OTHER = r"<[^<>]*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]
#: The same for markup of any kind. A tag's end is looked for behind quoted values; at the end of the page everything ends.
HIDDEN_ALL = r"(?is)<!--.*?(?:-->|\z)|<(script|style|title|noscript)\b.*?(?:</\1\s*+>|\z)"
_REST = r"""(?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\z)"""
TAG = {"section": SECTION.replace("[^>]*>", _REST), "block": BLOCK.replace("[^>]*>", _REST), "other": r"<[a-zA-Z/!?]" + _REST}
ENTITY = r"&(?:#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


def _names() -> str:
    """JSON of entity -> text: the named ones, and numbers that don't stand for their own code point."""
    out = {f"&{k}": v for k, v in html.entities.html5.items() if k.endswith(";")}
    for n in range(128, 160):
        c = bytes([n]).decode("cp1252", "replace")
        out |= {f"&#{n};": c, f"&#x{n:x};": c, f"&#X{n:X};": c, f"&#x{n:X};": c}
    return json.dumps(out | {"&nbsp;": " ", "&#160;": " ", "&#xa0;": " ", "&#xA0;": " "})


def decoded(x: Column) -> Column:
    """Text with its entities decoded, each once."""
    names = F.from_json(F.lit(_names()), "map<string,string>")

    def one(e: Column) -> Column:
        hex_ = F.lower(F.substring(e, 3, 1)) == "x"
        number = F.when(hex_, F.conv(F.regexp_extract(e, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(e, "#([0-9]+)", 1)).cast("long")
        good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(names, e), F.when(F.startswith(e, F.lit("&#")), char).otherwise(e))

    found = F.regexp_extract_all(x, F.lit(ENTITY), F.lit(0))
    chars = F.transform(found, lambda e: F.when(e == "&amp;", "&").when(e == "&lt;", "<").when(e == "&gt;", ">").when(e == "&quot;", '"').otherwise(one(e)))
    between = F.split(x, ENTITY)
    return F.when(x.contains("&"), F.array_join(F.zip_with(between, chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")).otherwise(x)


def strip_markup(html: Column, window: int = WINDOW) -> Column:
    x = F.regexp_replace(html, HIDDEN_ALL, " ")
    x = F.regexp_replace(x, TAG["section"], "\n" * (window + 1))
    x = F.regexp_replace(x, TAG["block"], "\n")
    return F.regexp_replace(x, TAG["other"], "")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", window: int = WINDOW, surge: int = SURGE, dive: int = DIVE, back: bool = False) -> DataFrame:
    """(page_id, url, text, n_lines) for every page. back: a surge takes its whole block, from the last dive point on, so that a heading and a short first paragraph stay."""
    a = pages.select(col(page_id).alias("page_id"), col(url).alias("url"), strip_markup(col(html), window).alias("x"))
    a = a.select("page_id", "url", decoded(F.col("x")).alias("x"))
    a = a.select("page_id", "url", F.transform(F.split(F.regexp_replace("x", r"[ \t\r\f]+", " "), "\n"), lambda x: F.trim(x)).alias("lines"))
    a = a.select("*", F.transform("lines", lambda x: F.length(F.regexp_replace(x, r"[ \t\r\f\n]+", ""))).alias("size"))
    total = F.col("size")
    for k in range(1, window):
        total = F.zip_with(total, F.slice("size", F.lit(k + 1), F.greatest(F.size("size"), F.lit(0))), lambda x, y: x + F.coalesce(y, F.lit(0)))
    letter = lambda s: F.when(s >= surge, "H").when(s >= dive, "M").otherwise("L")
    a = a.select("page_id", "url", "lines", F.array_join(F.transform(total, letter), "").alias("shape"))
    runs = F.regexp_extract_all("shape", F.lit("L+|[HM]+" if back else "[LM]+|H[HM]*"), F.lit(0))
    hit = (lambda r: r.contains("H")) if back else (lambda r: F.startswith(r, F.lit("H")))
    kept = F.flatten(F.transform(runs, lambda r: F.array_repeat(hit(r), F.length(r))))
    pairs = F.filter(F.zip_with("lines", kept, lambda x, k: F.when(k & (x != ""), x)), lambda x: x.isNotNull())
    a = a.select("page_id", "url", pairs.alias("kept"))
    return a.select("page_id", "url", F.array_join("kept", "\n").alias("text"), F.greatest(F.size("kept"), F.lit(0)).alias("n_lines"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _oracle() -> str:
    x = "html"
    for p in HIDDEN:
        x = f"regexp_replace({x}, {_q(p)}, ' ', 'g')"
    nl = " || ".join(["chr(10)"] * (WINDOW + 1))
    x = f"regexp_replace({x}, {_q(SECTION)}, {nl}, 'g')"
    x = f"regexp_replace({x}, {_q(BLOCK)}, chr(10), 'g')"
    x = f"regexp_replace({x}, {_q(OTHER)}, '', 'g')"
    for a, b in ENTITIES:
        x = f"replace({x}, {_q(a)}, {_q(b)})"
    return rf"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, url, html, string_split(regexp_replace({x}, '[ \t\r\f]+', ' ', 'g'), chr(10)) AS ls FROM pages),
l AS (SELECT r, unnest(ls) AS raw, generate_subscripts(ls, 1) AS i FROM p),
s AS (SELECT r, i, trim(raw, ' ') AS x, sum(length(regexp_replace(raw, '[ \t\r\f\n]+', '', 'g'))) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM l),
g AS (SELECT *, sum(CASE WHEN s < {DIVE} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g FROM s),
f AS (SELECT *, min(CASE WHEN s >= {SURGE} THEN i END) OVER (PARTITION BY r, g) AS a FROM g),
k AS (SELECT r, string_agg(x, chr(10) ORDER BY i) AS t, count(*) AS n FROM f WHERE s >= {DIVE} AND i >= a AND x <> '' GROUP BY r)
SELECT page_id, url, CASE WHEN html IS NOT NULL THEN coalesce(t, '') END AS text, CAST(coalesce(n, 0) AS INTEGER) AS n_lines
FROM p LEFT JOIN k USING (r)"""


ORACLES = {"op2_html_text": _oracle()}
