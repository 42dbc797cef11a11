"""Text analysis as JVM expressions, with the same rules in Python for query literals.

A token is a maximal run of letters and decimal digits, in lower case and with Latin accents folded.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåèéêëìíîïòóôõöøùúûüýÿçñß"
PLAIN = "aaaaaaeeeeiiiioooooouuuuyycns"
TOKEN = r"[\p{L}\p{Nd}]+"
#: Left between the values of a multi-valued text, so that no phrase spans two of them.
GAP = 100
_FOLD = str.maketrans(ACCENTED, PLAIN)


def _lower(text: Column) -> Column:
    """Lower case; Σ and İ by themselves, as the JVM lowers them by their context. translate is slow, so only texts that hold them go through it."""
    special = text.contains("Σ") | text.contains("İ")
    return F.lower(F.when(special, F.translate(text, "Σİ", "σi")).otherwise(text))


def normalize(text: Column) -> Column:
    """Lower case, accents folded."""
    low = _lower(text)
    return F.when(F.octet_length(low) == F.length(low), low).otherwise(F.translate(low, ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    """ASCII texts, where there is nothing to fold, go by a pattern that costs far less."""
    low = _lower(text)
    rest = F.regexp_extract_all(F.translate(low, ACCENTED, PLAIN), F.lit(TOKEN), F.lit(0))
    return F.when(F.octet_length(low) == F.length(low), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))).otherwise(rest)


def token_array(values: Column, many: bool) -> Column:
    """Tokens of a text or an array of texts; between two values stand GAP nulls. Null for null."""
    if not many:
        return tokens(values)
    gap = F.array_repeat(F.lit(None).cast("string"), GAP)
    spread = F.transform(values, lambda x, i: F.when(i == 0, tokens(x)).otherwise(F.concat(gap, tokens(x))))
    return F.flatten(spread)


def py_normalize(text: str) -> str:
    return "".join(_py_lower(c) for c in text).translate(_FOLD)


def _py_lower(c: str) -> str:
    low = c.lower()
    return low if len(low) == 1 else low[0]


def py_tokens(text: str) -> list[str]:
    out, run = [], []
    for c in py_normalize(text):
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return out + (["".join(run)] if run else [])


def latin1(text: Column) -> Column:
    """The UTF-8 bytes as characters, for rules that count bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def py_latin1(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").decode("latin-1")


def glob_regex(pattern: str, any_: str, one: str) -> str:
    """A glob (`*`, `?`, no escape) as a regular expression over bytes."""
    return "".join(any_ if c == "*" else one if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c) if c.isascii() else c for c in py_latin1(pattern))
