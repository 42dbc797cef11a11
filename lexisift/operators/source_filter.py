"""Which parts of a document are returned. Only top-level keys are told apart."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F


def _hits(pattern: str, key: str) -> bool:
    glob = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return key == pattern or key.startswith(f"{pattern}.") or re.fullmatch(glob, key, re.S) is not None


def patterns(spec) -> tuple[bool, list[str], list[str]]:
    """(anything at all, includes, excludes) of a `_source` value."""
    if spec is False:
        return False, [], []
    if isinstance(spec, str):
        return True, [spec], []
    if isinstance(spec, list):
        return True, [x for x in spec if isinstance(x, str)], []
    if not isinstance(spec, dict):
        return True, [], []

    def part(name: str) -> list[str]:
        v = spec.get(name)
        return [v] if isinstance(v, str) else [x for x in v if isinstance(x, str)] if isinstance(v, list) else []

    return True, part("includes"), part("excludes")


def keep(keys: list[str], includes: list[str], excludes: list[str]) -> list[str]:
    out = [k for k in keys if not includes or any(_hits(p, k) for p in includes)]
    return [k for k in out if not any(_hits(p, k) for p in excludes)]


def json_filter(includes: list[str], excludes: list[str]):
    """For raw JSON documents: the kept keys in order, numbers as doubles."""

    @F.pandas_udf("string")
    def run(docs: pd.Series) -> pd.Series:
        def one(raw: str) -> str:
            doc = json.loads(raw, parse_int=float)
            plain = lambda v: {k: plain(x) for k, x in sorted(v.items())} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e21 else v
            return json.dumps({k: plain(doc[k]) for k in sorted(keep(list(doc), includes, excludes))}, ensure_ascii=False, separators=(",", ":"))

        return docs.map(one, na_action="ignore")

    return run
