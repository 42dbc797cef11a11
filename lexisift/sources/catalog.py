"""Names of tables and how expressions resolve to them."""

from __future__ import annotations

import re


def valid_name(name: str) -> bool:
    return 0 < len(name.encode()) <= 255 and name[0] not in ".-_" and not set(name) & set('/\\*?"<>| ,#:')


def resolve(expression: str, names) -> list[str]:
    """Comma-separated names and globs (`*`, `?`, `[..]`), sorted, each once; members that aren't there are skipped."""
    out: set[str] = set()
    for part in expression.split(","):
        if part in ("_all", "*"):
            out |= set(names)
        elif part in names:
            out.add(part)
        elif part:
            pattern = _glob(part)
            out |= {n for n in names if pattern is not None and re.fullmatch(pattern, n, re.S)}
    return sorted(out)


def _glob(text: str) -> str | None:
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if c in "*?":
            out.append(".*" if c == "*" else ".")
        elif c == "[":
            end = text.find("]", i + 2)
            if end < 0:
                return None
            inner = text[i + 1 : end]
            out.append(f"[{'^' if inner[0] == '^' else ''}{re.escape(inner.lstrip('^')).replace(chr(92) + '-', '-')}]")
            i = end
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)
