"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import importlib

MODULES = ["mixing", "html_text", "fingerprint", "line_dedup", "quality_forest", "packing", "token_files", "url_filter", "jaccard_join", "language_id"]


def registered() -> tuple[dict, dict]:
    """Queries and SQL of all operators, in the order of their numbers."""
    queries, oracles = {}, {}
    for m in MODULES:
        module = importlib.import_module(f"{__name__}.{m}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
