"""Every registered query of the engine and its DuckDB form."""

from __future__ import annotations

from . import composites, formats, lens, positional, quality_checks, relational, sequences, stores, texts  # noqa: F401  (they register their queries)


def queries() -> dict:
    return dict(lens.QUERIES)


def oracles() -> dict[str, str]:
    return dict(lens.ORACLES)
