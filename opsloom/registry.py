"""Registration of queries beside their oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle:
            ORACLES[name or f.__name__] = oracle
        return f

    return add
