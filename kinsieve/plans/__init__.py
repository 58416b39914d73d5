"""Driver queries of the reference-side operators, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from . import detection, media, records, rules, runs

_ALL = (media, detection, records, rules, runs)
QUERIES = {name: query for module in _ALL for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _ALL for name, sql in module.ORACLE.items()}
