"""Every query of the library by name, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from quillspark.plans import costs, curation, ledger, profile, search, state, tracker

_PARTS = (costs, ledger, search, tracker, curation, profile, state)

QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
