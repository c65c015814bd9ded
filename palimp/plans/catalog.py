"""All core queries by name, with the SQL that says the same."""

from __future__ import annotations

from palimp.plans import queries_revisions, queries_text

_ALL = {**queries_revisions.QUERIES, **queries_text.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items() if sql}
