"""All queries outside the training-data subpackage."""

from __future__ import annotations

from . import fit_queries, history_queries, lookup_queries, point_queries, survey_queries, view_queries, wave_queries

FLAGSHIP = "wave_site_summary"
_ALL = {**wave_queries.QUERIES, **survey_queries.QUERIES, **history_queries.QUERIES, **lookup_queries.QUERIES, **point_queries.QUERIES, **fit_queries.QUERIES, **view_queries.QUERIES}
QUERIES = {name: query for name, (query, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
