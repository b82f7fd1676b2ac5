"""All queries of the operators, with their SQL."""

from __future__ import annotations

from tessera.operators import adjudication, assistants, cascade, channels, drafts, families, lexical, live_quality, plan_choice, planning, policy, relational, remediation, retrieval, rules, scopes, selection, sequential, structure

_MODULES = (lexical, relational, structure, policy, retrieval, rules, sequential, planning, families, assistants, cascade, plan_choice, channels, scopes, selection, adjudication, live_quality, remediation, drafts)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
