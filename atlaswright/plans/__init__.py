"""Registered queries: operators applied to frames of the driver tables, each with its SQL."""

from __future__ import annotations

from . import assembly, audits, checks, details, exports, joins, lookups, paths, reports, routes, rules, scalars, scans, shapes

MODULES = [scalars, paths, joins, routes, audits, scans, assembly, exports, details, lookups, rules, shapes, checks, reports]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
