"""Registered queries of the library's own operators with their SQL."""

from __future__ import annotations

from . import answers, gating, labelling, streams, tables, text

MODULES = (text, gating, labelling, answers, streams, tables)

QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
