"""Every named query outside the optional subpackage, with its SQL."""

from __future__ import annotations

from .plans import answers, files, further, geometry, io, metrics, public, records, stored, whole

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (geometry, answers, metrics, public, io, further, files, stored, records, whole):
    QUERIES |= _part.catalogue.queries
    ORACLE_SQL |= _part.catalogue.sql
