"""Registered queries and their oracle SQL."""

from __future__ import annotations

from . import detection, pieces, privacy, screens, views

QUERIES, ORACLE = {}, {}
for part in (detection, privacy, screens, views, pieces):
    QUERIES |= part.QUERIES
    ORACLE |= part.ORACLE
