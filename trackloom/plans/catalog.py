"""All registered queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from trackloom.plans import extras, geometry, judged, loading, rebuilt, requirements, streams, targets, timelines, tracks

_MODULES = (loading, timelines, requirements, targets, rebuilt, geometry, extras, judged)


def queries() -> dict:
    found = {name: getattr(m, name) for m in _MODULES for name in m.SQL}
    return found | rebuilt.QUERIES | judged.QUERIES | tracks.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in (*_MODULES, streams) for name, sql in m.SQL.items()}
