"""Named queries over the driver's tables, with the SQL that should give the same rows."""

from __future__ import annotations

from sessionloom.plans import curation, datasets, distill, exports, flows, live, lookup, mining, progress, ranking, review, rules, selecting, signals, stores, timeseries

MODULES = (flows, signals, timeseries, ranking, datasets, curation, review, stores, live, mining, distill, rules, lookup, progress, exports, selecting)


def queries() -> dict:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
