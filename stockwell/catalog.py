"""The registry of the library's queries and of their SQL twins."""

from __future__ import annotations

from stockwell.plans import analytics, flows, joinshapes, reads, telemetry, workload

QUERIES, ORACLES = {}, {}
for _module in (reads, joinshapes, flows, telemetry, workload, analytics):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
