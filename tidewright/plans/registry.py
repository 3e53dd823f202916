"""Named queries and their SQL twins."""

from __future__ import annotations

from tidewright.plans import fusion, measurements, propagation, service, solutions

FLAGSHIP = "hourly_fusion"

QUERIES = {**fusion.QUERIES, **measurements.QUERIES, **propagation.QUERIES, **service.QUERIES, **solutions.QUERIES}
#: Those of ``propagation``, ``service`` and ``solutions`` are registered with those of ``measurements``.
ORACLES = {**fusion.ORACLES, **measurements.ORACLES}
