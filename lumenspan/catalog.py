"""The registered queries and their SQL, collected from the operator modules."""

from __future__ import annotations

from lumenspan.plans import aggregates, artifacts, control, frames, geometry, joins, kernels, listings, masks, predicates, records, streams, strings, windows  # noqa: F401
from lumenspan.registry import ORACLES, QUERIES

FLAGSHIP = "agg05_image_score"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
