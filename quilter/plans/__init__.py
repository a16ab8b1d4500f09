"""Named queries: each operator applied to the driver's tables, with SQL to hold it against."""

from __future__ import annotations

from quilter.plans.imaging import IMAGING
from quilter.plans.registry import Registry
from quilter.plans.scalar import SCALAR

REGISTRY = Registry()
for part in (SCALAR, IMAGING):
    for name, query in part.queries.items():
        REGISTRY.add(name, query, part.oracles.get(name))
