"""All registered queries."""

from catalogq.workloads import building, candidates, catalogue, comparison  # noqa: F401  (they register themselves)
from catalogq.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
