"""All registered queries."""

from checks import q_corpus, q_drift, q_impact, q_lineage, q_warehouse  # noqa: F401
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
