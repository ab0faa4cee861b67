"""All queries of the catalogue, once their modules are read."""

from evidentia.plans import extras, more_queries, numeric, record_queries, texts, vector_queries  # noqa: F401
from evidentia.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
