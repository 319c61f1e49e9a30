"""All named queries."""

from sparkloom.plans import batch_queries, item_queries, metric_queries, stream_queries, vector_queries  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES  # noqa: F401
