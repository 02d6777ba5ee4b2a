"""All registered queries."""

from quirefold.plans import batch_queries, layout_queries, reading_queries, text_queries, thread_queries  # noqa: F401
from quirefold.plans.registry import ORACLES, QUERIES  # noqa: F401
