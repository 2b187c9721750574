"""Every query by its key, and its oracle."""

from lectern.plans import catalog_queries, index_queries, material_queries, text_queries  # noqa: F401
from lectern.plans.registry import ORACLES, QUERIES  # noqa: F401
