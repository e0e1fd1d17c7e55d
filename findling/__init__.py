"""Search analytics on Spark: documents found by query, then grouped, aggregated and ranked exactly."""

from .mapping import Mapping
from .sources.catalog import Catalog

__all__ = ["Catalog", "Mapping"]
