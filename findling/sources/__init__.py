"""Indices: catalog, documents and bulk ingestion."""

from .bulk import bulk_rows, parse_ndjson
from .catalog import Catalog
from .index import Index, latest
from .readers import columns_of, read_source
from .terms import TermFiles

__all__ = ["Catalog", "Index", "TermFiles", "bulk_rows", "columns_of", "latest", "parse_ndjson", "read_source"]
