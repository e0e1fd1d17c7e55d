"""Query operators: clauses, scoring, search requests, aggregations, vectors and fusion."""

from .aggs import aggregate
from .clauses import Clause, translate
from .knn import knn, rrf
from .scoring import bm25
from .search import SearchResult, count, search

__all__ = ["Clause", "SearchResult", "aggregate", "bm25", "count", "knn", "rrf", "search", "translate"]
