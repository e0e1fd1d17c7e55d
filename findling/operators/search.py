"""Search requests: query, sort, paging, keyset cursors, aggregations, vectors and fusion."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IllegalArgument, ParsingError
from ..functions import ident, null_last
from ..mapping import Mapping
from .aggs import aggregate
from .clauses import Clause, translate, typed
from .knn import knn, rrf
from .scoring import bm25


@dataclass
class SearchResult:
    """Lazy results: ``hits`` (a page), ``matched`` (all rows of the query) and ``aggs`` by name."""

    hits: DataFrame
    matched: DataFrame
    aggs: dict[str, DataFrame] = field(default_factory=dict)
    sorted: bool = False

    def total(self) -> int:
        return self.matched.count()

    def max_score(self) -> float | None:
        """The best score of the page; null for sorted pages."""
        return None if self.sorted else self.hits.agg(F.max("_score")).first()[0]


def sort_keys(sort: object) -> list[tuple[str, bool]]:
    """(field, descending) of every sort clause; ``_score`` alone descends."""
    out = []
    for item in sort if isinstance(sort, list) else [sort]:
        if isinstance(item, str):
            out.append((item, item == "_score"))
        elif isinstance(item, dict) and len(item) == 1:
            name, spec = next(iter(item.items()))
            order = spec.get("order", "desc" if name == "_score" else "asc") if isinstance(spec, dict) else spec
            if order not in ("asc", "desc"):
                raise ParsingError(f"unknown sort order [{order}]")
            out.append((name, order == "desc"))
        else:
            raise ParsingError("a sort clause is a field or an object with one field")
    return out


def after(keys: list[tuple[str, bool]], values: list, mapping: Mapping) -> Column:
    """Rows strictly after a cursor in the order of ``keys``; null is the greatest value."""
    out, equal = "false", "true"
    for (name, descending), value in zip(keys, values, strict=True):
        column, kind = ident(name), "keyword" if name == "_id" else mapping.kind(name)
        if value is None:
            beyond = f"{column} IS NOT NULL" if descending else "false"
            same = f"{column} IS NULL"
        else:
            x = typed(value, "keyword" if kind == "text" else kind)
            beyond = f"coalesce({column} < {x}, false)" if descending else f"coalesce({column} > {x}, true)"
            same = f"coalesce({column} = {x}, false)"
        out = f"({out} OR ({equal} AND {beyond}))"
        equal = f"{equal} AND {same}"
    return F.expr(out)


def _cursor(request: dict, keys: list[tuple[str, bool]], df: DataFrame) -> list | None:
    given = request.get("search_after")
    if given is None:
        return None
    if not keys:
        raise IllegalArgument("[search_after] needs a sort")
    if not isinstance(given, list) or len(given) != len(keys):
        raise IllegalArgument("[search_after] has as many values as the sort has fields")
    if request.get("from", 0):
        raise IllegalArgument("[from] must be 0 with [search_after]")
    if any(name == "_score" for name, _ in keys):
        raise IllegalArgument("[search_after] can't continue by _score")
    if "knn" in request:
        raise IllegalArgument("[search_after] doesn't combine with [knn]")
    return given


def search(df: DataFrame, request: dict, mapping: Mapping) -> SearchResult:
    """Runs a request over an index's rows (with ``_id``)."""
    known = {"query", "size", "from", "sort", "search_after", "aggs", "aggregations", "knn"}
    if unknown := set(request) - known:
        raise ParsingError(f"unknown request fields {sorted(unknown)}")
    size, start = int(request.get("size", 10)), int(request.get("from", 0))
    if size < 0 or start < 0:
        raise IllegalArgument("[from] and [size] can't be negative")
    keys = sort_keys(request.get("sort", []))
    cursor = _cursor(request, keys, df)
    for name, _ in keys:
        if name not in ("_score", "_id") and name not in df.columns:
            raise IllegalArgument(f"can't sort by unknown field [{name}]")
    clause = translate(request.get("query"), mapping)
    matched = df.where(clause.column())
    found = aggregate(matched, request.get("aggs", request.get("aggregations", {})), mapping)
    if "knn" in request:
        hits = _vector_hits(df, request, clause, mapping, start + size)
        return SearchResult(hits.offset(start).limit(size) if start else hits.limit(size), matched, found)
    if keys and not any(name == "_score" for name, _ in keys):
        order = keys if any(n == "_id" for n, _ in keys) else [*keys, ("_id", False)]
        rows = matched if cursor is None else matched.where(after(keys, cursor, mapping))
        rows = rows.orderBy(*(null_last(F.col(ident(n)), d) for n, d in order))
        page = (rows.offset(start) if start else rows).limit(size)
        shown = F.array(*(F.col(ident(n)).cast("string") for n, _ in keys)).alias("sort")
        return SearchResult(page.select("*", F.lit(None).cast("double").alias("_score"), shown), matched, found, True)
    scored = bm25(df, clause, mapping)
    order = [null_last(F.col(ident(n)), d) for n, d in keys] or [F.desc("_score")]
    rows = scored.orderBy(*order, "_id")
    return SearchResult((rows.offset(start) if start else rows).limit(size), matched, found)


def _vector_hits(df: DataFrame, request: dict, clause: Clause, mapping: Mapping, need: int) -> DataFrame:
    name, spec = next(iter(request["knn"].items()))
    where = translate(spec["filter"], mapping).column() if "filter" in spec else None
    near = knn(df, name, spec["vector"], int(spec.get("k", 10)), where, spec.get("metric", "cosine"))
    if "query" not in request:
        return near.orderBy("_knn_distance", "_id")
    text = bm25(df, clause, mapping).orderBy(F.desc("_score"), "_id").limit(max(need, int(spec.get("k", 10))))
    fused = rrf(text, near)
    rows = df.join(fused.withColumnRenamed("_score", "_fused"), "_id")
    return rows.withColumnRenamed("_fused", "_score").orderBy(F.desc("_score"), "_id")


def count(df: DataFrame, request: dict | None, mapping: Mapping) -> DataFrame:
    """The number of matching rows, in one row."""
    return df.where(translate((request or {}).get("query"), mapping).column()).agg(F.count("*").alias("count"))
