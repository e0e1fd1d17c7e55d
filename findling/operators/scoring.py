"""BM25 relevance over a DataFrame.

Statistics are global. One aggregate finds the number of documents, the mean length and every term's
document frequency; its single row joins the scan that scores. Texts are never exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ScoredTerm, ident, literal, tokens_sql
from ..mapping import Mapping
from .clauses import Clause, body_sql

K1, B = 1.2, 0.75


def bm25(df: DataFrame, clause: Clause, mapping: Mapping, name: str = "_score") -> DataFrame:
    """The matching rows of ``df`` with their score; rows that match only unscored clauses have 0.0."""
    terms: dict[tuple[str, str], float] = {}
    for f, t, boost in clause.terms:
        terms[f, t] = terms.get((f, t), 0.0) + boost
    matched = F.expr(clause.sql)
    if not terms:
        return df.where(matched).withColumn(name, F.lit(float(clause.constant)))
    columns = {f: tokens_sql(body_sql(mapping) if f == "body" and mapping.kind("body") is None else ident(f)) for f, _ in terms}
    fields = list(columns)
    tokened = df.select("*", *(F.expr(columns[f]).alias(f"_tok{i}") for i, f in enumerate(fields)))
    stats = tokened.agg(
        *(F.count(f"_tok{i}").alias(f"_n{i}") for i in range(len(fields))),
        *(F.avg(F.size(f"_tok{i}")).alias(f"_avg{i}") for i in range(len(fields))),
        *(F.count_if(F.expr(f"array_contains(_tok{fields.index(f)}, {literal(t)})")).alias(f"_df{j}") for j, (f, t) in enumerate(terms)),
    )
    score = F.lit(float(clause.constant))
    for j, ((f, t), boost) in enumerate(terms.items()):
        i = fields.index(f)
        tf = F.expr(f"cast(size(filter(_tok{i}, _x -> _x = {literal(t)})) as double)")
        idf = F.log(1 + (F.col(f"_n{i}") - F.col(f"_df{j}") + 0.5) / (F.col(f"_df{j}") + 0.5))
        norm = K1 * (1 - B + B * F.size(f"_tok{i}") / F.col(f"_avg{i}"))
        score = score + F.coalesce(idf * boost * tf * (K1 + 1) / (tf + norm), F.lit(0.0))
    scored = tokened.where(matched).crossJoin(F.broadcast(stats))  # statistics are one row
    return scored.select(*(F.col(ident(c)) for c in df.columns), score.alias(name))


__all__ = ["ScoredTerm", "bm25"]
