"""Column expressions with the engine's semantics, as SQL text and as columns."""

from .exprs import (
    date_from_text,
    fuzzy_sql,
    ident,
    literal,
    null_last,
    round_half_away,
    safe_divide,
    tokens,
    tokens_sql,
    wildcard_regex,
)
from .query_string import ScoredTerm, parse_query_string

__all__ = [
    "ScoredTerm",
    "date_from_text",
    "fuzzy_sql",
    "ident",
    "literal",
    "null_last",
    "parse_query_string",
    "round_half_away",
    "safe_divide",
    "tokens",
    "tokens_sql",
    "wildcard_regex",
]
