"""Scalar semantics where Spark's defaults differ from the engine's.

Everything is built from Spark SQL text, so that the query DSL, the SQL front end and EXPLAIN share one
translation and Catalyst sees plain built-in expressions.
"""

from __future__ import annotations

import datetime
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analyser's limit on a token, in bytes.
MAX_TOKEN_BYTES = 40


def ident(name: str) -> str:
    """A column name as a quoted identifier."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if -(1 << 63) <= value < 1 << 63 else f"{value}BD"
    if isinstance(value, float):
        return f"double('{value}')" if math.isnan(value) or math.isinf(value) else f"{value!r}D"
    if isinstance(value, datetime.datetime):
        return f"timestamp '{value.isoformat(sep=' ')}'"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def tokens_sql(text: str) -> str:
    """The analyser: runs of letters and digits, lower-cased, none above 40 bytes; null for null text."""
    return f"filter(regexp_extract_all(lower({text}), r'([\\p{{L}}\\p{{N}}]+)', 1), _t -> octet_length(_t) <= {MAX_TOKEN_BYTES})"


def tokens(column: str) -> Column:
    return F.expr(tokens_sql(ident(column)))


def wildcard_regex(pattern: str) -> str:
    """``*`` and ``?`` as a regular expression of a whole term; all else stands for itself."""
    return "^(?s:" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + ")$"


def _swaps(word: str) -> list[str]:
    return sorted({word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)} - {word})


def fuzzy_sql(term: str, word: str, distance: int) -> str:
    """Whether ``term`` is within ``distance`` (0 to 2) edits of ``word``, a transposition being one edit.

    A transposition and one other edit may come in either order, so both words' swaps are tried.
    """
    if distance <= 0:
        return f"{term} = {literal(word)}"
    swaps = _swaps(word)
    tests = [f"levenshtein({term}, {literal(word)}) <= {distance}"]
    if swaps:
        tests.append(f"{term} IN ({', '.join(map(literal, swaps))})")
    if distance > 1:
        tests += [f"levenshtein({term}, {literal(s)}) <= 1" for s in swaps]
        twice = sorted({x for s in swaps for x in _swaps(s)} - {word, *swaps})
        if twice:
            tests.append(f"{term} IN ({', '.join(map(literal, twice))})")
        swapped = f"concat(substring({term}, 1, _i - 1), substring({term}, _i + 1, 1), substring({term}, _i, 1), substring({term}, _i + 2))"
        tests.append(f"(length({term}) > 1 AND exists(sequence(1, greatest(length({term}) - 1, 1)), _i -> levenshtein({swapped}, {literal(word)}) <= 1))")
    size = len(word)
    return f"(length({term}) BETWEEN {size - distance} AND {size + distance} AND ({' OR '.join(tests)}))"


def round_half_away(value: Column, digits: int = 0) -> Column:
    """Rounds a double half away from zero in binary, with no detour through decimals."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def safe_divide(a: Column, b: Column) -> Column:
    """Double division; division by zero is null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def null_last(column: Column, descending: bool = False) -> Column:
    """Null is the greatest value: last when ascending, first when descending."""
    return column.desc_nulls_first() if descending else column.asc_nulls_last()


DATE_TEXT = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})?)?$"


def date_from_text(text: Column) -> Column:
    """The date grammar: RFC 3339, ISO local time or a date as UTC, or epoch milliseconds; else null."""
    iso = F.when(text.rlike(DATE_TEXT), text.try_cast("timestamp"))
    return F.coalesce(iso, F.when(text.rlike(r"^-?\d+$"), F.timestamp_millis(text.try_cast("bigint"))))
