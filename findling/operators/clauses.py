"""The JSON query DSL as one SQL condition.

On ``text`` fields term-level clauses look at tokens, on all others at the value. A missing value never
satisfies a clause. Literals take the field's type.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParsingError
from ..functions import ScoredTerm, date_from_text, fuzzy_sql, ident, literal, parse_query_string, tokens_sql, wildcard_regex
from ..functions.query_string import Needs, combine, combined_needs, holds_words, query_needs
from ..mapping import Mapping


@dataclass
class Clause:
    """A condition (never null) and the terms that score a match; ``constant`` counts matches of other scored clauses.

    ``needs`` says what tokens every match has, for indices that know where tokens are.
    """

    sql: str
    terms: list[ScoredTerm] = field(default_factory=list)
    constant: float = 0.0
    needs: Needs = field(default_factory=list)

    def column(self) -> Column:
        return F.expr(self.sql)


def typed(value: object, kind: str | None) -> str:
    """A literal of the field's type, whatever the type of the given value."""
    if value is None:
        return "NULL"
    if kind == "date":
        if isinstance(value, int | float) and not isinstance(value, bool):
            return f"timestamp_millis({int(value)}L)"
        text = literal(str(value))
        return f"coalesce(try_cast({text} AS timestamp), timestamp_millis(try_cast({text} AS bigint)))"
    if kind in ("integer", "float"):
        if isinstance(value, bool):
            return "NULL"
        return literal(value) if isinstance(value, int | float) else f"try_cast({literal(str(value))} AS {'bigint' if kind == 'integer' else 'double'})"
    if kind == "boolean":
        return f"try_cast({literal(str(value).lower())} AS boolean)"
    if isinstance(value, bool):
        return literal("true" if value else "false")
    return literal(value if isinstance(value, str) else str(value))


def _one(body: object, what: str) -> tuple[str, object] | None:
    """The first entry of a clause's map; None for an empty map."""
    if not isinstance(body, dict):
        raise ParsingError(f"[{what}] needs an object")
    return next(iter(body.items()), None)


def body_sql(mapping: Mapping) -> str:
    """The catch-all: the text of all scalar fields, space-joined."""
    parts = [f"cast({ident(n)} as string)" for n, k in mapping.fields.items() if k != "knn_vector"]
    return f"concat_ws(' ', {', '.join(parts)})" if parts else "''"


class _Translator:
    def __init__(self, mapping: Mapping):
        self.mapping = mapping

    def value(self, name: str) -> tuple[str, str, bool]:
        """Column text, kind and whether it is analysed; unknown fields are the catch-all."""
        kind = self.mapping.kind(name)
        if name == "_id":
            return ident("_id"), "keyword", False
        if kind is None:
            return body_sql(self.mapping), "text", True
        return ident(name), kind, kind == "text"

    def each(self, name: str, test: str, part: str = "") -> str:
        """``test`` (over {x}) of the value, or of any token; each token that passes has ``part``, which is looked for first."""
        column, kind, is_text = self.value(name)
        if is_text:
            first = f"contains(lower({column}), {literal(part)}) AND " if part else ""
            return f"coalesce({first}exists({tokens_sql(column)}, _t -> {test.replace('{x}', '_t')}), false)"
        return f"coalesce({test.replace('{x}', f'cast({column} as string)' if kind != 'keyword' else column)}, false)"

    def clause(self, body: dict) -> Clause:
        found = _one(body, "query")
        if found is None:
            return Clause("true", constant=1.0)
        name, inner = found
        handler = getattr(self, f"_{name}", None)
        if handler is None:
            raise ParsingError(f"unknown query clause [{name}]")
        return handler(inner)

    def _match_all(self, body: object) -> Clause:
        return Clause("true", constant=1.0)

    def _match_none(self, body: object) -> Clause:
        return Clause("false")

    def _match(self, body: object) -> Clause:
        found = _one(body, "match")
        if found is None:
            return Clause("true", constant=1.0)
        name, value = found
        value = value.get("query", "") if isinstance(value, dict) else value
        column, kind, is_text = self.value(name)
        if not is_text:
            return self._term({name: value})
        if self.mapping.kind(name) is None:
            sql, terms = parse_query_string(str(value), "body", lambda f: f == "body" or self.mapping.is_text(f))
            return Clause(sql.replace(ident("body"), column), [(f, t, b) for f, t, b in terms])
        return Clause(*parse_query_string(str(value), name, self.mapping.is_text), needs=query_needs(str(value), name, self.mapping.is_text))

    def _term(self, body: object) -> Clause:
        found = _one(body, "term")
        if found is None:
            return Clause("true", constant=1.0)
        name, value = found
        value = value.get("value") if isinstance(value, dict) else value
        column, kind, is_text = self.value(name)
        if is_text:
            text = ("true" if value else "false") if isinstance(value, bool) else str(value)
            return Clause(f"coalesce({holds_words(column)([text])}, false)", [(name if self.mapping.kind(name) else "body", text, 1.0)], needs=[frozenset([(name, text)])] if self.mapping.kind(name) else [])
        return Clause(f"coalesce({column} = {typed(value, kind)}, false)", constant=1.0)

    def _terms(self, body: object) -> Clause:
        found = _one(body, "terms")
        if found is None:
            return Clause("true", constant=1.0)
        name, values = found
        return Clause(" OR ".join(self._term({name: v}).sql for v in values) if values else "false", constant=1.0)

    def _range(self, body: object) -> Clause:
        found = _one(body, "range")
        if found is None:
            return Clause("true", constant=1.0)
        name, spec = found
        column, kind, is_text = self.value(name)
        lower = next(((op, spec[k]) for k, op in (("gt", ">"), ("gte", ">=")) if k in spec), None)
        upper = next(((op, spec[k]) for k, op in (("lt", "<"), ("lte", "<=")) if k in spec), None)
        tests = [f"{{x}} {op} {typed(v, kind)}" for op, v in filter(None, (lower, upper))]
        if not tests:
            return Clause(f"{column} IS NOT NULL", constant=1.0)
        if is_text:
            return Clause(self.each(name, " AND ".join(tests)), constant=1.0)
        return Clause(f"coalesce({' AND '.join(tests).replace('{x}', column)}, false)", constant=1.0)

    def _text(self, body: object, what: str) -> tuple[str, str] | None:
        found = _one(body, what)
        if found is None:
            return None
        name, value = found
        return name, str(value.get("value", "") if isinstance(value, dict) else value)

    def _wildcard(self, body: object) -> Clause:
        found = self._text(body, "wildcard")
        return Clause("true", constant=1.0) if found is None else Clause(self.each(found[0], f"{{x}} RLIKE {literal(wildcard_regex(found[1]))}", max(re.split(r"[*?]", found[1]), key=len)), constant=1.0)

    def _prefix(self, body: object) -> Clause:
        found = self._text(body, "prefix")
        return Clause("true", constant=1.0) if found is None else Clause(self.each(found[0], f"startswith({{x}}, {literal(found[1])})", found[1]), constant=1.0)

    def _fuzzy(self, body: object) -> Clause:
        found = _one(body, "fuzzy")
        if found is None:
            return Clause("true", constant=1.0)
        name, spec = found
        spec = spec if isinstance(spec, dict) else {"value": spec}
        distance = int(spec.get("fuzziness", 1))
        if not 0 <= distance <= 2:
            raise ParsingError("[fuzziness] is 0, 1 or 2")
        return Clause(self.each(name, fuzzy_sql("{x}", str(spec.get("value", "")), distance)), constant=1.0)

    def _bool(self, body: object) -> Clause:
        if not isinstance(body, dict):
            raise ParsingError("[bool] needs an object")
        part = {}
        for key in ("must", "filter", "should", "must_not"):
            given = body.get(key, [])
            part[key] = [self.clause(x) for x in (given if isinstance(given, list) else [given])]
        if unknown := set(body) - set(part) - {"minimum_should_match", "boost"}:
            raise ParsingError(f"[bool] knows no {sorted(unknown)}")
        required = [x.sql for x in part["must"] + part["filter"]]
        sql = combine(required, [x.sql for x in part["should"]], [x.sql for x in part["must_not"]])
        scored = part["must"] + part["should"]  # a filter decides, but doesn't score
        needs = combined_needs([x.needs for x in part["must"] + part["filter"]], [x.needs for x in part["should"]])
        return Clause(sql, [t for x in scored for t in x.terms], sum(x.constant for x in part["must"]), needs)


def translate(query: dict | None, mapping: Mapping) -> Clause:
    """A DSL query as a clause; no query matches all."""
    return _Translator(mapping).clause(query if query is not None else {"match_all": {}})


__all__ = ["Clause", "body_sql", "date_from_text", "translate", "typed"]
