"""The query-string grammar of ``match`` and ``text_match``: words, phrases, AND, OR, NOT, + and -, groups,
``field:`` prefixes and ``^`` boosts. Words without an operator between them are alternatives."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from ..errors import ParsingError
from .exprs import MAX_TOKEN_BYTES, ident, literal, tokens_sql

#: field, token, boost
ScoredTerm = tuple[str, str, float]
#: What every match has: of each set at least one (field, token).
Needs = list[frozenset[tuple[str, str]]]

_LEX = re.compile(r'\s*(?:(?P<phrase>"(?:[^"\\]|\\.)*")|(?P<open>\()|(?P<close>\))|(?P<boost>\^\d+(?:\.\d+)?)|(?P<sign>[+-])(?=\S)|(?P<field>[A-Za-z_][\w.]*):(?=\S)|(?P<word>[^\s()"^]+))')


def analyse(text: str) -> list[str]:
    """Tokens of a query word, by the rules of the analyser."""
    found, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha() or c.isnumeric():
            word += c
        elif word:
            found.append(word)
            word = ""
    return [w for w in found if len(w.encode()) <= MAX_TOKEN_BYTES]


@dataclass
class _Node:
    sql: str
    terms: list[ScoredTerm]
    occur: str = ""  # "must", "not" or "" for an alternative
    needs: Needs = field(default_factory=list)


def combine(must: list[str], should: list[str], must_not: list[str]) -> str:
    """A boolean query's match: alternatives count only without required clauses; purely negative matches nothing."""
    if not must and not should:
        return "true" if not must_not else "false"
    positive = [f"({x})" for x in must] or ["(" + " OR ".join(f"({x})" for x in should) + ")"]
    return " AND ".join(positive + [f"NOT ({x})" for x in must_not])


def combined_needs(must: list[Needs], should: list[Needs]) -> Needs:
    """What a boolean query's matches have, from what those of its parts have."""
    if must:
        return [x for part in must for x in part]
    if not should or not all(should):
        return []
    if len(should) == 1:
        return should[0]
    return [frozenset().union(*(min(part, key=len) for part in should))]


def phrase_sql(field: str, words: list[str], is_text: bool) -> str:
    column = ident(field)
    if not is_text:
        return f"coalesce({column} = {literal(' '.join(words))}, false)"
    if not words:
        return "false"
    return f"coalesce({holds_words(column)(words)}, false)"


def holds_words(column: str) -> Callable[[list[str]], str]:
    """The test that the text of a column has given tokens one after the other.

    A token is a part of the lower-cased text, so a search for each part goes first and most texts are never cut into tokens;
    those that are, once for each test. Tokens have letters and digits only, so the space between them can't be part of one.
    """

    def test(words: list[str]) -> str:
        parts = " AND ".join(f"contains(lower({column}), {literal(w)})" for w in dict.fromkeys(words))
        if len(words) == 1:
            return f"({parts} AND array_contains({tokens_sql(column)}, {literal(words[0])}))"
        return f"({parts} AND contains(concat(' ', array_join({tokens_sql(column)}, ' '), ' '), {literal(' ' + ' '.join(words) + ' ')}))"

    return test


class _Parser:
    def __init__(self, text: str, field: str, is_text: Callable[[str], bool]):
        self.items: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            found = _LEX.match(text, at)
            if not found:
                raise ParsingError(f"cannot read the query at: {text[at:]!r}")
            self.items.append((found.lastgroup or "", found.group(found.lastgroup or 0)))
            at = found.end()
        self.at, self.field, self.is_text = 0, field, is_text

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self) -> tuple[str, str]:
        item = self.peek()
        self.at += 1
        return item

    def group(self, field: str, inner: bool) -> _Node:
        nodes: list[_Node] = []
        joins: list[str] = []
        while self.peek()[0] != "end" and not (inner and self.peek()[0] == "close"):
            join = ""
            while self.peek()[0] == "word" and self.peek()[1] in ("AND", "OR", "&&", "||"):
                join = "and" if self.take()[1] in ("AND", "&&") else "or"
            if self.peek()[0] == "end":
                raise ParsingError("an operator has nothing on its right")
            if join and not nodes:
                raise ParsingError("an operator has nothing on its left")
            node = self.clause(field)
            joins.append(join)
            nodes.append(node)
        for i, join in enumerate(joins):
            if join == "and":
                for x in (nodes[i - 1], nodes[i]):
                    x.occur = x.occur or "must"
        terms = [t for x in nodes if x.occur != "not" for t in x.terms]
        by = {k: [x.sql for x in nodes if x.occur == k] for k in ("must", "", "not")}
        needs = combined_needs([x.needs for x in nodes if x.occur == "must"], [x.needs for x in nodes if x.occur == ""])
        return _Node(combine(by["must"], by[""], by["not"]) if nodes else "false", terms, needs=needs)

    def clause(self, field: str) -> _Node:
        occur = ""
        while True:
            kind, value = self.peek()
            if kind == "sign":
                occur = "must" if value == "+" else "not"
            elif kind == "word" and value == "NOT":
                occur = "not"
            else:
                break
            self.take()
        kind, value = self.take()
        if kind == "field":
            field = value
            kind, value = self.take()
        if kind == "open":
            node = self.group(field, True)
            if self.take()[0] != "close":
                raise ParsingError("a parenthesis is not closed")
        elif kind == "phrase":
            inner = re.sub(r"\\(.)", r"\1", value[1:-1])
            node = self.leaf(field, inner)
        elif kind == "word":
            node = self.leaf(field, value)
        else:
            raise ParsingError(f"unexpected {value or 'end'!r} in the query")
        if self.peek()[0] == "boost":
            boost = float(self.take()[1][1:])
            node.terms = [(f, t, b * boost) for f, t, b in node.terms]
        node.occur = occur
        return node

    def leaf(self, field: str, text: str) -> _Node:
        if not self.is_text(field):
            return _Node(f"coalesce(cast({ident(field)} as string) = {literal(text)}, false)", [])
        words = analyse(text)
        return _Node(phrase_sql(field, words, True), [(field, w, 1.0) for w in words], needs=[frozenset([(field, w)]) for w in dict.fromkeys(words)])


def query_needs(text: str, field: str, is_text: Callable[[str], bool] = lambda _: True) -> Needs:
    """The tokens that every match of a query string has."""
    return _Parser(text, field, is_text).group(field, False).needs


def parse_query_string(text: str, field: str, is_text: Callable[[str], bool] = lambda _: True) -> tuple[str, list[ScoredTerm]]:
    """The match condition as SQL text, and the terms that score."""
    parser = _Parser(text, field, is_text)
    node = parser.group(field, False)
    if parser.peek()[0] != "end":
        raise ParsingError(f"unexpected {parser.peek()[1]!r} in the query")
    return node.sql, node.terms
