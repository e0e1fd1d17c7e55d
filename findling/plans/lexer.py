"""Tokens of SQL text, just enough to rewrite predicates and names before Catalyst parses it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParsingError

_LEX = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=>|<=|>=|<>|!=|==|\|\||::|[-+*/%(),.;<>=?:\[\]])""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind in ("word", "op") else ""

    @property
    def name(self) -> str:
        """An identifier's own spelling."""
        if self.kind == "quoted":
            q = self.text[0]
            return self.text[1:-1].replace(q * 2, q)
        return self.text

    @property
    def value(self) -> str:
        """A string's content; double quotes too."""
        q = self.text[0]
        return self.text[1:-1].replace(q * 2, q)


def lex(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        found = _LEX.match(sql, at)
        if not found:
            raise ParsingError(f"cannot read SQL at: {sql[at : at + 30]!r}")
        if found.lastgroup != "space":
            out.append(Token(found.lastgroup or "", found.group()))
        at = found.end()
    while out and out[-1].text == ";":
        out.pop()
    if any(t.text == ";" for t in out):
        raise ParsingError("only one statement is allowed")
    return out


def spell(tokens: list[Token]) -> str:
    """Text for Spark: identifiers in backquotes, strings with Spark's escapes."""
    parts = []
    for t in tokens:
        if t.kind == "quoted":
            parts.append("`" + t.name.replace("`", "``") + "`")
        elif t.kind == "string":
            parts.append("'" + t.value.replace("\\", "\\\\").replace("'", "\\'") + "'")
        else:
            parts.append(t.text)
    return " ".join(parts)


def depth_split(tokens: list[Token], word: str) -> list[list[Token]]:
    """Parts between the given word or comma outside parentheses and CASE; the AND of BETWEEN doesn't split."""
    out: list[list[Token]] = [[]]
    depth, between = 0, 0
    for t in tokens:
        if t.text in ("(", "[") or t.upper == "CASE":
            depth += 1
        elif t.text in (")", "]") or t.upper == "END":
            depth -= 1
        if depth == 0 and t.upper == "BETWEEN":
            between += 1
        if depth == 0 and t.upper == word:
            if word == "AND" and between:
                between -= 1
            else:
                out.append([])
                continue
        out[-1].append(t)
    return out


CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET")


def clauses(tokens: list[Token]) -> dict[str, list[Token]]:
    """The clauses of one SELECT by their first word."""
    out: dict[str, list[Token]] = {}
    depth, current = 0, ""
    for i, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")")
        word = t.upper
        within = word == "GROUP" and i + 1 < len(tokens) and tokens[i + 1].upper != "BY" or word == "FROM" and bool(out.get(current)) and out[current][-1].upper == "DISTINCT"  # IS DISTINCT FROM
        if depth == 0 and t.kind == "word" and word in CLAUSES and not within:
            current = word
            if current in out:
                raise ParsingError(f"{word} appears twice")
            out[current] = []
            continue
        if word == "BY" and current in ("GROUP", "ORDER") and not out[current]:
            continue
        if not current:
            raise ParsingError("a SELECT statement is needed")
        out[current].append(t)
    return out
