"""SQL over an index.

Catalyst parses, optimises and runs the statement. Before that a thin pass over its tokens gives it the
engine's semantics: ``text_match`` becomes a token condition; pushable predicates on text fields act on
tokens; names are matched to the mapping (exactly, or else by the only spelling that differs in case); nulls
sort as the greatest value; ROUND goes half away from zero; division by zero is null. ``_score`` is computed
only if the statement names it. Every SELECT block gets this, with the mappings of its own FROM: in CTEs, set operations,
derived tables, joins and subqueries, correlated ones too. A text column keeps its meaning as long as it is passed on as
it is (by name, alias or ``*``). Joins, windows and set operations themselves are Spark's own; in strict mode everything
but one uncorrelated semi-join is refused.
"""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import GroupByText, ParsingError, SqlFailed
from ..functions import ident, literal, parse_query_string, tokens_sql
from ..functions.query_string import query_needs
from ..mapping import Mapping
from ..operators.clauses import Clause, translate
from ..operators.scoring import bm25
from .lexer import Token, clauses, depth_split, lex, spell

_COMPARE = {"=": "=", "==": "=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_FLIP = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_JOINING = {"JOIN": "a join", "UNION": "a set operation", "INTERSECT": "a set operation", "EXCEPT": "a set operation", "WITH": "a CTE", "OVER": "a window"}
_SETS = ("UNION", "INTERSECT", "EXCEPT", "MINUS")
#: Words of a FROM that are no alias.
_FROM_WORDS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER", "CROSS", "SEMI", "ANTI", "NATURAL", "LATERAL", "ON", "USING", "TABLESAMPLE", "PIVOT", "UNPIVOT", "VIEW", "AS"}


@dataclass
class SqlPlan:
    """What was understood of a statement, and the text that Catalyst gets."""

    index: str
    text: str
    text_matches: list[tuple[str, str]] = field(default_factory=list)
    pushed: list[str] = field(default_factory=list)
    residual: list[str] = field(default_factory=list)
    group_by: list[str] = field(default_factory=list)
    scored: bool = False
    semijoin: bool = False
    count_only: bool = False
    terms: list = field(default_factory=list)
    needs: list = field(default_factory=list)
    uses: int = 0

    def facts(self) -> dict:
        """EXPLAIN's logical part."""
        stages = ["scan", *(["text_match"] if self.text_matches else []), *(["filter"] if self.pushed or self.residual else []), *(["score"] if self.scored else []), *(["semijoin"] if self.semijoin else []), *(["group"] if self.group_by else []), "project"]
        mode, reason = "scan", "columns of the matching rows are read and projected"
        if self.group_by:
            mode, reason = "grouped", "partial aggregates in each task, merged by group key"
        elif self.count_only:
            mode, reason = "count", "only the number of matching rows is asked for"
        return {
            "index": self.index,
            "execution_mode": mode,
            "execution_strategy": f"{mode} over {'scored' if self.scored else 'unscored'} matches",
            "strategy_reason": reason,
            "pushdown_summary": {"text_matches": len(self.text_matches), "filters": len(self.pushed), "residual": len(self.residual)},
            "approximate_top_k": False,
            "truncated": False,
            "text_matches": [{"field": f, "query": q} for f, q in self.text_matches],
            "pushed_down_filters": self.pushed,
            "has_residual_predicates": bool(self.residual),
            "group_by_columns": self.group_by,
            "semijoin": self.semijoin,
            "scored": self.scored,
            "pipeline": stages,
            "rewritten_sql": self.text,
        }


def _word(text: str) -> Token:
    return Token("op", text)


class _Compiler:
    def __init__(self, mapping_of: Callable[[str], Mapping], strict: bool):
        self.mapping_of, self.strict = mapping_of, strict

    # Names

    def column(self, t: Token) -> str | None:
        """The field that a token names, if any."""
        return self.mapping.resolve(t.name) if t.kind in ("word", "quoted") else None

    def canonical(self, tokens: list[Token], aliases: set[str]) -> list[Token]:
        out = []
        for i, t in enumerate(tokens):
            after = tokens[i + 1].text if i + 1 < len(tokens) else ""
            if t.kind in ("word", "quoted") and after != "(" and t.name not in aliases:
                own = self.mapping.resolve(t.name)
                if own is not None and (t.kind == "quoted" or own in self.mapping.fields or own in ("_id", "_score")):
                    out.append(Token("quoted", ident(own)))
                    continue
            if t.upper == "ROUND" and after == "(":
                t = Token("word", "findling_round")
            out.append(t)
        return out

    # Predicates

    def leaf(self, part: list[Token]) -> str | None:
        """A pushable comparison as SQL, with token semantics on text; None if it isn't one."""

        def value(ts: list[Token]) -> object:
            sign = 1
            if ts and ts[0].text == "-":
                sign, ts = -1, ts[1:]
            if len(ts) != 1:
                raise ValueError
            t = ts[0]
            if t.kind == "string" and sign == 1:
                return t.value
            if t.kind == "number":
                return sign * (float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
            if t.upper in ("TRUE", "FALSE"):
                return t.upper == "TRUE"
            raise ValueError

        try:
            names = [self.column(part[0]), self.column(part[-1])]
            if len(part) >= 3 and names[0] in self.mapping.fields and part[1].text in _COMPARE:
                return self.compare(names[0], _COMPARE[part[1].text], value(part[2:]))
            if len(part) >= 3 and names[1] in self.mapping.fields and part[-2].text in _COMPARE:
                return self.compare(names[1], _FLIP[_COMPARE[part[-2].text]], value(part[:-2]))
            if names[0] in self.mapping.fields and len(part) > 3 and part[1].upper == "BETWEEN":
                split = next(i for i, t in enumerate(part) if t.upper == "AND")
                lo, hi = value(part[2:split]), value(part[split + 1 :])
                return translate({"range": {names[0]: {"gte": lo, "lte": hi}}}, self.mapping).sql
            if names[0] in self.mapping.fields and len(part) > 4 and part[1].upper == "IN" and part[2].text == "(" and part[-1].text == ")":
                given = [value(x) for x in depth_split(part[3:-1], ",")]
                return "(" + " OR ".join(translate({"term": {names[0]: v}}, self.mapping).sql for v in given) + ")"
        except (ValueError, StopIteration, IndexError):
            return None
        return None

    def compare(self, name: str, op: str, value: object) -> str:
        if op == "=":
            return translate({"term": {name: value}}, self.mapping).sql
        return translate({"range": {name: {{">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[op]: value}}}, self.mapping).sql

    def pushable(self, part: list[Token]) -> str | None:
        """A comparison, or AND and OR of comparisons, all or nothing."""
        while part and part[0].text == "(" and part[-1].text == ")" and self.closes(part):
            part = part[1:-1]
        if not part:
            return None
        for word in ("OR", "AND"):
            some = depth_split(part, word)
            if len(some) > 1:
                each = [self.pushable(x) for x in some]
                return None if any(x is None for x in each) else "(" + f" {word} ".join(f"({x})" for x in each) + ")"
        return self.leaf(part)

    @staticmethod
    def closes(part: list[Token]) -> bool:
        """Whether the first parenthesis closes at the end."""
        depth = 0
        for i, t in enumerate(part):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0:
                return i == len(part) - 1
        return False

    def text_matches(self, tokens: list[Token], top: bool) -> list[Token]:
        """Replaces every text_match call by its condition."""
        out, i = [], 0
        while i < len(tokens):
            t = tokens[i]
            if t.upper == "TEXT_MATCH" and i + 1 < len(tokens) and tokens[i + 1].text == "(":
                args = tokens[i + 2 : i + 6]
                if len(args) < 4 or args[0].kind not in ("word", "quoted") or args[1].text != "," or args[2].kind not in ("string", "quoted") or args[3].text != ")":
                    raise ParsingError("text_match takes a field and a string")
                if self.strict and not (top and len(tokens) == 6):
                    raise ParsingError("text_match stands only in a top-level AND")
                name = self.column(args[0])
                if name is None:
                    raise ParsingError(f"text_match: unknown field [{args[0].name}]")
                if self.mapping.is_text(name):
                    sql, terms = parse_query_string(args[2].value, name, self.mapping.is_text)
                else:
                    sql, terms = f"coalesce(cast({ident(name)} as string) = {literal(args[2].value)}, false)", []
                self.plan.text_matches.append((name.rpartition(".")[2], args[2].value))
                self.plan.terms += [(f.rpartition(".")[2], t, b) for f, t, b in terms]
                out.append(_word(f"({sql})"))
                i += 6
            else:
                out.append(t)
                i += 1
        return out

    # Scopes

    def qualified(self, tokens: list[Token], names: set[str]) -> list[Token]:
        """``alias . column`` as one name, for the aliases of this block and those around it."""
        out, i = [], 0
        low = {n.lower() for n in names}
        while i < len(tokens):
            t = tokens[i]
            if t.kind in ("word", "quoted") and t.name.lower() in low and i + 2 < len(tokens) and tokens[i + 1].text == "." and tokens[i + 2].kind in ("word", "quoted"):
                out.append(Token("quoted", ident(f"{t.name}.{tokens[i + 2].name}")))
                i += 3
            else:
                out.append(t)
                i += 1
        return out

    def subquery(self, tokens: list[Token], i: int) -> int | None:
        """The place of the parenthesis that closes a subquery which opens at i."""
        if tokens[i].text != "(" or i + 1 >= len(tokens) or tokens[i + 1].upper not in ("SELECT", "WITH", "("):
            return None
        j = i + 1
        while tokens[j].text == "(" and j + 1 < len(tokens):
            j += 1
        if tokens[j].upper not in ("SELECT", "WITH"):
            return None
        depth = 0
        for j in range(i, len(tokens)):
            depth += (tokens[j].text == "(") - (tokens[j].text == ")")
            if depth == 0:
                return j
        raise ParsingError("a parenthesis is not closed")

    def sources(self, tokens: list[Token], env: dict[str, Mapping], outer: Mapping | None) -> tuple[list[str | list[Token]], dict[str, Mapping]]:
        """A FROM in pieces, conditions of joins still as tokens, and the mapping behind each alias."""
        pieces: list[str | list[Token]] = []
        found: dict[str, Mapping] = {}
        i, expected = 0, True
        while i < len(tokens):
            t = tokens[i]
            close = self.subquery(tokens, i) if expected else None
            if close is not None or expected and t.kind in ("word", "quoted") and t.upper not in _FROM_WORDS:
                if close is not None:
                    text, mapping = self.query(tokens[i + 1 : close], env, outer)
                    text, own, i = f"({text})", None, close + 1
                else:
                    own, i = t.name, i + 1
                    if own.lower() in env:
                        text, mapping = ident(own), env[own.lower()]
                    elif self.known(own) and (i >= len(tokens) or tokens[i].text not in ("(", ".")):
                        text, mapping = self.view_of(own), self.mapping_of(own)
                        self.plan.uses += own == self.plan.index
                    else:
                        text, mapping, own = spell([t]), Mapping(), None
                        while i < len(tokens) and tokens[i].text in (".", "("):  # a path or a table function
                            stop = i + 1 if tokens[i].text == "." else i + self.closing(tokens[i:])
                            text, i = f"{text} {spell(tokens[i : stop + 1])}", stop + 1
                if i < len(tokens) and tokens[i].upper == "AS":
                    i += 1
                if i < len(tokens) and tokens[i].kind in ("word", "quoted") and tokens[i].upper not in _FROM_WORDS:
                    own, i = tokens[i].name, i + 1
                if own is not None:
                    text = f"{text} AS {ident(own)}"
                    if i < len(tokens) and tokens[i].text == "(":  # names for the columns
                        mapping, stop = Mapping(), i + self.closing(tokens[i:])
                        text, i = f"{text} {spell(tokens[i : stop + 1])}", stop + 1
                pieces.append(text)
                found[own if own is not None else f"#{len(found)}"] = mapping
                expected = False
                continue
            if t.upper == "ON":
                stop, depth = i + 1, 0
                while stop < len(tokens) and not (depth == 0 and (tokens[stop].text == "," or tokens[stop].kind == "word" and tokens[stop].upper in _FROM_WORDS - {"ON", "AS"} and (stop + 1 >= len(tokens) or tokens[stop + 1].text != "("))):
                    depth += (tokens[stop].text == "(") - (tokens[stop].text == ")")
                    stop += 1
                pieces += ["ON", tokens[i + 1 : stop]]
                i = stop
                continue
            expected = t.text in (",", "(") or t.upper in ("JOIN", "LATERAL")
            pieces.append(spell([t]))
            i += 1
        return pieces, found

    @staticmethod
    def closing(tokens: list[Token]) -> int:
        """The place of the parenthesis that closes the first token."""
        depth = 0
        for i, t in enumerate(tokens):
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0:
                return i
        raise ParsingError("a parenthesis is not closed")

    @staticmethod
    def scope(found: dict[str, Mapping], outer: Mapping | None) -> Mapping:
        """Names of a block: columns, columns behind an alias, and what the blocks around it know."""
        fields: dict[str, str] = {}
        for alias, mapping in found.items():
            for name, kind in mapping.fields.items():
                if "." not in name or name in mapping.dimensions:
                    fields.setdefault(name, kind)
                    if not alias.startswith("#"):
                        fields[f"{alias}.{name}"] = kind
        for name, kind in (outer.fields if outer else {}).items():
            fields.setdefault(name, kind)
        return Mapping(fields)

    def passed_on(self, items: list[Token], found: dict[str, Mapping]) -> Mapping:
        """The mapping of a block's result: the columns that it passes on as they are."""
        out: dict[str, str] = {}
        for part in depth_split(items, ","):
            if part and part[0].upper in ("DISTINCT", "ALL"):
                part = part[1:]
            if not part:
                continue
            if part[-1].text == "*" and len(part) in (1, 3):
                for alias, mapping in found.items():
                    if len(part) == 1 or alias.lower() == part[0].name.lower():
                        out.update({n: k for n, k in mapping.fields.items() if n not in out})
                continue
            name = self.column(part[0])
            kind = self.mapping.fields.get(name or "")
            if kind and (len(part) == 1 or len(part) == 2 or len(part) == 3 and part[1].upper == "AS") and all(t.kind in ("word", "quoted") for t in part):
                out[part[-1].name.rpartition(".")[2] if len(part) == 1 else part[-1].name] = kind
        return Mapping(out)

    # Statements

    def query(self, tokens: list[Token], env: dict[str, Mapping], outer: Mapping | None = None, top: bool = False) -> tuple[str, Mapping]:
        """A query expression (CTEs, set operations, parentheses, one SELECT) as text, and the mapping of its result."""
        head = ""
        if tokens and tokens[0].upper == "WITH":
            env, i, parts = dict(env), 1, []
            recursive = len(tokens) > 1 and tokens[1].upper == "RECURSIVE"
            i += recursive
            while True:
                if i + 2 >= len(tokens):
                    raise ParsingError("a CTE has no query")
                name, i, names = tokens[i], i + 1, ""
                if tokens[i].text == "(":
                    stop = i + self.closing(tokens[i:])
                    names, i = " " + spell(tokens[i : stop + 1]), stop + 1
                if tokens[i].upper != "AS" or tokens[i + 1].text != "(":
                    raise ParsingError("a CTE needs AS and a query in parentheses")
                stop = i + 1 + self.closing(tokens[i + 1 :])
                if recursive:
                    env[name.name.lower()] = Mapping()
                text, mapping = self.query(tokens[i + 2 : stop], env, outer)
                env[name.name.lower()] = Mapping() if names else mapping
                parts.append(f"{ident(name.name)}{names} AS ({text})")
                i = stop + 1
                if i < len(tokens) and tokens[i].text == ",":
                    i += 1
                    continue
                break
            head = f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} "
            tokens = tokens[i:]
        branches, words = self.branches(tokens)
        if len(branches) == 1:
            only = branches[0]
            if only and only[0].text == "(" and self.closes(only):
                text, mapping = self.query(only[1:-1], env, outer, top)
                return f"{head}({text})", mapping
            text, mapping = self.select(only, env, outer, top)
            return head + text, mapping
        last, depth, cut = branches[-1], 0, len(branches[-1])
        for i, t in enumerate(last):  # ORDER BY, LIMIT and OFFSET are those of the whole
            depth += (t.text == "(") - (t.text == ")")
            if depth == 0 and t.kind == "word" and t.upper in ("ORDER", "LIMIT", "OFFSET"):
                cut = i
                break
        branches[-1], tail = last[:cut], last[cut:]
        made = [self.query(x, env, outer) for x in branches]
        text = made[0][0]
        for word, (other, _) in zip(words, made[1:], strict=True):
            text += f" {word} {other}"
        was, self.mapping = self.mapping, self.scope({"#": made[0][1]}, None)
        try:
            text += self.tail(clauses([Token("word", "SELECT"), Token("op", "*"), *tail]), set())
        finally:
            self.mapping = was
        return head + text, made[0][1]

    @staticmethod
    def branches(tokens: list[Token]) -> tuple[list[list[Token]], list[str]]:
        """The sides of set operations and the words between them."""
        out: list[list[Token]] = [[]]
        words: list[str] = []
        depth, i = 0, 0
        while i < len(tokens):
            t = tokens[i]
            depth += (t.text == "(") - (t.text == ")")
            follows = tokens[i + 1].upper if i + 1 < len(tokens) else ""
            beyond = next((x.upper for x in tokens[i + 1 :] if x.text != "("), "")
            if depth == 0 and t.kind == "word" and t.upper in _SETS and (follows in ("ALL", "DISTINCT") or beyond in ("SELECT", "WITH")):
                words.append(t.upper + (f" {follows}" if follows in ("ALL", "DISTINCT") else ""))
                i += 1 + (follows in ("ALL", "DISTINCT"))
                out.append([])
                continue
            out[-1].append(t)
            i += 1
        return out, words

    def select(self, tokens: list[Token], env: dict[str, Mapping], outer: Mapping | None, top: bool) -> tuple[str, Mapping]:
        part = clauses(tokens)
        source = part.get("FROM")
        if "SELECT" not in part or not source and outer is None:
            raise ParsingError("a SELECT with a FROM is needed")
        pieces, found = self.sources(source or [], env, outer)
        was, self.mapping = self.mapping, self.scope(found, outer)
        try:
            names = {a for a in found if not a.startswith("#")} | {n.partition(".")[0] for n in self.mapping.fields if "." in n}
            part = {k: self.qualified(v, names) for k, v in part.items()}
            text = self.block(part, pieces, names, env, top)
            passed = self.passed_on(part["SELECT"], found)
            for name in sorted((n for n in self.mapping.fields if "." in n and n.partition(".")[0] in names), key=len, reverse=True):
                alias, _, column = name.partition(".")
                text = text.replace(ident(name), f"{ident(alias)}.{ident(column)}")
            for alias in names:  # what no mapping knows, as _id
                text = re.sub(re.escape(f"`{alias}.") + "([^`]+)`", lambda m, alias=alias: f"{ident(alias)}.`{m.group(1)}`", text, flags=re.I)
            return text, passed
        finally:
            self.mapping = was

    def condition(self, tokens: list[Token], aliases: set[str], env: dict[str, Mapping], top: bool, where: bool) -> str:
        """A WHERE or ON, part by part."""
        conditions = []
        for some in depth_split(tokens, "AND"):
            if any(t.upper == "SELECT" for t in some):
                if self.strict and (not top or self.plan.semijoin or not self.semijoin(some)):
                    raise ParsingError("strict mode allows one uncorrelated IN (SELECT ...) on a bare column")
                self.plan.semijoin = True
                conditions.append(f"({self.nested(some, aliases, env)})")
                continue
            pushed = self.pushable(some)
            if pushed is not None:
                self.plan.pushed.append(spell(some))
                conditions.append(f"({pushed})")
                continue
            done = self.text_matches(some, True)
            if where and top and len(done) == 1 and some[0].upper == "TEXT_MATCH" and self.mapping.is_text(self.column(some[2]) or ""):
                self.plan.needs += query_needs(some[4].value, (self.column(some[2]) or "").rpartition(".")[2], self.mapping.is_text)
            if where and not (len(done) == 1 and len(some) == 6 and some[0].upper == "TEXT_MATCH"):
                self.plan.residual.append(spell(some))
            conditions.append(f"({self.nested(done, aliases, env)})")
        return " AND ".join(conditions)

    def block(self, part: dict[str, list[Token]], pieces: list[str | list[Token]], names: set[str], env: dict[str, Mapping], top: bool) -> str:
        aliases = {part["SELECT"][i + 1].name for i, t in enumerate(part["SELECT"][:-1]) if t.upper == "AS"}
        aliases -= set(self.mapping.fields)
        if top:
            seen = [part["SELECT"][i + 1].name.lower() for i, t in enumerate(part["SELECT"][:-1]) if t.upper == "AS"]
            if len(seen) != len(set(seen)) and "GROUP" in part:
                raise ParsingError("ambiguous column reference: an output name appears twice")
        body = ["SELECT", self.nested(part["SELECT"], aliases, env)]
        if pieces:
            body += ["FROM", *(x if isinstance(x, str) else self.condition(self.qualified(x, names), aliases, env, top, False) for x in pieces)]
        if "WHERE" in part:
            body += ["WHERE", self.condition(part["WHERE"], aliases, env, top, True)]
        if "GROUP" in part:
            if top:
                self.plan.group_by = [spell(x) for x in depth_split(part["GROUP"], ",")]
            for x in depth_split(part["GROUP"], ","):
                name = self.column(x[0]) if len(x) == 1 else None
                if name and self.strict and self.mapping.is_text(name):
                    raise GroupByText(f"can't group by text field [{name}]")
            body += ["GROUP BY", self.nested(part["GROUP"], aliases, env)]
        if "HAVING" in part:
            body += ["HAVING", self.nested(part["HAVING"], aliases, env)]
        return " ".join(body) + self.tail(part, aliases, env)

    def tail(self, part: dict[str, list[Token]], aliases: set[str], env: dict[str, Mapping] | None = None) -> str:
        """ORDER BY, LIMIT and OFFSET."""
        body = []
        if "ORDER" in part:
            body += ["ORDER BY", ", ".join(self.order(x, aliases, env or {}) for x in depth_split(part["ORDER"], ","))]
        if "LIMIT" in part:
            given = depth_split(part["LIMIT"], ",")
            if len(given) == 2:
                body += ["LIMIT", spell(given[1]), "OFFSET", spell(given[0])]
            else:
                body += ["LIMIT", spell(given[0])]
        if "OFFSET" in part:
            body += ["OFFSET", spell([t for t in part["OFFSET"] if t.upper not in ("ROW", "ROWS")])]
        return "".join(f" {x}" for x in body)

    def semijoin(self, part: list[Token]) -> bool:
        return len(part) > 4 and self.column(part[0]) is not None and part[1].upper == "IN" and part[2].text == "(" and part[3].upper == "SELECT" and part[-1].text == ")"

    def order(self, part: list[Token], aliases: set[str], env: dict[str, Mapping]) -> str:
        text = self.nested(part, aliases, env)
        if "NULLS" in {t.upper for t in part}:
            return text
        return f"{text} NULLS {'FIRST' if part[-1].upper == 'DESC' else 'LAST'}"

    def nested(self, tokens: list[Token], aliases: set[str], env: dict[str, Mapping]) -> str:
        """Text of a part, its subqueries compiled as blocks of their own that also see this one's names."""
        out: list[Token] = []
        tokens = self.text_matches(tokens, False)
        i = 0
        while i < len(tokens):
            close = self.subquery(tokens, i)
            if close is not None:
                out.append(_word(f"({self.query(tokens[i + 1 : close], env, self.mapping)[0]})"))
                i = close + 1
            elif tokens[i].upper == "OVER" and i + 1 < len(tokens) and tokens[i + 1].text == "(":
                close = i + 1 + self.closing(tokens[i + 1 :])
                out += [tokens[i], _word(f"({self.window(tokens[i + 2 : close], aliases, env)})")]
                i = close + 1
            else:
                out.append(tokens[i])
                i += 1
        return spell(self.canonical(out, aliases))

    def window(self, tokens: list[Token], aliases: set[str], env: dict[str, Mapping]) -> str:
        """A window's definition; its order has the engine's nulls too."""
        at = next((i for i, t in enumerate(tokens) if t.upper == "ORDER"), None)
        if at is None:
            return self.nested(tokens, aliases, env)
        frame = next((i for i in range(at, len(tokens)) if tokens[i].upper in ("ROWS", "RANGE")), len(tokens))
        order = ", ".join(self.order(x, aliases, env) for x in depth_split(tokens[at + 2 : frame], ","))
        return f"{self.nested(tokens[:at], aliases, env)} ORDER BY {order} {spell(tokens[frame:])}"

    def compile(self, sql: str, view_of: Callable[[str], str], known: Callable[[str], bool]) -> SqlPlan:
        tokens = lex(sql)
        if not tokens:
            raise ParsingError("an empty statement")
        self.view_of, self.known = view_of, known
        if self.strict:
            for t in tokens:
                if t.kind == "word" and t.upper in _JOINING:
                    raise ParsingError(f"strict mode doesn't allow {_JOINING[t.upper]}")
        tokens = self.hyphenated(tokens)
        ctes = {tokens[i - 1].name.lower() for i, t in enumerate(tokens[:-1]) if i and t.upper == "AS" and tokens[i + 1].text == "("}
        named = [tokens[i + 1].name for i, t in enumerate(tokens[:-1]) if t.upper in ("FROM", "JOIN") and tokens[i + 1].kind in ("word", "quoted")]
        index = next((n for n in named if n.lower() not in ctes), None)
        if index is None:
            raise ParsingError("a SELECT with a FROM is needed")
        self.mapping = self.mapping_of(index)
        self.plan = SqlPlan(index, "", scored=any(t.name == "_score" for t in tokens if t.kind in ("word", "quoted")))
        view_of(index)
        if tokens[0].upper == "SELECT" and len(self.branches(tokens)[0]) == 1:
            try:
                whole = clauses(tokens)
                if self.strict:
                    if len(whole["FROM"]) != 1:
                        raise ParsingError("strict mode takes one index in FROM")
                    for key in ("SELECT", "HAVING", "ORDER"):
                        if any(t.upper == "SELECT" for t in whole.get(key, [])):
                            raise ParsingError("strict mode doesn't allow a scalar subquery")
                    if any(t.upper == "EXISTS" for t in tokens):
                        raise ParsingError("strict mode doesn't allow EXISTS")
            except KeyError as e:
                raise ParsingError("a SELECT with a FROM is needed") from e
            self.plan.count_only = [t.upper for t in whole["SELECT"][:4]] == ["COUNT", "(", "*", ")"] and len(depth_split(whole["SELECT"], ",")) == 1 and "GROUP" not in whole
        self.plan.text = self.query(tokens, {}, None, True)[0]
        return self.plan

    @staticmethod
    def hyphenated(tokens: list[Token]) -> list[Token]:
        """An index named with unquoted hyphens after FROM or JOIN is one name."""
        out, i = [], 0
        while i < len(tokens):
            t = tokens[i]
            out.append(t)
            i += 1
            if t.upper in ("FROM", "JOIN") and i < len(tokens) and tokens[i].kind == "word":
                name, end = tokens[i].name, i + 1
                while end + 1 < len(tokens) and tokens[end].text == "-" and tokens[end + 1].kind == "word":
                    name, end = f"{name}-{tokens[end + 1].text}", end + 2
                out.append(Token("quoted", ident(name)) if end > i + 1 else tokens[i])
                i = end
        return out


def compile_sql(sql: str, mapping_of: Callable[[str], Mapping], strict: bool = False, view_of: Callable[[str], str] = ident, known: Callable[[str], bool] = lambda _: True) -> SqlPlan:
    return _Compiler(mapping_of, strict).compile(sql, view_of, known)


ROUND = "CREATE OR REPLACE TEMPORARY FUNCTION findling_round(x DOUBLE, n INT DEFAULT 0) RETURNS DOUBLE RETURN signum(x) * floor(abs(x) * pow(10, n) + 0.5) / pow(10, n)"


#: One analysis at a time, since it switches a setting of the session.
_ANALYSIS = threading.Lock()


def run_sql(spark: SparkSession, sql: str, frame_of: Callable[[str, list], DataFrame], mapping_of: Callable[[str], Mapping], strict: bool = False, known: Callable[[str], bool] = lambda _: True) -> tuple[DataFrame, SqlPlan]:
    """The statement's DataFrame (lazy) and plan facts. The views that analysis needs are gone when it returns."""
    views: dict[str, str] = {}

    def view_of(name: str) -> str:
        return views.setdefault(name, f"findling_{uuid.uuid4().hex}")

    plan = compile_sql(sql, mapping_of, strict, view_of, known)
    for name, view in views.items():
        once = name == plan.index and plan.uses == 1 and not plan.scored  # scores count the whole table
        frame = frame_of(name, plan.needs if once else [])
        if plan.scored and name == plan.index:
            frame = bm25(frame, Clause("true", plan.terms), mapping_of(name))
        frame.createOrReplaceTempView(view)
    with _ANALYSIS:
        was = spark.conf.get("spark.sql.ansi.enabled")
        try:
            spark.conf.set("spark.sql.ansi.enabled", "false")  # x / 0 is null; expressions keep the mode they were analysed in
            spark.sql(ROUND)
            return spark.sql(plan.text), plan
        except ParsingError:
            raise
        except Exception as e:
            raise SqlFailed(str(e)) from e
        finally:
            spark.conf.set("spark.sql.ansi.enabled", was)
            for view in views.values():  # the analysed plan holds what the view stood for
                spark.catalog.dropTempView(view)


__all__ = ["F", "SqlPlan", "compile_sql", "run_sql", "tokens_sql"]
