"""The query language: text to a tree.

``a b`` (AND by default), ``OR``, ``NOT``, ``+`` (a filter), ``-``; ``field:...``; ``"phrase"``, ``"..."~n`` in order within n,
``"..."~-n`` in any order; ``wild*c?rd``, ``fuzzy~1:prefix:transpositions``, ``/regex/``, ``[a TO b]`` and ``{a TO b}``; ``x^n``,
where ``^0`` only constrains; ``field|infl_xx:word`` for the forms of a word; ``<LEVEL§query§TARGET>`` for a query at another
level or on another field, nested to any depth.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class MatchAll(Node):
    pass


@dataclass(frozen=True)
class Term(Node):
    field: str | None
    text: str


@dataclass(frozen=True)
class Wildcard(Node):
    field: str | None
    pattern: str


@dataclass(frozen=True)
class Fuzzy(Node):
    field: str | None
    text: str
    edits: int = 2
    prefix: int = 0
    transpositions: bool = True


@dataclass(frozen=True)
class Regex(Node):
    field: str | None
    pattern: str


@dataclass(frozen=True)
class Range(Node):
    field: str | None
    low: str | None
    high: str | None
    with_low: bool
    with_high: bool


@dataclass(frozen=True)
class Phrase(Node):
    field: str | None
    slots: tuple[tuple[Node, ...], ...]
    slop: int = 0
    ordered: bool = True


@dataclass(frozen=True)
class Inflected(Node):
    field: str | None
    language: str
    word: str
    prefix: str = ""
    suffix: str = ""


@dataclass(frozen=True)
class Sub(Node):
    level: str
    query: Node
    target: str


@dataclass(frozen=True)
class Boost(Node):
    node: Node
    by: float


@dataclass(frozen=True)
class Clause:
    occur: str  # MUST, SHOULD, NOT, FILTER
    node: Node


@dataclass(frozen=True)
class Bool(Node):
    clauses: tuple[Clause, ...]


_SPECIAL = set(' \t\n()"[]{}<>^:')


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def error(self, what: str) -> QueryError:
        return QueryError(f"{what} at {self.at} in {self.text!r}")

    def blank(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def peek(self, s: str) -> bool:
        return self.text.startswith(s, self.at)

    def take(self, s: str) -> bool:
        if self.peek(s):
            self.at += len(s)
            return True
        return False

    def word(self, *options: str) -> str | None:
        for o in options:
            end = self.at + len(o)
            if self.peek(o) and (end >= len(self.text) or self.text[end] in ' \t\n("<' or not o.isalpha()):
                self.at = end
                return o
        return None

    def query(self, field: str | None, close: str = "") -> Node:
        clauses: list[Clause] = []
        joined = None
        while True:
            self.blank()
            if self.at >= len(self.text) or (close and self.peek(close)):
                break
            if w := self.word("AND", "&&", "OR", "||"):
                joined = "AND" if w in ("AND", "&&") else "OR"
                continue
            occur = "MUST"
            if self.word("NOT", "!"):
                occur = "NOT"
                self.blank()
            elif self.take("-"):
                occur = "NOT"
            elif self.take("+"):
                occur = "FILTER"
            node = self.clause(field)
            if joined == "OR":
                if clauses and clauses[-1].occur == "MUST":
                    clauses[-1] = Clause("SHOULD", clauses[-1].node)
                occur = "SHOULD" if occur == "MUST" else occur
            joined = None
            clauses.append(Clause(occur, node))
        if not clauses:
            return MatchAll()
        if len(clauses) == 1 and clauses[0].occur in ("MUST", "SHOULD"):
            return clauses[0].node
        return Bool(tuple(clauses))

    def clause(self, field: str | None) -> Node:
        if self.take("("):
            node = self.query(field, ")")
            if not self.take(")"):
                raise self.error("no closing parenthesis")
            return self.boosted(node)
        if self.peek("<"):
            return self.boosted(self.sub())
        m = re.compile(r"([\w.|]+):(?=\S)").match(self.text, self.at)
        if m and not self.peek("*:"):
            self.at = m.end()
            return self.clause_in(m.group(1))
        return self.clause_in(field)

    def clause_in(self, field: str | None) -> Node:
        name, _, kind = (field or "").partition("|")
        own = name or None
        if self.peek("("):
            return self.clause(field)
        if self.take('"'):
            return self.phrase(own)
        if self.take("/"):
            m = re.compile(r"(?:[^/\\]|\\.)*").match(self.text, self.at)
            self.at = m.end()
            if not self.take("/"):
                raise self.error("no end of the expression")
            return self.boosted(Regex(own, m.group().replace("\\/", "/")))
        if self.peek("[") or self.peek("{"):
            return self.range(own)
        text = self.raw()
        if not text:
            raise self.error("nothing to search")
        if kind.startswith("infl_"):
            language, *affixes = kind[5:].split("_")
            prefix, suffix = ("", "") if not affixes else ("", affixes[0]) if len(affixes) == 1 else (affixes[0], affixes[1])
            return self.boosted(Inflected(own, language, text, prefix, suffix))
        return self.boosted(leaf(own, text))

    def raw(self) -> str:
        begin, out = self.at, []
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\" and self.at + 1 < len(self.text):
                out.append(c + self.text[self.at + 1])
                self.at += 2
            elif c == ":" and self.at > begin and "~" in "".join(out):
                out.append(c)
                self.at += 1
            elif c in _SPECIAL:
                break
            else:
                out.append(c)
                self.at += 1
        return "".join(out)

    def boosted(self, node: Node) -> Node:
        if self.take("^"):
            m = re.compile(r"\d+(?:\.\d+)?").match(self.text, self.at)
            if not m:
                raise self.error("no boost")
            self.at = m.end()
            return Boost(node, float(m.group()))
        return node

    def phrase(self, field: str | None) -> Node:
        slots: list[tuple[Node, ...]] = []
        while True:
            self.blank()
            if self.take('"'):
                break
            if self.at >= len(self.text):
                raise self.error("no end of the phrase")
            if self.take("("):
                options: list[Node] = []
                while not self.take(")"):
                    self.blank()
                    if self.at >= len(self.text):
                        raise self.error("no closing parenthesis")
                    if not self.word("OR", "||") and (w := self.inner()):
                        options.append(leaf(field, w))
                    self.blank()
                slots.append(tuple(options))
            elif w := self.inner():
                slots.append((leaf(field, w),))
            else:
                raise self.error("unexpected sign")
        slop, ordered = 0, True
        if self.take("~"):
            m = re.compile(r"-?\d+").match(self.text, self.at)
            if not m:
                raise self.error("no slop")
            self.at = m.end()
            slop, ordered = int(m.group()), not m.group().startswith("-")
            if not ordered:  # the sign means any order, and -n a slop of n - 1
                slop = -slop - 1
        if len(slots) == 1 and len(slots[0]) == 1:
            return self.boosted(slots[0][0])
        return self.boosted(Phrase(field, tuple(slots), slop, ordered))

    def inner(self) -> str:
        m = re.compile(r'(?:[^\s"()\\]|\\.)+').match(self.text, self.at)
        if not m:
            return ""
        self.at = m.end()
        return m.group()

    def range(self, field: str | None) -> Node:
        with_low = self.take("[")
        if not with_low:
            self.take("{")
        m = re.compile(r"\s*(\"[^\"]*\"|\S+)\s+TO\s+(\"[^\"]*\"|[^\s\]}]+)\s*([\]}])").match(self.text, self.at)
        if not m:
            raise self.error("no range")
        self.at = m.end()
        low, high = (None if x == "*" else x.strip('"') for x in m.groups()[:2])
        return self.boosted(Range(field, low, high, with_low, m.group(3) == "]"))

    def sub(self) -> Node:
        begin, depth, at = self.at + 1, 0, self.at
        parts, last = [], self.at + 1
        while at < len(self.text):
            c = self.text[at]
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
                if not depth:
                    break
            elif c == "§" and depth == 1:
                parts.append(self.text[last:at])
                last = at + 1
            at += 1
        if depth or len(parts) != 2 or at < begin:
            raise self.error("a sub-query is <LEVEL§query§TARGET>")
        target = self.text[last:at]
        self.at = at + 1
        return Sub(parts[0].strip(), parse(parts[1]), target.strip())


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text)


def leaf(field: str | None, text: str) -> Node:
    """A single word: term, wildcard or fuzzy."""
    m = re.fullmatch(r"((?:[^~\\]|\\.)+)~(\d?)(?::(\d+))?(?::(true|false))?", text)
    if m:
        return Fuzzy(field, unescape(m.group(1)), int(m.group(2) or 2), int(m.group(3) or 0), m.group(4) != "false")
    if text == "*":
        return Wildcard(field, "*") if field else MatchAll()
    if re.search(r"(?<!\\)[*?]", text):
        return Wildcard(field, text)
    return Term(field, unescape(text))


def parse(text: str | None) -> Node:
    """The tree of a query; empty text and ``*`` match everything."""
    p = _Parser((text or "").strip())
    node = p.query(None)
    p.blank()
    if p.at < len(p.text):
        raise p.error("unexpected end")
    return node


def wildcard_regex(pattern: str) -> str:
    """An anchored Java expression for a pattern of ``*`` and ``?``."""
    out = []
    for part in re.findall(r"\\.|.", pattern, re.S):
        out.append(".*" if part == "*" else "." if part == "?" else re.escape(part[-1]))
    return "^" + "".join(out) + "$"


def checked_regex(pattern: str) -> str:
    """An anchored Java expression; operators that only the index's dialect has are refused."""
    bare = re.sub(r"\\.|\[[^\]]*\]", "", pattern)
    if re.search(r"[~&@#]|<\d*-\d*>", bare):
        raise QueryError(f"operators ~ & @ # <n-m> aren't supported: {pattern}")
    return f"^(?:{pattern})$"
