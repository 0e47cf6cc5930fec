"""Checks on the text of a statement, before Spark parses it."""

from __future__ import annotations

import re

MAX_CHARS = 8000
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Sources that the parser turns into plain nodes, so only the word shows them.
FOREIGN_WORDS = frozenset({"TABLESAMPLE", "UNNEST"})
TOKEN = re.compile(
    r"""(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<quoted>`(?:[^`]|``)*`)
    |(?P<number>[0-9]+(?:\.[0-9]+)?)|(?P<word>[^\W\d]\w*)|(?P<space>\s+)|(?P<mark>.)""",
    re.S | re.X,
)


def tokens(sql: str) -> list[tuple[str, str]]:
    """(kind, text) without comments and white space."""
    return [(m.lastgroup, m[0]) for m in TOKEN.finditer(sql) if m.lastgroup not in ("comment", "space")]


def first_problem(sql: str) -> str | None:
    """A reason code for what the text alone shows, in a fixed order."""
    if not sql or not sql.strip():
        return "sql_syntax"
    if len(sql) > MAX_CHARS:
        return "sql_too_long"
    found = tokens(sql)
    if not found:
        return "sql_syntax"
    for kind, text in found:
        if kind in ("word", "quoted") and not text.isascii():
            return "non_ascii_identifier"
        if kind == "quoted" and not all(IDENTIFIER.match(p) for p in text[1:-1].split(".")):
            return "identifier_not_allowed"
    marks = [i for i, (kind, text) in enumerate(found) if kind == "mark" and text == ";"]
    if any(i != len(found) - 1 for i in marks):
        return "multiple_statements"
    first = found[0][1].upper()
    if first == "(" or found[0][0] == "word" and first not in ("SELECT", "WITH"):
        return "statement_not_allowed"
    if first == "WITH" and len(found) > 1 and found[1][1].upper() == "RECURSIVE":
        return "recursive_cte"
    if any(kind == "word" and text.upper() in FOREIGN_WORDS for kind, text in found):
        return "source_not_allowed"
    return None


def without_literals(sql: str) -> str:
    """The statement with every literal as ``?``, for traces."""
    return " ".join("?" if kind in ("string", "number") else text for kind, text in tokens(sql))


def normal_form(sql: str) -> str:
    """Comments dropped and white space collapsed, for hashing."""
    return " ".join(text for _, text in tokens(sql) if text != ";")
