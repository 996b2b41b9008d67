"""Secrets by assignment-aware lexing.

The lexer stops at assignment operators (``:``, ``=``, ``:=`` and ``=>``), reads the name on their left and the
literal or name on their right, and so turns source and configuration text into name-literal pairs. In
``name: type = literal`` the literal belongs to the name before the type. Constants are propagated: a literal assigned
to a plain name counts for every sensitive name that the plain name is assigned to; of several assignments the latest
before the use counts, or the first after it if none is before. Literals are scored by the parts of their target names,
their length, their character classes and their entropy.

Base kinds are assign (a keyword, an operator and a value), access (key ids) and hex (long runs); the method adds
``literal``. Positions are code points, ends exclusive.

Edge cases: a null or empty text has no spans; every row is handled alone, repeated rows alike; an empty table gives
no rows; other columns are not read. Whole texts are lexed, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text
from .spans import Span, digest, listed

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal")
#: Names of the base rule, and weighted parts of sensitive names.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
SENSITIVE = {"password": 3, "passwd": 3, "passphrase": 3, "pwd": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
             "credentials": 3, "bearer": 3, "private": 2, "auth": 2, "key": 2, "pass": 2, "access": 1, "client": 1}
LEAST_SCORE = 5
OPERATOR = re.compile("[:=]")
VALUE = re.compile(r" *[\"']?([A-Za-z0-9+/_.=-]+)")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*")
LITERAL = re.compile(r"[=>]?[ \t]*(?:\"([^\"\n]+)\"|'([^'\n]+)'|([A-Za-z0-9+/_.=-]+))")
#: A type between ``:`` and ``=``: references and lifetimes, names with paths, arguments in brackets two deep, arrays, options, unions.
_ARGUMENTS = r"(?:<(?:[^<>=\n]|<[^<>=\n]*>)*>|\[(?:[^\[\]=\n]|\[[^\[\]=\n]*\])*\])"
_ONE = rf"(?:&?(?:'[a-z_]+[ \t]+)?(?:(?:mut|readonly|const|dyn)[ \t]+)?[A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)*{_ARGUMENTS}?(?:\[\])*[?!*]?|{_ARGUMENTS}[?!]?|\"[A-Za-z_][^\"=\n]*\"|'[A-Za-z_][^'=\n]*')"
TYPE = re.compile(rf"[ \t]*{_ONE}(?:[ \t]*[|&][ \t]*{_ONE})*[ \t]*=(?![=>])", re.A)
KEY = re.compile(r"[ \t]*=>")
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")


def assigned(text: str, op: int, done: int) -> tuple[int, re.Match] | None:
    """Start of the base keyword left of the operator and the value right of it; nothing before ``done`` counts."""
    i = op
    while i > done and text[i - 1] == " ":
        i -= 1
    if i > done and text[i - 1] in "\"'":
        i -= 1
    tail = text[max(done, i - 8) : i]
    if not tail.isascii():
        tail = re.sub(r"[^\x00-\x7f]", "\0", tail)
    for word in KEYWORDS:
        if tail.lower().endswith(word):
            m = VALUE.match(text, op + 1)
            return (i - len(word), m) if m else None
    return None


def name_before(text: str, op: int, done: int) -> str:
    """The name that an operator assigns to; empty if there is none."""
    i = op
    while i > done and text[i - 1] in " \t":
        i -= 1
    if i > done and text[i - 1] in "\"'":
        i -= 1
    end = i
    while i > done and text[i - 1].isascii() and (text[i - 1].isalnum() or text[i - 1] in "_.-"):
        i -= 1
    m = NAME.search(text, i, end)
    return m[0] if m and m.end() == end else ""


def name_score(name: str) -> int:
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).lower())
    return sum(SENSITIVE.get(p, 0) for p in dict.fromkeys([*parts, "".join(parts[-2:])]))


def value_score(value: str) -> int:
    """Up to 4: length, digits beside letters, entropy. Placeholders and plain words stay low."""
    n = len(value)
    if n < 8 or not value.isascii() or " " in value or re.fullmatch(r"[A-Za-z.,;!?-]+", value):
        return 0
    entropy = -sum(c / n * log2(c / n) for c in Counter(value).values())
    return 1 + (n >= 16) + bool(re.search("[0-9]", value) and re.search("[A-Za-z]", value)) + (entropy >= 3)


def sources(pairs: list[tuple[str, str, int, int]]) -> list[int]:
    """For each pair, the pair whose value its own stands for: names are followed to the latest assignment before, else to the first after."""
    n, latest, first = len(pairs), {}, {}
    for i in range(n - 1, -1, -1):
        first[pairs[i][0]] = i
    refers = []
    for i, (name, value, *_) in enumerate(pairs):
        refers.append(latest.get(value, first.get(value, i)))
        latest[name] = i
    out = [-1] * n
    for i in range(n):
        path, j = [], i
        while out[j] < 0:
            out[j] = n  # on the path
            path.append(j)
            j = refers[j]
        end = out[j] if out[j] < n else j
        for p in path:
            out[p] = end
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text."""
    base: list[Span] = [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    pairs: list[tuple[str, str, int, int]] = []
    done = seen = 0
    for op in (m.start() for m in OPERATOR.finditer(text)):
        if op >= done and (hit := assigned(text, op, done)):
            start, m = hit
            done = m.end()
            if len(m[1]) >= 8:
                base.append((start, done, "assign"))
        if op >= seen and (name := name_before(text, op, seen)):
            m = LITERAL.match(text, op + 1)
            t = TYPE.match(text, op + 1) if text[op] == ":" else None
            typed = LITERAL.match(text, t.end()) if t else None
            if m and m[3] and KEY.match(text, m.start(3) + len(m[3].rstrip("="))):
                continue  # the word is itself the name of what follows, as in ``call :name => literal``
            # What stands for a type may be a value before an unrelated ``=``: it stays a pair if it looks like a secret.
            for x in (m if not typed or m and value_score(m[m.lastindex or 3]) >= 2 else None, typed):
                if x:
                    g = x.lastindex or 3
                    pairs.append((name, x[g], x.start(g), x.end(g)))
                    seen = x.end()
    more: list[Span] = []
    for (name, *_), at in zip(pairs, sources(pairs)):
        score = name_score(name)
        if score < 2:
            continue
        _, value, start, end = pairs[at]
        if score + value_score(value) >= LEAST_SCORE and value_score(value) >= 2:
            more.append((start, end, "literal"))
    covered = [(s, e) for s, e, _ in base]
    return base, [x for x in dict.fromkeys(more) if not any(s < x[1] and x[0] < e for s, e in covered)]


def find_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans for every row; ids of any type, null ones too."""
    def run(texts: list) -> tuple[None, list[list]]:
        rows = []
        for t in texts:
            base, more = find(t or "")
            rows.append((*(sum(s[2] == k for s in base) for k in BASE), digest(base, KINDS), listed(base + more, KINDS)))
        return None, [[r[c] for r in rows] for c in range(len(BASE) + 2)]

    added = {**{f"n_{k}": pa.int64() for k in BASE}, "base_sha256": pa.string(), "spans": pa.string()}
    return per_text(docs, [F.col(id_col).alias("doc_id")], F.col(text), run, added)
