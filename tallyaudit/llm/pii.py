"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors in one pass over a text: at-signs, digits, plus signs, schemes and
identifier cues. At each anchor a deterministic local parser expands to the left and right and validates what it
finds: address characters and domain labels, octets, Luhn and mod-97 checksums, digit counts.

Base kinds are email, ip, card and phone. The method adds ``address`` (user data in a URL), ``account`` (an IBAN or a
number behind an account cue) and phone numbers behind ``tel:``. Positions are code points, ends exclusive.

Edge cases: a null or empty text has no spans; every row is handled alone, repeated rows alike; an empty table gives
no rows; other columns are not read. A long text is scanned once, with constant extra memory but for its spans.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_text
from .spans import Span, digest, listed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account")
#: Anchors besides the ten digits.
MARKS = ("@", "+", "://", "tel:", "TEL:", "Tel:")
ACCOUNT_CUES = ("iban", "IBAN", "Iban", "account", "Account", "ACCOUNT", "acct", "Acct", "ACCT")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
OCTETS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"[ ]*([0-9(][ ().0-9-]*[0-9])")
USER_DATA = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+(?::[0-9]+)?")
IBAN = re.compile(r"[ :#.]*(?:[Nn]o\.?|[Nn]umber)?[ :#]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"[ :#.]*(?:[Nn]o\.?|[Nn]umber)?[ :#]*([0-9](?:[ -]?[0-9]){7,16})(?![0-9])")
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")

_machine = None


def automaton():
    """The anchors' automaton, built once per Python worker."""
    global _machine
    if _machine is None:
        import ahocorasick

        _machine = ahocorasick.Automaton()
        for mark in (*"0123456789", *MARKS, *ACCOUNT_CUES):
            _machine.add_word(mark, mark)
        _machine.make_automaton()
    return _machine


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text."""
    base: list[Span] = []
    more: list[Span] = []
    email = ip = card = phone = 0  # where the search of each kind goes on
    for last, mark in automaton().iter(text):
        at = last - len(mark) + 1
        if mark == "@":
            left = at
            while left > email and text[left - 1] in LOCAL:
                left -= 1
            m = DOMAIN.match(text, at + 1) if left < at else None
            if m:
                email = m.end()
                base.append((left, email, "email"))
        elif mark == "+":
            m = PHONE.match(text, at) if at >= phone else None
            if m:
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    base.append((at, phone, "phone"))
        elif len(mark) == 1:
            if at >= ip and (at == ip or not "0" <= text[at - 1] <= "9"):
                m = OCTETS.match(text, at)
                if m:
                    ip = m.end()
                    if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.groups()):
                        base.append((at, ip, "ip"))
            if at >= card:
                m = NUMBER.match(text, at)
                card = m.end() if m else at + 1
                digits = re.sub("[ -]", "", m[0]) if m else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    base.append((at, card, "card"))
        elif mark == "://":
            m = USER_DATA.match(text, last + 1)
            scheme = SCHEME.search(text, max(0, at - 20), at)
            if m and scheme:
                more.append((scheme.start(), m.end(), "address"))
        elif mark.lower() == "tel:":
            m = LOCAL_PHONE.match(text, last + 1)
            if m and 9 <= sum(c.isdigit() for c in m[1]) <= 15:
                more.append((m.start(1), m.end(1), "phone"))
        else:
            m = IBAN.match(text, last + 1)
            if not (m and iban(m[1])):
                m = ACCOUNT.match(text, last + 1)
            if m:
                more.append((m.start(1), m.end(1), "account"))
    return base, [s for s in dict.fromkeys(more) if s not in base]


def find_personal_data(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, the counts of the base kinds, base_sha256 and spans for every row; ids of any type, null ones too."""
    def run(texts: list) -> tuple[None, list[list]]:
        rows = []
        for t in texts:
            base, more = find(t or "")
            rows.append((*(sum(s[2] == k for s in base) for k in BASE), digest(base, KINDS), listed(base + more, KINDS)))
        return None, [[r[c] for r in rows] for c in range(len(BASE) + 2)]

    added = {**{f"n_{k}": pa.int64() for k in BASE}, "base_sha256": pa.string(), "spans": pa.string()}
    return per_text(docs, [F.col(id_col).alias("doc_id")], F.col(text), run, added)
