"""Operator 2: personal data spans.

Regular expressions propose spans, checksum validators confirm them, and the
words near a span adjust its score.  The four base kinds are accepted by their
validator alone; the added kinds need a score of ``threshold`` or more:

* ``iban``: country code, two check digits, 11 to 30 letters or digits, confirmed
  by the remainder mod 97.
* ``ssn``: three, two and four digits joined by hyphens in an assignable range;
  its shape alone scores below the threshold, so a context word must be near.
* ``natphone``: a telephone number without ``+``, likewise only near a context word.

A text without a digit and without ``@`` is passed over after one scan.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, texts_as_str

#: Kinds in the order that breaks ties on the start: base kinds first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "natphone")

#: An address is found from its @ outwards, and IP numbers in whole dotted runs:
#: a search from every letter or digit would take the square of a long run.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Letters and digits of an IBAN by country.
IBAN_LENGTH = {
    c: n for n, countries in {
        15: "NO", 16: "BE", 18: "DK FO FI GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "HR LV LI CH", 22: "BH BG CR GE DE IE ME RS GB VA", 23: "GI IQ IL TL AE",
        24: "AD CZ MD PK RO SA SK ES SE TN VG", 25: "PT ST", 26: "IS TR", 27: "FR GR IT MR MC SM", 28: "AL AZ BY CY DO SV GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items() for c in countries.split()
}
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
NATPHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[\x20./-]?[0-9]{3,4}[\x20./-]?[0-9]{3,5}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

#: Words that raise a span's score when one stands within WINDOW characters.
CONTEXT = {
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "email": ("mail", "email", "contact", "write"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "natphone": ("phone", "tel", "call", "mobile", "fax", "telephone"),
}
WINDOW = 40
WORD = re.compile(r"[^\W\d_]+")
#: Score of a confirmed span before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "natphone": 0.3}
BOOST = 0.3
THRESHOLD = 0.6

SPAN = "array<struct<kind: string, start: int, end: int, score: double>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    """Whether every second digit from the right doubled sums to a multiple of 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at += 1


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Four parts of at most 255: matches of ``[0-9]+(\\.[0-9]+){3}`` take a run's parts by fours."""
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield start, end
            start = end + 1


def valid_card(m: re.Match) -> bool:
    digits = NOT_DIGIT.sub("", m[0])
    return 12 <= len(digits) <= 19 and luhn(digits)


def valid_phone(m: re.Match) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that pass mod 97: of the country's length, else up to the last separator that allows it."""
    at = 0
    while m := IBAN.search(text, at):
        ends = [m.start() + i for i, c in enumerate(m[0]) if c == " "][::-1]
        ends.insert(0, m.end())
        long = IBAN_LENGTH.get(m[0][:2])
        ends.sort(key=lambda e: len(text[m.start() : e].replace(" ", "")) != long)
        for end in ends:
            if IBAN.fullmatch(text, m.start(), end) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                at = end
                break
        else:
            at = m.start() + 1


def valid_ssn(m: re.Match) -> bool:
    return m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"


def valid_natphone(m: re.Match) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", m[0])) <= 12


def matches(pattern: re.Pattern, valid: Callable[[re.Match], bool], text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text) if valid(m)]


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of those taken."""
    order = sorted(taken)
    starts = [s for s, _ in order]
    furthest = list(accumulate((e for _, e in order), max))
    return [(s, e) for s, e in spans if not (n := bisect_left(starts, e)) or furthest[n - 1] <= s]


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    words = {w.lower() for w in WORD.findall(near)}
    return round(min(1.0, PRIOR[kind] + BOOST * (not words.isdisjoint(CONTEXT[kind]))), 6)


def find_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """All spans of a whole text by start, then kind as listed in KINDS.

    Positions are code points, the end exclusive.  A base match that its
    validator refuses is dropped and not tried again.  An IBAN stands beside
    a base span it overlaps; any other added span that overlaps one is left out.
    """
    digits = DIGIT.search(text) is not None
    found = []
    if "@" in text:
        found = [("email", *at, score("email", text, *at)) for at in emails(text)]
    if digits:
        base = {"ip": ips(text) if "." in text else (), "card": matches(CARD, valid_card, text), "phone": matches(PHONE, valid_phone, text) if "+" in text else ()}
        found += [(kind, *at, score(kind, text, *at)) for kind, spans in base.items() for at in spans]
        taken = [(s, e) for _, s, e, _ in found]
        for s, e in ibans(text):
            if (x := score("iban", text, s, e)) >= threshold:
                found.append(("iban", s, e, x))
                taken.append((s, e))
        for kind, pattern, valid in (("ssn", SSN, valid_ssn), ("natphone", NATPHONE, valid_natphone)):
            for at in apart(matches(pattern, valid, text), taken):
                if (x := score(kind, text, *at)) >= threshold:
                    found.append((kind, *at, x))
                    taken.append(at)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and its spans (kind, start, end, score), one row per input row.

    A null text counts as empty and has no span; null and repeated doc_ids
    pass through; other columns are ignored; an empty table stays empty.
    """
    prepare(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find_spans(t, threshold)] for t in texts_as_str(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN_TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, f"doc_id long, spans {SPAN}")


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span replaced by its kind; overlaps go to the first."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
            at = end
    return "".join([*out, text[at:]])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns from pii_spans()."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
