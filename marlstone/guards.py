"""Text guards: instructions smuggled into input, echoed answers."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules in the order of precedence; weak signals need two.
STRONG = re.compile(r"\b(?:ignore|disregard|forget|override)\b.{0,40}\b(?:previous|above|prior|all|your)\b.{0,20}\b(?:instructions?|rules?|prompts?|polic(?:y|ies))\b", re.S)
EXFILTRATE = re.compile(r"\b(?:reveal|print|show|repeat|leak|dump)\b.{0,40}\b(?:system prompt|hidden prompt|instructions|api keys?|secrets?|credentials?)\b", re.S)
ENCODED = re.compile(r"\b(?:[A-Za-z0-9+/]{60,}={0,2}|(?:[0-9a-f]{2}\s?){40,})\b")
PERSONAL = re.compile(r"\b(?:emails?|phone numbers?|home address(?:es)?|passwords?)\b.{0,30}\b(?:of|for)\b.{0,20}\b(?:customers?|users?|people)\b", re.S)
WEAK = (re.compile(r"\byou are now\b"), re.compile(r"\bact as\b"), re.compile(r"\bpretend\b"), re.compile(r"\bdeveloper mode\b"), re.compile(r"\bno restrictions?\b"), re.compile(r"</?(?:system|assistant|user)>"))
SQUASHED = ("ignoreprevious", "ignoreallinstructions", "systemprompt")
LEET = (str.maketrans("013457@$", "oleastas"), str.maketrans("013457@$", "oieastas"))


def folded(text: str) -> str:
    text = unicodedata.normalize("NFKC", text)
    return "".join(c for c in text if unicodedata.category(c) != "Cf").casefold()


def scan_injection(text: str) -> str:
    """A rule code, or ``ok``; the text is read as is, without mark-up, and with leetspeak folded."""
    plain = folded(text)
    copies = [plain, re.sub(r"<[^>]*>|[*_`#]", "", plain)]
    copies += [c.translate(leet) for c in copies for leet in LEET]
    spaced = re.sub(r"\b(?:\w[ .\-_]){4,}\w\b", lambda m: re.sub(r"[ .\-_]", "", m[0]), plain)
    if any(s in spaced and s not in plain for s in SQUASHED):
        return "squashed"
    for code, rule in (("injection", STRONG), ("exfiltration", EXFILTRATE), ("encoded", ENCODED), ("pii_request", PERSONAL)):
        if any(rule.search(c) for c in (copies if code != "encoded" else [text])):
            return code
    return "weak_signals" if max(sum(bool(w.search(c)) for w in WEAK) for c in copies) >= 2 else "ok"


@F.pandas_udf(T.StringType())
def injection_code(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """scan_injection() over Arrow batches; null for null."""
    for part in parts:
        yield part.map(lambda t: None if t is None else scan_injection(t))


def is_echo(answer: str, previous: str, least: float = 0.9) -> bool:
    """Nearly the same text with the same numbers."""
    numbers = lambda t: re.findall(r"\d+(?:\.\d+)?", t)
    return numbers(answer) == numbers(previous) and difflib.SequenceMatcher(None, " ".join(answer.split()), " ".join(previous.split())).ratio() >= least
