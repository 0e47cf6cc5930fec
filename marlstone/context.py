"""Conversation context: neutral text, budgets, standing preferences."""

from __future__ import annotations

import json
import re
import unicodedata

from .functions.pii import scrub


def neutralise(text: str) -> str:
    """Text that cannot close a fence: NFKC, no angle runs, no personal data."""
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"[<>]{2,}|</?[a-z_]+>", " ", text, flags=re.I).replace("```", "'''")
    return scrub(text).text


def shrunk(envelope: dict, most: int, rounds: int = 12) -> str:
    """The envelope as JSON, its rows halved until it fits, at most 12 times."""
    envelope = dict(envelope)
    for _ in range(rounds):
        said = json.dumps(envelope, default=str)
        if len(said) <= most or not envelope.get("data"):
            return said
        envelope["data"] = envelope["data"][: len(envelope["data"]) // 2]
        envelope["meta"] = {**envelope.get("meta", {}), "shortened": True}
    return json.dumps(envelope, default=str)


def shed(items: list[tuple[int, int, str]], most: int) -> list[str]:
    """Texts by (kind order, age) that fit the budget: low kinds and new ones first."""
    kept, used = [], 0
    for _, _, text in sorted(items, key=lambda x: (x[0], x[1])):
        if used + len(text) <= most:
            kept.append(text)
            used += len(text)
    return kept


PREFERENCES = (
    ("format", "table", re.compile(r"\b(?:always|from now on|prefer)\b.*\btables?\b", re.I)), ("format", "bullets", re.compile(r"\b(?:always|from now on|prefer)\b.*\bbullets?\b", re.I)),
    ("length", "short", re.compile(r"\b(?:always|from now on|prefer)\b.*\b(?:short|brief|concise)\b", re.I)), ("length", "long", re.compile(r"\b(?:always|from now on|prefer)\b.*\b(?:long|detailed)\b", re.I)),
)


def detect_preference(text: str) -> dict[str, str]:
    """Standing wishes about answers; negated ones do not count."""
    if re.search(r"\b(?:don't|do not|never|not)\b", text, re.I):
        return {}
    return {name: value for name, value, rule in PREFERENCES if rule.search(text)}
