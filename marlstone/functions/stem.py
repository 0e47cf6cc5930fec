"""The Porter stemmer (M. F. Porter, 1980), for text indexes that fold word forms."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffix rules of the published algorithm, by step.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """Each letter as v or c; y is a vowel after a consonant."""
    out = ""
    for i, letter in enumerate(word):
        out += "v" if letter in "aeiou" or letter == "y" and i and out[-1] == "c" else "c"
    return out


def measure(word: str) -> int:
    """How many vowel runs are followed by a consonant run."""
    return len(re.findall("v+c+", shape(word)))


def doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and shape(word)[-1] == "c"


def short_end(word: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def swapped(word: str, rules: tuple[tuple[str, str], ...], least: int) -> str:
    """The longest suffix of the rules that fits, replaced if its stem measures enough."""
    fitting = [r for r in rules if word.endswith(r[0])]
    if not fitting:
        return word
    end, new = max(fitting, key=lambda r: len(r[0]))
    stem = word[: -len(end)]
    if measure(stem) <= least or end == "ion" and stem[-1:] not in ("s", "t"):
        return word
    return stem + new


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isalpha() or not word.isascii():
        return word
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            base = word[: -len(end)]
            if word.endswith(end):
                if "v" in shape(base):
                    word = base
                    if word.endswith(("at", "bl", "iz")) or measure(word) == 1 and short_end(word):
                        word += "e"
                    elif doubled(word) and word[-1] not in "lsz":
                        word = word[:-1]
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = swapped(word, STEP2, 0)
    word = swapped(word, STEP3, 0)
    word = swapped(word, tuple((e, "") for e in STEP4), 1)
    if word.endswith("e"):
        base = word[:-1]
        if measure(base) > 1 or measure(base) == 1 and not short_end(base):
            word = base
    return word[:-1] if measure(word) > 1 and doubled(word) and word.endswith("l") else word


def terms(text: str) -> list[str]:
    """Stemmed words without diacritics."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return [stem(w) for w in re.findall(r"[^\W_]+", bare)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def stemmed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """terms() over Arrow batches; null for null."""
    for part in parts:
        yield part.map(lambda t: None if t is None else terms(t))
