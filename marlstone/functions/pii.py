"""Masking of personal data in text: folding, then patterns in a fixed order."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_CHARS = 100_000
DASHES = dict.fromkeys(map(ord, "‐‑‒–—―−﹘﹣－"), "-")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+(?:\s?\(at\)\s?|\s?\[at\]\s?|@)[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?)[A-Za-z0-9-]+)+")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b")
ID_CUE = re.compile(r"\b((?:customer|user|account|passport|member|order)\s*(?:id|no|number|#)\s*[:#]?\s*)([0-9]{6,})\b", re.I)
PHONE_CUE = re.compile(r"\b((?:phone|tel|mobile|cell|fax)\.?\s*:?\s*)(\+?[0-9][0-9 ().-]{5,}[0-9])", re.I)
CARD = re.compile(r"(?<![0-9-])(?:[0-9][ -]?){12,18}[0-9](?![0-9-])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
INTERNATIONAL = re.compile(r"\+[0-9][0-9 ().-]{5,18}[0-9](?:\s?(?:ext|x)\.?\s?[0-9]{1,5})?")
NANP = re.compile(r"(?<![0-9-])(?:\([2-9][0-9]{2}\)\s?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?:\s?(?:ext|x)\.?\s?[0-9]{1,5})?(?![0-9-])")
#: Between groups of digits: a dot or hyphen with blanks around it, or white space.
SEP = r"(?:[ \t]{0,2}[.\-][ \t]{0,2}|\s{1,2})"
ID_KEYWORD = re.compile(
    r"(?i:\b(ssn|social[ \t]+security(?:[ \t]+(?:number|no))?|passport(?:[ \t]+(?:number|no))?|national[ \t]+id|tax[ \t]+id|driver'?s?[ \t]+licen[cs]e(?:[ \t]+(?:number|no))?)\b)"
    r"[^\w\n]{0,4}(?:(?i:is|was|number|no)[^\w\n]{0,4})?([A-Za-z]{0,3}[0-9][0-9 \-]{4,14}[0-9][A-Za-z]?)(?!\w)"
)
PHONE_KEYWORD = re.compile(
    r"(?i:\b(?:phone|telephone|tel|cellphone|cell|mobile|whatsapp|fax|contact\s{1,3}number|call(?:ed)?|sms|dial|text[ \t]+me|reach[ \t]+me)\b)"
    r"(?:[^\d\n]{0,20}?\n)?[^\d\n]{0,20}?(\+?[0-9][0-9 \-.()]{5,20}[0-9])(?![0-9])"
)
PHONE_INTL = re.compile(rf"(?<![\w+])(?:(?:\+|\b00)[0-9]{{1,4}}(?:{SEP}?\([0-9]{{1,5}}\)|(?:{SEP}|(?<=\)))[0-9]{{1,8}}){{1,6}}|\+[0-9]{{7,15}})(?!\w)")
CARD_GROUPED = re.compile(rf"(?<![0-9.,])[0-9]{{4}}(?:{SEP}[0-9]{{3,6}}){{2,4}}(?![0-9])")
LONG_RUN = re.compile(r"(?<![0-9])[0-9]{13,}(?![0-9])")
PHONE_NANP = re.compile(rf"(?<![\w+])(?:1{SEP})?(?:\([0-9]{{3}}\){SEP}?|[0-9]{{3}}{SEP})[0-9]{{3}}{SEP}[0-9]{{4}}(?!\w)")
PHONE_NATIONAL = re.compile(rf"(?<![\w.,])0[0-9]{{2,4}}{SEP}[0-9]{{3,4}}{SEP}[0-9]{{3,4}}(?!\w)")
SSN_SEPARATED = re.compile(r"(?<![\w.-])[0-9]{3}([-. ])[0-9]{2}\1[0-9]{4}(?![\w-]|\.[0-9])")
PHONE_EXT = re.compile(r"<PHONE>[ \t]{0,2},?[ \t]{0,2}(?i:ext(?:ension)?\.?|x|#)[ \t]{0,2}[0-9]{1,6}(?!\w)")
YEAR = re.compile(r"(?:19|20)[0-9]{2}")
#: A report's own id, standing alone, is no personal data though it may hold a long run of digits.
REPORT_ID = re.compile(r"(?<![^\s(\[{\"'`*|])[Rr]-[0-9a-f]{32}(?=$|[\s)\]}\"'`*|]|[.,;:!?](?![\w@%+\-])|\.md(?![\w@.%+\-]))", re.ASCII)
HELD = re.compile("\x00([a-z]+)\x00")
HELD_GAP = re.compile("[ \\t]*\x00[a-z]+\x00[ \\t]*")
MOST_HELD = 500
#: Addresses and names have no checksum: only shapes and cue words, never bare words.
ADDRESS = re.compile(
    r"\b[0-9]{1,5}[A-Za-z]?\s+(?!(?:of|the|in|and|or|for|per|to|from|units?|orders?|items?|customers?|days?|months?)\b)(?:[A-Z][\w.'-]*\s+){1,4}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq)\b\.?(?:,?\s*(?:Apt|Suite|Unit|#)\.?\s*\w+)?(?:,\s*[A-Z][\w ]+,?\s*[A-Z]{2}\s*[0-9]{5}(?:-[0-9]{4})?)?"
)
PO_BOX = re.compile(r"\bP\.?\s?O\.?\s?Box\s+[0-9]+\b", re.I)
ADDRESS_CUE = re.compile(r"\b((?:home|street|mailing|shipping|billing)?\s?address\s*[:=]\s*)([^\n;|]{6,80})", re.I)
NAME = r"[A-Z][a-z'’-]+(?:\s+[A-Z][a-z'’-]+){0,2}"
NAME_CUES = (
    re.compile(rf"\b((?:Mr|Mrs|Ms|Miss|Dr|Prof)\.?\s+)({NAME})"), re.compile(rf"\b((?:[Mm]y name is|I am called|[Tt]his is)\s+)({NAME})"),
    re.compile(rf"((?:\b[Nn]ame|\b[Cc]ustomer|\b[Cc]ontact)\s*:\s*)({NAME})"), re.compile(rf"(^(?:Dear|Hi|Hello)\s+)({NAME})", re.M),
)
SECRET = re.compile(
    r"(?i:\b(?:api[_-]?key|token|secret|password)\b\s*[:=]\s*\S+|\bBearer\s+\S+|\bsk-[A-Za-z0-9]{16,})"
    r"|AIza[0-9A-Za-z_-]{35}|ya29\.[0-9A-Za-z_.~+/=-]+|\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|(?i:(?:key|token|secret|password|passwd|signature)=[^&\s\"',;]+)"
)
SENSITIVE = ("key", "token", "secret", "password", "authorization", "credential")
ENCODED = {"%40": "@", "&#64;": "@", "&commat;": "@", "%2e": ".", "%2E": ".", "&#46;": "."}


def mask_people(text: str, allowed: frozenset[str] = frozenset()) -> str:
    """Names and addresses by cue; words of the allowlist (brands, categories) stay."""
    text = PO_BOX.sub("<ADDRESS>", ADDRESS.sub("<ADDRESS>", text))
    text = ADDRESS_CUE.sub(lambda m: m[0] if "<ADDRESS>" in m[2] else m[1] + "<ADDRESS>", text)
    for cue in NAME_CUES:
        text = cue.sub(lambda m: m[0] if m[2].lower() in allowed else m[1] + "<PERSON>", text)
    return text


def mask_name_columns(lines: list[str], sep: str = "|") -> list[str]:
    """Every cell below a name-like header of a table in text."""
    if not lines:
        return lines
    heads = [h.strip().lower() for h in lines[0].split(sep)]
    at = {i for i, h in enumerate(heads) if re.fullmatch(r"(?:first|last|full|customer|contact)?[ _]?name|customer|person", h)}
    out = [lines[0]]
    for line in lines[1:]:
        cells = line.split(sep)
        out.append(sep.join("<PERSON>" if i in at and c.strip() and not re.fullmatch(r"[\s:-]+", c) else c for i, c in enumerate(cells)))
    return out


@dataclass
class Scrubbed:
    text: str
    findings: dict[str, int] = field(default_factory=dict)
    truncated: bool = False


def fold(text: str) -> str:
    """Invisible characters out, odd spaces, full-width letters and dashes to ASCII."""
    if text.isascii():
        return text
    text = "".join(" " if (c := unicodedata.category(x)) == "Zs" else "" if c == "Cf" else x for x in text)
    text = "".join(chr(ord(x) - 0xFEE0) if 0xFF01 <= ord(x) <= 0xFF5E else x for x in text)
    return text.translate(DASHES)


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def mod97(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def scrub(text: str) -> Scrubbed:
    """Mask personal data; texts beyond 100,000 characters lose their tail."""
    cut = len(text) > MOST_CHARS
    if cut:
        text = text[:MOST_CHARS].rsplit(None, 1)[0]
    if text.isascii() and not any(c.isdigit() for c in text) and "@" not in text and "at" not in text:
        return Scrubbed(text, {}, cut)
    out = fold(text).replace("\x00", "")
    for code, char in ENCODED.items():
        out = out.replace(code, char)
    ids: list[str] = []

    def hold(m: re.Match) -> str:
        if len(ids) >= MOST_HELD or any(len(r) > 19 or luhn(r) for r in LONG_RUN.findall(m[0])):
            return m[0]
        ids.append(m[0])
        return "\x00" + "".join(chr(97 + int(d)) for d in str(len(ids) - 1)) + "\x00"

    held = REPORT_ID.sub(hold, out)
    out, found = mask_numbers(held)
    if ids:
        # An id must not hide what it splits: if the text without ids is masked otherwise, the ids go.
        without, counts = mask_numbers(HELD_GAP.sub(" ", held))
        if without != HELD_GAP.sub(" ", out):
            return Scrubbed(without, counts, cut)
        out = HELD.sub(lambda m: ids[int("".join(str(ord(c) - 97) for c in m[1]))], out)
    return Scrubbed(out, found, cut)


def card_or_id(m: re.Match) -> str | None:
    """What a group of digits shaped like a card is: CARD, ID, or neither."""
    groups = re.findall("[0-9]+", m[0])
    digits = "".join(groups)
    if len(digits) < 13:
        return None
    if len(digits) <= 19 and luhn(digits):
        return "CARD"
    if len(groups) == 1 or re.search(r"[.-]", m[0]):
        return "ID"
    layout = len(groups) == 4 and all(len(g) == 4 for g in groups)
    return "ID" if layout and not all(YEAR.fullmatch(g) for g in groups) else None


def mask_numbers(out: str) -> tuple[str, dict[str, int]]:
    """E-mail addresses and numbers, in the reference's order; the wider patterns of ours follow theirs."""
    found: Counter = Counter()

    def mask(pattern: re.Pattern, kind, group: int = 0) -> None:
        """kind: a tag, or what gives a match its tag or None; the group is replaced."""
        nonlocal out

        def one(m: re.Match) -> str:
            tag = kind if isinstance(kind, str) else kind(m)
            if not tag:
                return m[0]
            found[tag] += 1
            return m[0][: m.start(group) - m.start()] + f"<{tag}>" + m[0][m.end(group) - m.start() :]

        out = pattern.sub(one, out)

    count = lambda text: sum(c.isdecimal() for c in text)
    mask(EMAIL, "EMAIL")
    mask(IBAN, lambda m: "IBAN" if mod97(m[0]) else None)
    mask(ID_KEYWORD, lambda m: None if count(m[2]) < 6 else "SSN" if m[1][0] in "sS" else "ID", 2)
    mask(ID_CUE, "ID", 2)
    mask(PHONE_KEYWORD, lambda m: "PHONE" if count(m[1]) >= 7 else None, 1)
    mask(PHONE_CUE, lambda m: "PHONE" if 7 <= count(m[2]) <= 15 else None, 2)
    mask(PHONE_INTL, lambda m: "PHONE" if 7 <= count(m[0]) <= 15 else None)
    mask(CARD_GROUPED, card_or_id)
    mask(LONG_RUN, card_or_id)
    mask(CARD, lambda m: "CARD" if luhn(re.sub("[^0-9]", "", m[0])) else None)
    mask(INTERNATIONAL, lambda m: "PHONE" if 7 <= count(m[0]) <= 15 else None)
    mask(PHONE_NANP, "PHONE")
    mask(NANP, "PHONE")
    mask(PHONE_NATIONAL, "PHONE")
    mask(SSN_SEPARATED, "SSN")
    mask(SSN, "SSN")
    return PHONE_EXT.sub("<PHONE>", out), dict(found)


def scrub_secrets(text: str) -> str:
    """Keys and tokens out of trace text."""
    return SECRET.sub("<SECRET>", text)


def card_numbers(text: str) -> list[tuple[str, bool]]:
    """Digits of every card-shaped number of 13 to 19 digits, and whether they pass Luhn.

    Groups of 3 to 6 after one of 4, unbroken runs, and runs with single blanks or
    hyphens; of shapes that overlap the longest counts.
    """
    shapes = [(re.sub("[^0-9]", "", m[0]), *m.span()) for pattern in (CARD_GROUPED, LONG_RUN, CARD) for m in pattern.finditer(text)]
    found: list[tuple[int, int, str]] = []
    for digits, start, end in sorted(shapes, key=lambda x: -len(x[0])):
        if 13 <= len(digits) <= 19 and not any(s < end and start < e for s, e, _ in found):
            found.append((start, end, digits))
    return [(digits, luhn(digits)) for _, _, digits in sorted(found)]


def drop_sensitive(value, depth: int = 6, most: int = 50):
    """Nested trace fields without those named like a secret."""
    if depth < 0:
        return None
    if isinstance(value, dict):
        return {k: drop_sensitive(v, depth - 1, most) for k, v in list(value.items())[:most] if not any(s in str(k).lower() for s in SENSITIVE)}
    if isinstance(value, (list, tuple)):
        return [drop_sensitive(v, depth - 1, most) for v in value[:most]]
    return scrub_secrets(value) if isinstance(value, str) else value


SCRUBBED = T.StructType([T.StructField("text", T.StringType()), T.StructField("findings", T.MapType(T.StringType(), T.IntegerType())), T.StructField("truncated", T.BooleanType())])


@F.pandas_udf(SCRUBBED)
def scrubbed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """scrub() over Arrow batches."""
    for part in parts:
        done = [scrub(t) if t is not None else Scrubbed("") for t in part]
        yield pd.DataFrame({"text": [d.text for d in done], "findings": [d.findings for d in done], "truncated": [d.truncated for d in done]})


@F.pandas_udf(T.StringType())
def without_secrets(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """scrub_secrets() over Arrow batches; null stays null."""
    for part in parts:
        yield part.map(lambda t: scrub_secrets(t) if t is not None else None)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("digits", T.StringType()), T.StructField("valid", T.BooleanType())])))
def cards(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """card_numbers() over Arrow batches."""
    for part in parts:
        yield part.map(lambda t: [{"digits": d, "valid": v} for d, v in card_numbers(t or "")])
