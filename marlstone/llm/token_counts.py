"""Operator 1: token counts by a two-tier lookup on the map side.

Tier one is a compact hash table of frequent pre-tokens and their lengths in
tokens, broadcast once.  A first pass finds them: each task counts its
pre-tokens in a sketch of bounded size (the smallest counts give way when it is
full), the sketches' heaviest entries are added up, and the ``TABLE`` heaviest
of the corpus are encoded.  Tier two is a bounded cache of two generations in
each Python worker; what neither tier knows is encoded by the tokenizer library.
No text and no pre-token of the count is shuffled, only the sketches' entries.
The table decides the speed alone, never a length.

Texts of Latin code points are cut here as the tokenizer's own normaliser and
pre-tokenizer cut them (lower case, contractions, runs of letters, single
digits, runs of signs).  Any other text is cut at the space character, across
which neither of them looks: its Latin pieces go the same way, other pieces are
looked up and encoded whole.  A text that holds a special-token marker is
encoded whole, as the library's default treats it.  A tokenizer of another
build is used by pieces between spaces only.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_lengths, prepare, texts_as_str, worker_cache

#: Pre-tokens in the broadcast table, in a task's sketch, and sent by a task.
TABLE, SKETCH, SENT = 50_000, 200_000, 16_000
#: Bound of a generation of a worker's cache, beyond the broadcast table.
CACHE_PIECES = 200_000
#: Longer pieces are encoded each time and never cached.
CACHE_CHARS = 48

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: Printable code points below U+0180 but one, and ASCII white space.  Their classes and
#: lower case are the same in every Unicode version, and none composes.
LATIN = re.compile("[\t-\r -~\xa0-\u012f\u0131-\u017f]*")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \xa0{_LETTERS}{_NUMBERS}]+")
#: The normaliser and pre-tokenizer that LATIN and PRE_TOKEN stand for.
KNOWN_NORMALIZER = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_alike(tokenizer_path: str) -> bool:
    """Whether the tokenizer file cuts text as PRE_TOKEN does."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    normalizer = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
    return normalizer == KNOWN_NORMALIZER and split[:1] == [KNOWN_SPLIT]


def cut(text: str, alike: bool) -> tuple[list[str], list[str]]:
    """A text's pre-tokens, and the pieces that only the library may cut."""
    if alike and LATIN.fullmatch(text):
        return PRE_TOKEN.findall(text.lower()), []
    pieces = text.split(" ")
    if not alike:
        return [], pieces
    latin = " ".join(x for x in pieces if LATIN.fullmatch(x))
    return PRE_TOKEN.findall(latin.lower()), [x for x in pieces if not LATIN.fullmatch(x)]


class Sketch(Counter):
    """Counts of frequent pieces in bounded room: beyond it, all counts lose the
    smallest one that stays, so a count is short by at most total / (SKETCH / 2)."""

    def add(self, pieces: list[str]) -> None:
        self.update(pieces)
        if len(self) > SKETCH:
            kept = self.most_common(SKETCH // 2 + 1)
            least = kept[-1][1]
            self.clear()
            dict.update(self, {k: n - least for k, n in kept if n > least})


def frequent_lengths(docs: DataFrame, tokenizer_path: str, alike: bool) -> dict[str, int]:
    """The corpus's heaviest pre-tokens (pieces, for other tokenizers) and their lengths."""
    from tokenizers import Tokenizer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for batch in batches:
            for text in texts_as_str(batch.column(0)):
                if "<|" not in text:
                    for part in cut(text, alike):
                        sketch.add(part)
        heavy = [(k, n) for k, n in sketch.most_common(SENT) if len(k) <= CACHE_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in heavy], pa.string()), pa.array([n for _, n in heavy], pa.int64())], names=["piece", "n"])

    counts = docs.select(F.col("text").cast("string")).mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    words = [r.piece for r in counts.orderBy(F.desc("n"), "piece").limit(TABLE).collect()]
    tokenizer = Tokenizer.from_file(tokenizer_path)
    return {w: len(e.ids) for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True)}


class PieceLengths(dict):
    """Lengths by pre-token or piece; a miss is encoded and, within bounds, remembered."""

    def __init__(self, tokenizer_path: str, table: dict[str, int], alike: bool):
        from tokenizers import Tokenizer

        super().__init__(table)
        self.table, self.before, self.alike = table, {}, alike
        self.tokenizer = Tokenizer.from_file(tokenizer_path)

    def __missing__(self, piece: str) -> int:
        n = self.before.get(piece)
        if n is None:
            n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= len(self.table) + CACHE_PIECES:
                self.before = dict(self)
                self.clear()
                self.update(self.table)
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if "<|" in text:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(sum(map(self.__getitem__, part)) for part in cut(text, self.alike))


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """Count the tokens of every whole text.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit),
    one row per input row.  A null text counts as empty: 0 bytes, 0 tokens.
    Null and repeated doc_ids pass through; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    alike = cuts_alike(tokenizer_path)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, alike))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_cache(f"lengths {tokenizer_path}", lambda: PieceLengths(tokenizer_path, table.value, alike))
        for batch in batches:
            text = batch.column(1)
            n = [counter.count(x) for x in texts_as_str(text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), byte_lengths(text), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, SCHEMA)
