"""Operator 10: concatenate token streams and cut them into fixed windows.

Pass one tokenizes every text once and writes the ids, with each document's
offset inside its partition, to the shared folder.  One total per partition
goes to the driver, whose prefix sums give every partition its global offset.
Pass two reads the ids, adds the offset, and cuts at multiples of the window;
the pieces on both sides of a cut are the boundary records.  No shuffle moves
token ids: the only aggregate is one row per partition.

Most of the time goes to pieces of text not met before.  Where the tokenizer file
describes byte-level merges in the order of their ids, as rank files do, such a
piece is encoded from those ranks, which costs a third of a library call for the
same ids; whole texts, and files of another kind, go to the library.

All sequences but the last are full.  ``padded_length`` says what a sequence is
padded to: the window, except that a length that is a power of two stays.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, texts_as_str, worker_cache

WINDOW = 2048
END_ID = 1
CACHE_PIECES = 400_000
CACHE_CHARS = 48

#: A space inside a run of white space, or one that ends such a run and the
#: text, may share a pre-token with its neighbours: such texts are encoded whole.
_JOINED_SPACE = re.compile(r"\s (?:\s|\Z)")

IDS_SCHEMA = "part int, local_start long, doc_id long, n long, ids binary"
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def padded_length(n: int, window: int = WINDOW) -> int:
    """What a sequence of n tokens is padded to."""
    return n if n > 0 and n & (n - 1) == 0 else window


#: Fixed value: the split of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others follow from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def by_ranks(tokenizer_path: str) -> Callable[[str], list[int]] | None:
    """An encoder of pieces by merge ranks; None if the file is of another kind."""
    import tiktoken

    with open(tokenizer_path, encoding="utf-8") as f:
        said = json.load(f)
    model, split = said["model"], said["pre_tokenizer"] or {}
    if said["normalizer"] or model["type"] != "BPE" or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        return None
    if model.get("dropout") or model.get("unk_token") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
        return None
    vocab, byte = model["vocab"], byte_of_char()
    merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    special = {t["content"] for t in said["added_tokens"]}
    if merged != sorted(merged) or len(set(merged)) != len(merged) or any(c not in byte for w in vocab if w not in special for c in w):
        return None
    ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}
    if len(ranks) != len(merged) + 256:
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PieceIds(dict):
    """Packed ids by piece; a piece stands for itself after a space."""

    def __init__(self, tokenizer_path: str, dtype: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        self.piece = by_ranks(tokenizer_path) or self.whole
        self.code = "H" if dtype == "<u2" else "I"

    def encode(self, text: str) -> bytes:
        return array.array(self.code, self.whole(text)).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = array.array(self.code, self.piece(" " + piece)).tobytes()
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The ids of a whole text.

        Byte-level pre-tokens that hold a space begin with it, so a text may be
        cut before every space that stands alone; the rest is encoded whole.
        """
        if "<|" in text or _JOINED_SPACE.search(text):
            return self.encode(text)
        pieces = text.split(" ")
        head = array.array(self.code, self.piece(pieces[0])).tobytes()
        return head + b"".join(map(self.__getitem__, pieces[1:]))


def id_dtype(tokenizer_path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Pass one: part, local_start, doc_id, n, ids of every text, stored."""
    prepare(docs.sparkSession)
    dtype = id_dtype(tokenizer_path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache(f"ids {tokenizer_path}", lambda: PieceIds(tokenizer_path, dtype))
        end, width = np.array([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [encoder.ids(x) + end for x in texts_as_str(batch.column(1))]
            n = np.array([len(x) // width for x in ids], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), batch.column(0), pa.array(n), pa.array(ids, pa.binary())],
                names=["part", "local_start", "doc_id", "n", "ids"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, IDS_SCHEMA)
    return stored(rows, "token-ids")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens.

    A document is the ids of its text followed by ``end_id``.  Returns one row
    per piece: doc_id, start (the document's ids before it), length, ids_crc32
    (of the ids as little-endian unsigned 32-bit numbers), doc_tokens (with the
    end id), sequence_id, offset.  A null or empty text is the end id alone;
    rows are packed as they are, so null and repeated doc_ids are pieces of
    their own; other columns are ignored; an empty table gives no piece.
    """
    spark = docs.sparkSession
    table = token_table(docs, tokenizer_path, end_id)
    dtype = id_dtype(tokenizer_path)
    totals = sorted(table.groupBy("part").agg(F.max(F.col("local_start") + F.col("n"))).collect())
    ends = np.cumsum([t for _, t in totals], dtype=np.int64)
    offsets = spark.sparkContext.broadcast({p: int(e) - t for (p, t), e in zip(totals, ends, strict=True)})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = offsets.value
        for batch in batches:
            out: list[tuple] = []
            for part, local, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = before[part] + local
                wide = memoryview(np.frombuffer(ids, dtype).astype("<u4").tobytes())
                done = 0
                while done < n:
                    offset = (at + done) % window
                    length = min(n - done, window - offset)
                    out.append((doc_id, done, length, zlib.crc32(wide[4 * done : 4 * (done + length)]), n, (at + done) // window, offset))
                    done += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7,
                names=[x.split()[0] for x in PIECES_SCHEMA.split(", ")],
            )

    return table.mapInArrow(cut, PIECES_SCHEMA)
