"""Operator 4: exact duplicates by an extendible-hash index on shared files.

* Every text is normalised (A-Z to a-z) and hashed to a 64-bit key.  Within a
  map task equal texts are combined before anything moves, so a group of
  copies sends one entry per task, however large it is.
* The directory maps a key's leading bits to a bucket.  It starts with one
  bucket and doubles whenever an overfull bucket's local depth has reached the
  directory's depth; only the overfull bucket splits.  Its shape follows from
  counts by key prefix (at most ``2 ** PREFIX_BITS`` numbers) in one pass; beyond
  ``BUCKETS * CAPACITY`` texts buckets grow instead, so its size stays bounded.
* Buckets are numbered in key order, and every owner task has a run of them: a
  contiguous key range.  It chains entries whose keys collide and compares their
  bytes, and writes the buckets' groups to the index files in the shared folder.
* The rows look their group up by the digest of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, texts_as_bytes

#: Leading bits of a key by which entries are counted, and so the directory's
#: greatest depth; keys are hashes, so a bucket comes nowhere near it.
PREFIX_BITS = 20
#: Entries a bucket holds before it splits, as long as that takes BUCKETS at most.
CAPACITY, BUCKETS = 1024, 1 << 16
#: Bytes of text that a map task holds to combine copies before it sends them.
COMBINE_BYTES = 24 << 20

ENTRY_SCHEMA = "bucket int, key long, sha binary, keep_id long, keep_row long, size long, body binary"
GROUP_SCHEMA = "bucket int, key long, chain int, sha binary, keep_id long, keep_row long, group_size long"


def normalised(text: bytes) -> bytes:
    """ASCII letters in lower case, every other byte as it is."""
    return text.lower()


def key_of(text: bytes) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text), "big", signed=True)


def slot(key: int, depth: int) -> int:
    """The leading ``depth`` bits of a key."""
    return (key & 0xFFFFFFFFFFFFFFFF) >> (64 - depth) if depth else 0


class Directory:
    """An extendible-hash directory: slot -> bucket, by the leading ``depth`` bits.

    counts: entries by the leading bits of their key, a power of two of them.  A
    bucket splits while it holds more than ``capacity`` entries and the counts
    can tell its halves apart; the directory is as deep as its deepest bucket.
    """

    def __init__(self, counts: np.ndarray, capacity: int = CAPACITY):
        levels = [np.asarray(counts, np.int64)]
        while len(levels[0]) > 1:
            levels.insert(0, levels[0].reshape(-1, 2).sum(1))
        local = np.zeros(1, np.int8)  # of every slot, the depth of its bucket
        self.depth = 0
        while self.depth + 1 < len(levels) and (full := (local == self.depth) & (levels[self.depth] > capacity)).any():
            local = np.repeat(np.where(full, self.depth + 1, local), 2).astype(np.int8)
            self.depth += 1
        first = np.arange(len(local)) & ((1 << (self.depth - local.astype(np.int64))) - 1) == 0
        self.slots = (np.cumsum(first) - 1).astype(np.int32)
        self.local = local[first]

    def bucket(self, key: int) -> int:
        return int(self.slots[slot(key, self.depth)])

    @property
    def buckets(self) -> int:
        return len(self.local)


def larger(one: tuple, other: tuple) -> tuple:
    """The (doc_id, row) that stays: the larger doc_id, null below all, then the larger row."""
    rank = lambda x: (x[0] is not None, x[0] or 0, x[1] or 0)
    return max(one, other, key=rank)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, row, key, sha (SHA-256 of the normalised text) of every row, stored."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normalised(x) for x in texts_as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([key_of(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())],
                names=["doc_id", "row", "key", "sha"],
            )

    return stored(docs.mapInArrow(digest, "doc_id long, row long, key long, sha binary"), "exact-rows")


def entries(docs: DataFrame, directory: Broadcast, combine_bytes: int = COMBINE_BYTES) -> DataFrame:
    """bucket, key, sha, keep_id, keep_row, size, body: copies combined within each map task."""

    def rows(held: dict) -> pa.RecordBatch:
        where = directory.value
        full = [(where.bucket(key), key, hashlib.sha256(body).digest(), *keep, size, body) for (key, body), (keep, size) in held.items()]
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*full, strict=True), kinds, strict=True)], names=["bucket", "key", "sha", "keep_id", "keep_row", "size", "body"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        used = 0
        for batch in batches:
            for *own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_as_bytes(batch.column(2)), strict=True):
                body = normalised(text)
                at = (key_of(body), body)
                if at in held:
                    one = held[at]
                    one[0] = larger(one[0], tuple(own))
                    one[1] += 1
                else:
                    held[at] = [tuple(own), 1]
                    used += len(body) + 200
                if used >= combine_bytes:
                    yield rows(held)
                    held, used = {}, 0
        if held:
            yield rows(held)

    return docs.mapInArrow(combine, ENTRY_SCHEMA)


def directory_of(rows: DataFrame, capacity: int, prefix_bits: int = PREFIX_BITS) -> Directory:
    """The directory for the distinct keys of these rows."""
    prefix = F.shiftrightunsigned("key", 64 - prefix_bits).cast("int").alias("p")
    found = rows.select("key").distinct().groupBy(prefix).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(1 << prefix_bits, np.int64)
    counts[found["p"].to_numpy()] = found["n"].to_numpy()
    return Directory(counts, max(capacity, -(-int(counts.sum()) // BUCKETS)))


def build_index(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index files: one row per distinct text, grouped by bucket."""
    spark = docs.sparkSession
    directory = directory_of(rows, capacity)
    shared = spark.sparkContext.broadcast(directory)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries arrive by bucket and key: chain what collides."""
        at, chain, out = None, [], []

        def close() -> None:
            out.extend((*at, i, sha, *keep, size) for i, (_, sha, keep, size) in enumerate(chain))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["bucket", "key", "chain", "sha", "keep_id", "keep_row", "group_size"])

        for batch in batches:
            for bucket, key, sha, *keep, size, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, key) != at:
                    if at is not None:
                        close()
                    at, chain = (bucket, key), []
                for link in chain:
                    if link[0] == body:
                        link[2] = larger(link[2], tuple(keep))
                        link[3] += size
                        break
                else:
                    chain.append([body, sha, tuple(keep), size])
            if len(out) >= 4096:
                yield batch_of()
                out = []
        if at is not None:
            close()
        if out:
            yield batch_of()

    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), directory.buckets))
    owner = F.floor(F.col("bucket").cast("long") * parts / directory.buckets).cast("int")
    owned = entries(docs, shared).repartitionById(parts, owner).sortWithinPartitions("bucket", "key")
    return stored(owned.mapInArrow(own, GROUP_SCHEMA), "exact-index")


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY, row: Column | None = None) -> DataFrame:
    """Group equal texts; of each group the row with the largest doc_id stays.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty.  Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256 (hex digest of the normalised text).  Rows with a null doc_id
    are members of their group but stay only if the whole group's ids are null
    (all its rows then have keep_id null and kept true for each); rows that
    repeat the kept doc_id are all kept.  ``row``, a number that no two rows
    share, adds ``row`` and ``first``: true for exactly one row of each group,
    of the largest doc_id and then number.  Other columns are ignored; an empty
    table gives an empty result.
    """
    prepare(docs.sparkSession)
    given = F.lit(None).cast("long") if row is None else row.cast("long")
    plain = docs.select(F.col("doc_id").cast("long"), given.alias("row"), F.col("text").cast("string"))
    rows = digests(plain)
    index = build_index(plain, rows, capacity)
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")]
    if row is not None:
        columns += ["row", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).alias("first")]
    return rows.select("doc_id", "row", "sha").join(index.select("sha", "keep_id", "keep_row", "group_size"), "sha").select(*columns)
