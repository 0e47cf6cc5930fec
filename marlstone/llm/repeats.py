"""Operator 9: passages that repeat from documents with a smaller id.

Every byte that lies in a ``WIDTH``-byte string which also starts in a document
with a smaller doc_id is removed.  Sorting all suffixes of a corpus would move
every byte fifty times, so the suffixes that can matter are found first:

1. Each window of WIDTH bytes has a fingerprint: the smallest hash among its
   ``GRAM``-byte grams.  Equal windows have equal fingerprints, and about one
   position in eighteen carries one.  Map tasks send the distinct fingerprints of
   each block of documents, by hash range; owners answer which of them occur in
   more than one document.  Fingerprints decide only what is not sorted: a window
   whose fingerprint no other document has cannot repeat.
2. Consecutive windows with the same shared fingerprint form a segment of at
   most 2 * WIDTH - GRAM bytes.  Blocks send their distinct segments, packed,
   with the smallest doc_id that holds each, to the owner of the fingerprint's range.
   A fingerprint in more than ``HOT_BLOCKS`` blocks that together hold more than
   ``HOT_SEGMENTS`` segments of it sends its windows one by one instead, to the owner
   of the window's own hash: a gram of very many contexts then spreads over all owners.
   That costs seventeen times the text, so a common passage alone does not do it: each
   block sends its segments once.
3. An owner lays segments of a range of fingerprints end to end, sorts the suffixes in two stages
   (``suffixes.py``), and takes neighbours whose common prefix reaches WIDTH as
   one group; the smallest doc_id of a group decides which windows repeat.
4. The answers return to the blocks, which cut their documents.

Documents travel packed by block.  Segments go from blocks to owners in one
shuffle and are never written besides; where they stand rides along to the
answers.  The tables between the other steps lie in the shared folder, and are
removed once the next one is written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepare, stored, texts_as_bytes
from .neardup import mixed
from .suffixes import eight_bytes, reaches, suffix_order

WIDTH, GRAM = 50, 16
SPAN = WIDTH - GRAM + 1
#: Fingerprints whose owner is one bucket: rows between blocks and owners stay long.
BUCKET_PRINTS = 1_000_000
#: Segments that an owner sorts at once, and more only while their fingerprint is one.
SORTED = 16_000
#: Bytes of text in a block (or one document): larger blocks send what they repeat
#: themselves once, in fewer and longer rows; a task holds a few times as much.
BLOCK_BYTES = 3 << 20
#: Windows of a text whose fingerprints are computed at once.
STRETCH = 1 << 20
HOT_BLOCKS = 200
#: Segments of one fingerprint, summed over blocks, that an owner may meet: 1.3 MB of text.
HOT_SEGMENTS = 20_000
#: Stands for a null doc_id: such rows come after all others.
LAST = (1 << 63) - 1
#: Never part of UTF-8: ends a segment.
END = b"\xff"

_U = np.uint64
_C1, _C2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)

SCHEMA = "kind int, blk long, ord int, doc_id long, a binary, b binary, c binary, d binary"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
DOC, PRINTS, SHARED, SEGMENTS, PLACES, ANSWERS = range(6)


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one fingerprint: fingerprint, first window, number of windows.

    A long text goes through in stretches: a run may then come in two parts.
    """
    parts = [(p, first + at, n) for at in range(0, max(0, len(text) - WIDTH + 1), STRETCH) for p, first, n in [_windows(text[at : at + STRETCH + WIDTH - 1])]]
    if not parts:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 2
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _windows(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(text) - WIDTH + 1
    eight = eight_bytes(np.frombuffer(text, np.uint8), 8)
    grams = len(text) - GRAM + 1
    h = mixed(eight[:grams] * _C1 + mixed(eight[8 : 8 + grams] * _C2))
    key = (h & ~_U(0xFFFF)) | (np.arange(grams, dtype=np.uint64) & _U(0xFFFF))
    span = 1
    while span * 2 <= SPAN:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[:n], key[SPAN - span : SPAN - span + n])
    first = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    # Smallest hashes lie near zero: spread again, so that owners of ranges have equal shares.
    return mixed(key[first] >> _U(16)) >> _U(16), first, np.diff(np.append(first, n))


def contexts(text: bytes, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash for each run's length and the bytes at both of its ends: different only for different segments."""
    t = np.frombuffer(text, np.uint8)
    ends = [np.ascontiguousarray(t[at[:, None] + np.arange(8)]).view(np.uint64)[:, 0] for at in (first, first + n + WIDTH - 9)] if len(first) else [np.empty(0, np.uint64)] * 2
    return mixed(ends[0] * _C1 + mixed(ends[1] * _C2 + n.astype(np.uint64)))


def packed(data: bytes, level: int = 3) -> bytes:
    return pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def unpacked(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def table(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(TYPES)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def grouped(batches: Iterator[pa.RecordBatch], column: str, fn: Callable) -> Iterator[pa.RecordBatch]:
    """Call fn(rows as dicts) for each run of equal values in a sorted column."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[column] != at and held:
                yield from fn(held)
                held = []
            at = row[column]
            held.append(row)
    if held:
        yield from fn(held)


def packed_docs(blk: int, docs: list[tuple]) -> tuple:
    """A block's documents as one row: ``ord`` counts them, ``doc_id`` their bytes."""
    body = b"".join(text for _, text in docs)
    numbers = np.array([(len(text), doc_id or 0, doc_id is None) for doc_id, text in docs], np.int64)
    return (DOC, blk, len(docs), len(body), packed(body), packed(np.ascontiguousarray(numbers.T).tobytes()), None, None)


def unpacked_docs(rows: list[dict]) -> list[tuple]:
    """doc_id and text of a block's documents, in their order."""
    found = []
    for r in rows:
        if r["kind"] == DOC:
            sizes, ids, null = np.frombuffer(unpacked(r["b"], 24 * r["ord"]), np.int64).reshape(3, -1)
            body, ends = unpacked(r["a"], r["doc_id"]), np.cumsum(sizes)
            found += [(None if x else i, body[e - n : e]) for i, x, e, n in zip(ids.tolist(), null.tolist(), ends.tolist(), sizes.tolist(), strict=True)]
    return found


def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1, by block: one row of documents, and one of distinct fingerprints."""
    blk = TaskContext.get().partitionId() << 32
    size, prints, owners, about, docs = 0, [], [], [], []

    def summary() -> tuple:
        p = np.concatenate(prints)
        owner = np.repeat(np.array(owners, np.int64), [len(x) for x in prints])
        order = np.lexsort((owner, p))
        p, owner = p[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.empty(0, np.int64)
        last = np.append(first[1:], len(p)) - 1
        several = owner[first] != owner[last] if len(p) else np.empty(0, bool)
        # How many different segments the block has of each, as far as a byte holds.
        context = np.concatenate(about)[np.lexsort((np.concatenate(about), np.concatenate(prints)))]
        fresh = np.ones(len(p), np.int64)
        fresh[1:] = (p[1:] != p[:-1]) | (context[1:] != context[:-1])
        many = np.minimum(np.add.reduceat(fresh, first), 127) if len(p) else np.empty(0, np.int64)
        told = (2 * many + several).astype(np.uint8)
        steps = np.diff(p[first], prepend=_U(0))
        return (PRINTS, blk, len(first), None, packed(steps.tobytes()), packed(told.tobytes()), None, None)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
            if prints and size + len(text) > BLOCK_BYTES:
                yield table([packed_docs(blk, docs), summary()])
                blk, size, prints, owners, about, docs = blk + 1, 0, [], [], [], []
            docs.append((doc_id, text))
            fps, first, n = windows(text)
            prints.append(fps)
            about.append(contexts(text, first, n))
            owners.append(LAST if doc_id is None else doc_id)
            size += len(text)
    if prints:
        yield table([packed_docs(blk, docs), summary()])


def bucket_of(prints: np.ndarray, buckets: int) -> np.ndarray:
    """48-bit fingerprints by range; ascending with the fingerprint."""
    return (((prints >> _U(16)) * _U(buckets)) >> _U(32)).astype(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's fingerprints cut by owner: ``ord`` is the bucket.

    32 bits of them travel: two that agree there, in one bucket, only send a
    segment in vain.
    """
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if not row["ord"]:
                continue
            p, several = np.cumsum(np.frombuffer(unpacked(row["a"], 8 * row["ord"]), np.uint64), dtype=np.uint64), unpacked(row["b"], row["ord"])
            bucket = bucket_of(p, buckets)
            cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(p)]
            rows += [(PRINTS, row["blk"], int(bucket[i]), None, p[i:j].astype(np.uint32).tobytes(), several[i:j], None, None) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        yield table(rows)


def shared_prints(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """An owner's answer to each block: 0 unique, 1 shared, 2 in very many blocks and segments."""
    prints = [np.frombuffer(r["a"], np.uint32) for r in rows]
    every, back, blocks = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    told = np.frombuffer(b"".join(r["b"] for r in rows), np.uint8)
    several = np.zeros(len(every), bool)
    several[back[told % 2 > 0]] = True
    held = np.bincount(back, told // 2, len(every))
    state = (several | (blocks > 1)).astype(np.uint8) + ((blocks > HOT_BLOCKS) & (held > HOT_SEGMENTS))
    ends = np.cumsum([len(p) for p in prints])
    yield table([(SHARED, r["blk"], r["ord"], None, s.tobytes(), None, None, None) for r, s in zip(rows, np.split(state[back], ends[:-1]), strict=True)])


def segments(rows: list[dict], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 2: a block's distinct segments by owner, and where they stand, by any
    owner (``doc_id`` counts the places)."""
    state = np.frombuffer(b"".join(r["a"] for r in rows if r["kind"] == SHARED), np.uint8)
    docs = unpacked_docs(rows)
    blk = rows[0]["blk"]
    runs = [windows(text) for _, text in docs]
    every = np.unique(np.concatenate([r[0] for r in runs])) if runs else np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    bucket: list[int] = []
    prints: list[int] = []
    least: list[int] = []
    places: list[tuple[int, int, int, int]] = []

    def add(piece: bytes, fp: int, at: int, n: int, ord_: int) -> None:
        owner = LAST if docs[ord_][0] is None else docs[ord_][0]
        e = known.setdefault(piece, len(known))
        if e == len(prints):
            prints.append(fp)
            least.append(owner)
        elif owner < least[e]:
            least[e] = owner
        places.append((e, ord_, at, n))

    for ord_, ((_, text), (fps, first, n)) in enumerate(zip(docs, runs, strict=True)):
        flag = state[np.searchsorted(every, fps)]
        use = np.flatnonzero(flag)
        for f, s, at, k in zip(flag[use].tolist(), fps[use].tolist(), first[use].tolist(), n[use].tolist(), strict=True):
            if f == 1:
                add(text[at : at + k + WIDTH - 1], s, at, k, ord_)
            else:
                for j in range(at, at + k):
                    piece = text[j : j + WIDTH]
                    add(piece, xxhash.xxh64_intdigest(piece) >> 16, j, 1, ord_)
    if not known:
        return
    p = np.array(prints, np.uint64)
    bucket = bucket_of(p, buckets)
    order = np.argsort(p, kind="stable")
    pieces, ids = list(known), np.array(least, np.int64)
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    out = []
    for part in np.split(order, cut):
        own = [pieces[i] for i in part.tolist()]
        out.append((SEGMENTS, blk, int(bucket[part[0]]), None, packed(b"".join(own), 9), np.array([len(x) for x in own], np.uint8).tobytes(), packed(ids[part].tobytes()), packed(np.diff(p[part].astype(np.uint32), prepend=np.uint32(0)).tobytes())))
    place = np.array(places, np.int32).reshape(-1, 4)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    place[:, 0] = rank[place[:, 0]]
    place[:, 2] = np.diff(place[:, 2], prepend=np.int32(0))
    out.append((PLACES, blk, ((blk >> 32) + (blk & 0xFFFFFFFF)) % buckets, len(place), packed(np.ascontiguousarray(place.T).tobytes()), None, None, None))
    for i in range(0, len(out), 64):
        yield table(out[i : i + 64])


def repeated_windows(pieces: list[bytes], owner: np.ndarray) -> np.ndarray:
    """Per segment, a bit for each window that a smaller owner's segment holds."""
    if not pieces:
        return np.empty(0, np.int64)
    t = np.frombuffer(END.join(pieces) + END, np.uint8)
    sizes = np.array([len(x) for x in pieces])
    starts = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - WIDTH + 1
    valid = np.zeros(len(t), bool)
    seg = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    inside = (np.arange(len(t)) - starts[seg]).astype(np.int32)
    valid[inside < counts[seg]] = True
    keys = eight_bytes(t)
    order = suffix_order(t, keys)
    order = order[valid[order]]
    group = np.cumsum(~reaches(order, keys, WIDTH)) - 1
    own = owner[seg[order]]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(own, first)[group]
    hit = order[least < own]
    mask = np.zeros(len(pieces), np.int64)
    np.add.at(mask, seg[hit], np.int64(1) << inside[hit].astype(np.int64))
    return mask


def answers(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Step 3, by owner: each segment's smallest doc_id and its repeated windows; places pass."""
    passing = [r for r in rows if r["kind"] == PLACES]
    for r in passing:
        yield table([tuple(r[c] for c in NAMES)])
    rows = [r for r in rows if r["kind"] == SEGMENTS]
    if not rows:
        return
    known: dict[bytes, int] = {}
    entry: list[int] = []
    counts = []
    for r in rows:
        ends = np.cumsum(np.frombuffer(r["b"], np.uint8).astype(np.int64)).tolist()
        at, body = 0, unpacked(r["a"], ends[-1])
        for end in ends:
            entry.append(known.setdefault(body[at:end], len(known)))
            at = end
        counts.append(len(ends))
    e = np.array(entry, np.int64)
    least = np.full(len(known), LAST, np.int64)
    np.minimum.at(least, e, np.frombuffer(b"".join(unpacked(r["c"], 8 * len(r["b"])) for r in rows), np.int64))
    prints = np.zeros(len(known), np.uint32)
    prints[e] = np.concatenate([np.cumsum(np.frombuffer(unpacked(r["d"], 4 * len(r["b"])), np.uint32), dtype=np.uint32) for r in rows])
    _, back, alike = np.unique(prints, return_inverse=True, return_counts=True)
    several = np.flatnonzero(alike[back] > 1)  # alone, a segment has nothing to be compared with
    pieces = list(known)
    mask = np.zeros(len(known), np.int64)
    several = several[np.argsort(prints[several], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], prints[several][1:] != prints[several][:-1]])) if len(several) else np.empty(0, np.int64)
    cuts = first[np.flatnonzero(np.diff(first // SORTED, prepend=0))]
    for part in np.split(several, cuts):
        mask[part] = repeated_windows([pieces[i] for i in part.tolist()], least[part])
    cut = np.cumsum(counts)[:-1]
    done = zip(rows, np.split(least[e], cut), np.split(mask[e], cut), strict=True)
    yield table([(ANSWERS, r["blk"], r["ord"], None, m.tobytes(), w.tobytes(), None, None) for r, m, w in done])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cut_documents(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Step 4, by block: remove the bytes that repeated windows cover."""
    docs = unpacked_docs(rows)
    sizes = np.array([len(text) for _, text in docs])
    starts = np.cumsum(sizes + 1) - sizes - 1
    change = np.zeros(int(sizes.sum()) + len(docs) + 1, np.int32)
    places = [r for r in rows if r["kind"] == PLACES]
    if places:
        back = [r for r in rows if r["kind"] == ANSWERS]
        least = np.frombuffer(b"".join(r["a"] for r in back), np.int64)
        mask = np.frombuffer(b"".join(r["b"] for r in back), np.int64)
        e, ord_, at, n = np.frombuffer(unpacked(places[0]["a"], 16 * places[0]["doc_id"]), np.int32).reshape(4, -1).astype(np.int64)
        at = np.cumsum(at)
        owner = np.array([LAST if doc_id is None else doc_id for doc_id, _ in docs], np.int64)[ord_]
        at = at + starts[ord_]
        whole = owner > least[e]
        np.add.at(change, at[whole], 1)
        np.add.at(change, at[whole] + n[whole] + WIDTH - 1, -1)
        some = np.flatnonzero(~whole & (mask[e] != 0))
        for bit in range(SPAN):
            on = at[some[(mask[e[some]] >> bit) & 1 == 1]] + bit
            np.add.at(change, on, 1)
            np.add.at(change, on + WIDTH, -1)
    gone = np.cumsum(change) > 0
    ids, removed, spans, kept = [], [], [], []
    for (doc_id, text), start, size in zip(docs, starts.tolist(), sizes.tolist(), strict=True):
        own = gone[start : start + size]
        n = int(own.sum())
        ids.append(doc_id)
        removed.append(n)
        spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
        kept.append(np.frombuffer(text, np.uint8)[~own].tobytes() if n else text)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=[x.split()[0] for x in RESULT.split(", ")])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """What is left of every text: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    One row per input row.  A null text counts as empty.  Texts below WIDTH
    bytes lose nothing.  Rows with equal doc_ids are one document: they take
    nothing from each other.  A null doc_id counts as larger than any other
    (and equal to other nulls).  Other columns are ignored; an empty table
    gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = stored(plain.mapInArrow(profile, SCHEMA), "repeat-blocks", ("kind",))
    typed = lambda frame, kind: frame.where(F.col("kind") == kind).select(*NAMES)
    if not blocks.take(1):
        return spark.createDataFrame([], RESULT)
    total = typed(blocks, PRINTS).agg(F.sum(F.col("ord").cast("long"))).first()[0] or 0
    buckets = max(1, parts, -(-total // BUCKET_PRINTS))
    owned = lambda frame: frame.repartitionById(parts, F.col("ord") % parts).sortWithinPartitions("ord", "blk")
    turn = (F.shiftright("blk", 32) + F.col("blk").bitwiseAND((1 << 32) - 1)) % parts
    by_block = lambda frame: frame.repartitionById(parts, turn.cast("int")).sortWithinPartitions("blk", "kind", "ord")

    cut = typed(blocks, PRINTS).mapInArrow(lambda it: sliced(it, buckets), SCHEMA)
    shared = stored(owned(cut).mapInArrow(lambda it: grouped(it, "ord", shared_prints), SCHEMA), "repeat-shared")
    discard(blocks, f"kind={PRINTS}")
    found = by_block(typed(blocks, DOC).unionByName(shared)).mapInArrow(lambda it: grouped(it, "blk", lambda rows: segments(rows, buckets)), SCHEMA)
    back = stored(owned(found).mapInArrow(lambda it: grouped(it, "ord", answers), SCHEMA), "repeat-answers")
    discard(shared)
    return by_block(typed(blocks, DOC).unionByName(back)).mapInArrow(lambda it: grouped(it, "blk", cut_documents), RESULT)
