"""Operator 3: near duplicates by one-permutation hashing.

1. A text's words (A-Z lowered, cut at ASCII white space) give its set of
   distinct 5-word shingles, as 64-bit hashes; a text of fewer words is one
   shingle.  Equal sets are one node, so copies cost nothing further.
2. One permutation: the hash range is divided into ``BINS`` bins and each keeps
   its smallest hash.  Optimal densification fills an empty bin from the first
   occupied bin in a random order of its own, the same for every document.
3. ``BANDS`` bands of ``ROWS`` bins are hashed into bucket keys.  In a bucket
   every node is paired with one centre only: a star, so pairs grow with the rows
   of a bucket, not with their square.  The centre is the node that meets most
   others over all its buckets: of a family that is a text near its middle, the
   same in most buckets, so a node has few pairs and most of them are links.
4. Pairs are confirmed on the full sets, and the links contracted to
   components by alternating large and small stars.
5. A text may be similar to members of a bucket but not to its centre.  Buckets
   that still span components take ``TURNS`` more stars, each around a node drawn
   by a hash of bucket and star, sooner the more others it meets, so the buckets of
   one family try several centres and pairs stay below the rows of the buckets.
6. What no star links is settled exactly, over the nodes of buckets that still
   span components: every pair of sets that reaches the similarity shares a shingle among the
   rarest of either, and its place there bounds how much they can share.  Only
   pairs of different components that pass that bound are tested, and of a
   bucket's largest component no two members meet.

No link is left out but for a pair that shares no bucket at all: at similarity
0.85 that has probability (1 - 0.85 ** 6) ** 40, under 1e-8; at 0.8, under 1e-5.  Buckets are
joined, never gathered, so a hot bucket can be split between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, prepare, stored, texts_as_bytes, worker_cache

WORDS = 5
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
#: A link: 100 * intersection >= SIMILARITY * union.
SIMILARITY = 85
#: Further stars before the exact search.  More of them only leave it less to do.
TURNS = 3
CACHE_WORDS = 200_000
SEED = 11

_U = np.uint64
_RNG = np.random.default_rng(SEED)
_POSITION = _RNG.integers(1, 1 << 63, WORDS, dtype=np.uint64) * _U(2) + _U(1)
_ROW = _RNG.integers(1, 1 << 63, ROWS, dtype=np.uint64) * _U(2) + _U(1)
_BAND = _RNG.integers(1, 1 << 63, BANDS, dtype=np.uint64)
#: Row b: the order in which an empty bin b looks at the others.
_ORDER = np.argsort(_RNG.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.uint16)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hashes by word, remembered within bounds."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 48:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h



def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(worker_cache("words", WordHashes).__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - WORDS + 1)
    total = np.full(n, len(words) if len(words) < WORDS else WORDS, np.uint64)
    for i in range(min(WORDS, len(words))):
        total += mixed(h[i : i + n] * _POSITION[i])
    return np.unique(mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One hash per bin from sorted distinct hashes (at least one)."""
    bins = ((hashes >> _U(32)) * _U(BINS) >> _U(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    own = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[own] = hashes[first]
    if len(own) < BINS:
        empty = np.ones(BINS, bool)
        empty[own] = False
        at = np.flatnonzero(empty)
        out[at] = out[own[_ORDER[at][:, own].argmin(1)]]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed((mixed(sig.reshape(BANDS, ROWS)) * _ROW).sum(1) + _BAND)


def similar(a: np.ndarray, b: np.ndarray, similarity: int = SIMILARITY) -> bool:
    """Whether two sorted distinct arrays reach the similarity (in hundredths)."""
    if 100 * min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= similarity * (len(both) - common)


ROW_SCHEMA = "rid long, doc_id long, given long, n long, s1 long, s2 long, bands binary, text binary"


def profiled(docs: DataFrame, row: Column | None) -> DataFrame:
    """Every row with a row number, its set's size and fingerprint, its bands; stored."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 34
        for batch in batches:
            texts = texts_as_bytes(batch.column(2))
            sets = [shingles(x) for x in texts]
            prints = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets]
            bands = [band_keys(signature(s)).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(rid, rid + len(sets))), batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(p[0]) for p in prints], pa.int64()), pa.array([int(p[1]) for p in prints], pa.int64()),
                    pa.array(bands, pa.binary()), pa.array(texts, pa.binary()),
                ],
                names=[x.split()[0] for x in ROW_SCHEMA.split(", ")],
            )
            rid += len(sets)

    given = F.lit(None).cast("long") if row is None else row.cast("long")
    return stored(docs.select(F.col("doc_id").cast("long"), given.alias("given"), F.col("text").cast("string")).mapInArrow(profile, ROW_SCHEMA), "near-rows")


def bucket_rows(nodes: DataFrame) -> DataFrame:
    """key, node: one row per band."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], names=["key", "node"])

    return nodes.select("node", "bands").mapInArrow(explode, "key long, node long")


def crowded(buckets: DataFrame) -> DataFrame:
    """key, node, others: the buckets of two nodes or more, and how many others each node meets there."""
    counted = buckets.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), (F.count("*") - 1).alias("others")).where("a < z").select("key", "others")
    return buckets.join(counted, "key").select("key", "node", "others")


def centred(buckets: DataFrame) -> DataFrame:
    """key, node, a (the bucket's centre, the node that meets most others over all
    its buckets), weight (how many it meets; 0 for the centre itself)."""
    met = buckets.join(buckets.groupBy("node").agg(F.sum("others").alias("weight")), "node")
    centres = met.groupBy("key").agg(F.min(F.struct(-F.col("weight"), "node")).getField("node").alias("a"))
    return met.join(centres, "key").select("key", "node", "a", F.when(F.col("node") != F.col("a"), F.col("weight")).otherwise(0).alias("weight"))


def first_stars(members: DataFrame) -> DataFrame:
    """a < b: the nodes of each bucket with its centre."""
    return members.where("node <> a").select(F.least("node", "a").alias("a"), F.greatest("node", "a").alias("b")).distinct()


def full_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, size, hashes: the whole sets of these nodes; stored."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "size", "hashes"])

    wanted = rows.select(F.col("rid").alias("node"), "text").join(nodes, "node", "left_semi")
    return stored(wanted.mapInArrow(sets, "node long, size long, hashes binary"), "near-sets-whole")


def confirmed(pairs: DataFrame, whole: DataFrame, similarity: int) -> DataFrame:
    """a, b: the pairs whose full sets reach the similarity; stored."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_pylist() for c in batch.columns[2:])
            yield batch.select([0, 1]).filter(pa.array([similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), similarity) for p, q in zip(x, y, strict=True)], pa.bool_()))

    of_b = whole.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("hashes").alias("hb"))
    sized = pairs.join(whole.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("hashes").alias("ha")), "a").join(of_b, "b")
    both = sized.where(100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    return stored(both.select("a", "b", "ha", "hb").mapInArrow(check, "a long, b long"), "near-links")


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The bucket rows with their components (root)."""
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def drawn_stars(members: DataFrame, roots: DataFrame, turns: int = TURNS) -> DataFrame:
    """a < b: the nodes of each bucket that spans components with each of ``turns``
    of its nodes, every one drawn by a hash of its own, where their components differ.
    Where rows have a weight, the number drawn for a node is taken so many times."""
    placed = rooted(members, roots)
    weight = F.col("weight") if "weight" in members.columns else F.lit(1)
    draws = [F.max(F.struct((F.shiftrightunsigned(F.xxhash64("key", "node", F.lit(turn)), 11) * weight.cast("double")).alias("order"), "node", "root")) for turn in range(turns)]
    drawn = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.array(*draws).alias("centres"))
    apart = placed.join(drawn.where("lo < hi").select("key", "centres"), "key").select("node", "root", F.explode("centres").alias("centre")).where(F.col("root") != F.col("centre.root"))
    return apart.select(F.least("node", "centre.node").alias("a"), F.greatest("node", "centre.node").alias("b")).distinct()


def open_nodes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, root of the nodes in buckets that span components."""
    placed = rooted(members, roots)
    spans = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    return placed.join(spans, "key", "left_semi").select("node", "root").distinct()


def rare_prefixes(whole: DataFrame, nodes: DataFrame, similarity: int) -> DataFrame:
    """shingle, node, size, root, rest: the shingles by which a node can be found
    from another component; stored.

    One order holds for all sets: shingles of a single component first, then the
    rarer ones first.  ``rest`` counts a set's shingles from this one on.  The first
    shingle in that order that two sets share has the whole intersection in
    ``rest`` of either, so a link has such a row on both sides.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                size = batch.column(1).to_numpy()
                own = [pa.array(np.repeat(batch.column(i).to_numpy(), size)) for i in (0, 1, 2)]
                hashes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((hashes >> _U(1)).astype(np.int64)), *own], names=["shingle", "node", "size", "root"])

    sets = whole.join(nodes, "node").select("node", "size", "root", "hashes")
    elements = sets.mapInArrow(explode, "shingle long, node long, size long, root long")
    common = elements.groupBy("shingle").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle", "df")
    own = Window.partitionBy("node")
    shared = elements.join(common, "shingle").withColumn("rest", F.row_number().over(own.orderBy(F.desc("df"), F.desc("shingle"))))
    return stored(shared.where(100 * F.col("rest") >= similarity * F.col("size")).select("shingle", "node", "size", "root", "rest"), "near-prefixes")


def within(rest: str, x: str, y: str, similarity: int) -> Column:
    """Whether an intersection of ``rest`` lets sets of these sizes reach the similarity."""
    return (100 + similarity) * F.col(rest) >= similarity * (F.col(x) + F.col(y))


def rest_of_pairs(prefixes: DataFrame, similarity: int) -> DataFrame:
    """a < b: pairs of different components that the positions of a shared rare shingle admit."""
    parts = prefixes.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.min("size").alias("least"))
    about = parts.groupBy("shingle").agg(F.count("*").alias("parts"), F.max(F.struct("n", "root")).getField("root").alias("top"), F.min("least").alias("least")).where("parts > 1").select("shingle", "top", "least")
    left = prefixes.join(about, "shingle").where(within("rest", "size", "least", similarity)).select("shingle", "node", "size", "root", "rest", "top")
    # Every such pair has an end outside its bucket's largest component.
    one = left.where("root <> top").select("shingle", F.col("node").alias("x"), F.col("size").alias("nx"), F.col("root").alias("rx"), F.col("rest").alias("sx"))
    other = left.select("shingle", F.col("node").alias("y"), F.col("size").alias("ny"), F.col("root").alias("ry"), F.col("rest").alias("sy"))
    met = one.join(other, (one.shingle == other.shingle) & (F.col("rx") != F.col("ry")) & within("sx", "nx", "ny", similarity) & within("sy", "nx", "ny", similarity))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def all_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one centre: a < b in every edge,
    so the centres are then the smallest nodes of their components."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("a", F.lit(0), F.lit(1)))
    told = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return told.where("below > 1 OR below = 1 AND above = 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every linked node."""
    edges = stored(links.select("a", "b").distinct(), "near-edges")
    while True:
        if all_stars(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a")).distinct()
        # large star: larger neighbours move to the smallest neighbour (or the node)
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        moved = large.join(low, large.b == low.u)
        small = moved.select(F.col("m").alias("a"), F.col("a").alias("b")).union(moved.select("m", "u")).toDF("a", "b").where("a < b").distinct()
        older, edges = edges, stored(small, "near-edges")
        discard(older)


def joined_up(roots: DataFrame) -> DataFrame:
    """a, b: the edges that hold these components together."""
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b")).where("a < b")


def near_dedup(docs: DataFrame, similarity: int = SIMILARITY, row: Column | None = None) -> DataFrame:
    """Classes of documents that links of the given similarity connect.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest
    doc_id of its class), kept (doc_id = component_id).  A null or blank text
    has no shingle and is a class of its own.  Null doc_ids belong to their
    class without naming it, and a class of null ids only has component_id
    null and keeps its rows; rows that repeat a kept doc_id are all kept.
    ``row``, a number that no two rows share, adds ``row`` and ``first``: true
    for exactly one row of each class, of the smallest doc_id and then number.
    Other columns are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = profiled(docs, row)
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("given").alias("given"))).alias("least")
    sets = stored(rows.where("n > 0").groupBy("s1", "s2").agg(F.min("rid").alias("node"), least), "near-sets")
    nodes = stored(rows.select(F.col("rid").alias("node"), "bands").join(sets.select("node"), "node", "left_semi"), "near-nodes")
    buckets = stored(crowded(bucket_rows(nodes)), "near-crowded")
    discard(nodes)
    members = stored(centred(buckets), "near-buckets")
    discard(buckets)
    whole = full_sets(rows, members.select("node").distinct())
    links = confirmed(first_stars(members), whole, similarity)
    stars = components(links)
    stars = components(joined_up(stars).unionByName(confirmed(drawn_stars(members, stars), whole, similarity)))
    prefixes = rare_prefixes(whole, open_nodes(members, stars), similarity)
    discard(members)
    found = confirmed(rest_of_pairs(prefixes, similarity), whole, similarity)
    discard(prefixes)
    discard(whole)
    roots = components(joined_up(stars).unionByName(found))
    of_set = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = of_set.join(of_set.groupBy("root").agg(F.min("least").alias("component")), "root").select("s1", "s2", "component", F.lit(True).alias("known"))
    out = rows.select("doc_id", "given", "n", "s1", "s2").join(named, ["s1", "s2"], "left")
    member = (F.col("n") > 0) & F.coalesce("known", F.lit(False))
    component = F.when(member, F.col("component.doc_id")).otherwise(F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")]
    if row is not None:
        columns += [F.col("given").alias("row"), (~member | (F.col("given") == F.col("component.given"))).alias("first")]
    return out.select(*columns)
