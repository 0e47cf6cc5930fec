"""Operator 5: maximum inner product search with score-aware quantisation.

Equal vectors become one entry that lists the smallest ids (as many as an
answer can hold), so a very common vector weighs no more than any other.

The quantiser splits a vector into subspaces of two dimensions with 16
codewords each: four bits per subspace, two codes to a byte.  Its loss is
anisotropic: the part of the residual that is parallel to the vector, which
changes large inner products most, costs ``eta`` times the part across it.
Codewords solve the weighted least squares of that loss; codes are chosen by
coordinate descent, since the parallel part couples the subspaces.  It is
fitted on at most ``TRAIN`` vectors, those whose hashed bytes come first; every
vector is then indexed.

Queries and index are cut into blocks, and every query block meets every index
block once.  There, tables of partial inner products by code pair are summed
over the codes of the block; the ``RERANK`` best entries of each query get
their exact inner product in double precision, and the best ``k`` leave the
block.  A window over k rows per query and index block gives the answer.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, stored

K = 20
SUB, CODES = 2, 16
TRAIN = 8192
#: Weight of the parallel residual against the perpendicular one.
ETA = 4.0
ROUNDS, SWEEPS = 8, 2
RERANK = 256
INDEX_BLOCK, QUERY_BLOCK, QUERY_CHUNK = 8192, 4096, 128
#: Distinct vectors a map task holds to combine equal ones.
COMBINE = 50_000
SEED = 3


class Quantiser:
    """Codebooks of shape (subspaces, CODES, SUB)."""

    def __init__(self, dim: int, eta: float = ETA):
        self.dim, self.eta = dim, eta
        self.parts = -(-dim // (2 * SUB)) * 2  # an even number, for two codes to a byte
        self.books = np.zeros((self.parts, CODES, SUB))

    def split(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * SUB))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, SUB)

    def fit(self, x: np.ndarray) -> Quantiser:
        rng = np.random.default_rng(SEED)
        s = self.split(x)
        for m in range(self.parts):
            self.books[m] = s[rng.choice(len(s), CODES, replace=len(s) < CODES), m]
        codes = np.array([((s[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)]).T
        for _ in range(ROUNDS):
            self._update(s, codes)
            codes = self._descend(s, codes)
        return self

    @staticmethod
    def _unit(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = np.sqrt((s**2).sum((1, 2)))
        return s / norm[:, None, None], norm

    def _along(self, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each subspace's share of the decoded vector along the original."""
        return np.stack([(unit[:, m] * self.books[m][codes[:, m]]).sum(1) for m in range(self.parts)], 1)

    def _update(self, s: np.ndarray, codes: np.ndarray) -> None:
        unit, norm = self._unit(s)
        along = self._along(unit, codes)
        for m in range(self.parts):
            rest = norm - (along.sum(1) - along[:, m])
            u, extra = unit[:, m], self.eta - 1
            for c in range(CODES):
                at = codes[:, m] == c
                if at.any():
                    left = at.sum() * np.eye(SUB) + extra * u[at].T @ u[at]
                    self.books[m, c] = np.linalg.solve(left, s[at, m].sum(0) + extra * (u[at] * rest[at, None]).sum(0))
            along[:, m] = (u * self.books[m][codes[:, m]]).sum(1)

    def _descend(self, s: np.ndarray, codes: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
        unit, norm = self._unit(s)
        along, codes = self._along(unit, codes), codes.copy()
        total = along.sum(1)
        rows = np.arange(len(s))
        for _ in range(sweeps):
            for m in range(self.parts):
                across = ((s[:, m, None] - self.books[m]) ** 2).sum(2)
                share = unit[:, m] @ self.books[m].T
                parallel = (norm - total + along[:, m])[:, None] - share
                best = (across + (self.eta - 1) * parallel**2).argmin(1)
                total += share[rows, best] - along[:, m]
                along[:, m], codes[:, m] = share[rows, best], best
        return codes

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of every vector, two to a byte."""
        s = self.split(x)
        codes = np.array([((s[:, m, None] - self.books[m]) ** 2).sum(2).argmin(1) for m in range(self.parts)]).T
        codes = self._descend(s, codes).astype(np.uint8)
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(bytes, 256, queries): the partial inner product of each code pair."""
        part = np.einsum("qms,mcs->mcq", self.split(q), self.books).astype(np.float32)
        return np.stack([(part[m + 1][:, None] + part[m][None]).reshape(CODES * CODES, -1) for m in range(0, self.parts, 2)])

    def scan(self, codes: np.ndarray, q: np.ndarray) -> np.ndarray:
        """(entries, queries): approximate inner products by table lookups."""
        tables = self.tables(q)
        out = tables[0][codes[:, 0]]
        for j in range(1, codes.shape[1]):
            out += tables[j][codes[:, j]]
        return out


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, added in the order of the components."""
    out = np.zeros(np.broadcast_shapes(q.shape, x.shape)[:-1])
    for d in range(x.shape[-1]):
        out += q[..., d] * x[..., d]
    return out


def nearest(quantiser: Quantiser, q_ids: np.ndarray, q: np.ndarray, codes: np.ndarray, x: np.ndarray, ids: list, k: int = K, rerank: int = RERANK) -> list[tuple[int, int, float]]:
    """query_id, vec_id, score: the k best of one index block for each query."""
    out = []
    for first in range(0, len(q), QUERY_CHUNK):
        part = q[first : first + QUERY_CHUNK]
        if len(x) > rerank:
            rough = quantiser.scan(codes, part)
            chosen = np.argpartition(rough, len(x) - rerank, axis=0)[len(x) - rerank :].T
        else:
            chosen = np.broadcast_to(np.arange(len(x)), (len(part), len(x)))
        exact = inner(part[:, None], x[chosen])
        for i, row in enumerate(np.argsort(-exact, axis=1, kind="stable")):
            found, last = [], None
            for j in row:
                if len(found) >= k and exact[i, j] < last:
                    break
                last = exact[i, j]
                found += [(-last, v) for v in ids[chosen[i, j]]]
            out += [(q_ids[first + i], v, -s) for s, v in heapq.nsmallest(k, found)]
    return out


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """vec (the components' bytes) and its smallest ``keep`` ids; stored.

    Vectors that are null, zero or of another length than most, or that hold
    null or non-finite components, take no part.
    """
    usual = rows.where("vec is not null").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = usual.d if usual else 0

    def flushed(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(v) for v in held.values()], pa.list_(pa.int64()))], names=["vec", "ids"])

    def smallest(old: set, new: list) -> set:
        old.update(new)
        return set(heapq.nsmallest(keep, old)) if len(old) > 4 * keep else old

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is None or v is None or len(v) != dim or None in v:
                    continue
                x = np.array(v, np.float64)
                if not np.isfinite(x).all() or not x.any():
                    continue
                body = (x + 0.0).tobytes()
                held[body] = smallest(held.get(body, set()), [i])
            if len(held) >= COMBINE:
                yield flushed(held)
                held = {}
        if held:
            yield flushed(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, set()
        out: dict[bytes, set] = {}
        for batch in batches:
            for body, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if body != at:
                    if at is not None:
                        out[at] = heapq.nsmallest(keep, ids)
                    at, ids = body, set()
                ids = smallest(ids, more)
            if len(out) > 4096:
                yield flushed(out)
                out = {}
        if at is not None:
            out[at] = heapq.nsmallest(keep, ids)
            yield flushed(out)

    schema = "vec binary, ids array<long>"
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    combined = rows.select("vec_id", "vec").mapInArrow(combine, schema)
    return stored(combined.repartition(parts, "vec").sortWithinPartitions("vec").mapInArrow(merge, schema), "ann-vectors")


def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """query_id and its vector's bytes as distinct_vectors() writes them."""
    for batch in batches:
        rows = [(i, (np.array(v, np.float64) + 0.0).tobytes()) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if v is not None and None not in v]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], names=["query_id", "vec"])


def search(embeddings: DataFrame, every: int = 20, k: int = K, eta: float = ETA, rerank: int = RERANK, index_block: int = INDEX_BLOCK) -> DataFrame:
    """The k nearest rows by inner product for every row whose id is divisible by ``every``.

    Returns query_id, rank (from 1), vec_id, score, nearest first, ties to the
    smaller vec_id; the row of the query's own id is no candidate.  Null ids
    take no part, a repeated id counts once per distinct vector; other columns
    are ignored; without vectors the result is empty.
    """
    spark = prepare(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    index = distinct_vectors(rows, k + 1)
    # Each distinct vector is searched once, under its smallest id; its other queries share what it finds.
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = distinct_vectors(asked, 1).select("vec", F.element_at("ids", 1).alias("query_id"))
    n, n_queries = index.count(), queries.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n or not n_queries:
        return spark.createDataFrame([], empty)
    sample = index.orderBy(F.xxhash64("vec"), "vec").limit(TRAIN).select("vec").collect()
    fitted = np.frombuffer(b"".join(r.vec for r in sample)).reshape(len(sample), -1)
    shared = spark.sparkContext.broadcast(Quantiser(fitted.shape[1], eta).fit(fitted))
    blocks, query_blocks = -(-n // index_block), -(-n_queries // QUERY_BLOCK)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column(0).to_pylist())).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in shared.value.encode(x)], pa.binary())], names=["vec", "ids", "codes"])

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            q = np.frombuffer(b"".join(left.column("vec").to_pylist())).reshape(left.num_rows, -1)
            x = np.frombuffer(b"".join(right.column("vec").to_pylist())).reshape(right.num_rows, -1)
            codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)
            found = nearest(shared.value, left.column("query_id").to_numpy(), q, codes, x, right.column("ids").to_pylist(), k + 1, rerank)
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other")
    place = F.pmod(F.xxhash64("vec"), F.lit(blocks))
    right = index.mapInArrow(encode, "vec binary, ids array<long>, codes binary").select("vec", "ids", "codes", place.alias("mine"), each(query_blocks))
    right = right.select("vec", "ids", "codes", (F.col("mine") * query_blocks + F.col("other")).alias("unit"))
    left = queries.select("vec", "query_id", F.pmod(F.xxhash64(F.lit(1), "vec"), F.lit(query_blocks)).alias("mine"), each(blocks))
    left = left.select("vec", "query_id", (F.col("other") * query_blocks + F.col("mine")).alias("unit"))
    met = left.groupBy("unit").cogroup(right.groupBy("unit")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1).select(F.col("query_id").alias("first_id"), "vec_id", "score")
    members = asked.mapInArrow(as_bytes, "query_id long, vec binary").join(queries.withColumnRenamed("query_id", "first_id"), "vec").select("query_id", "first_id").distinct()
    shared_best = members.join(best, "first_id").where("vec_id <> query_id")
    return shared_best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
