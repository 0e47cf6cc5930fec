"""Operator 7: document quality by attention-based multiple-instance learning.

A document is a bag of passages, and only the bag is labelled.  Every passage
of a text (``PASSAGE`` bytes) is encoded by counts of byte classes, of pairs of
neighbouring classes, and of how far its words repeat words of the passage and
of the document before it.  A hidden layer turns the counts into a passage
vector; gated attention (tanh times sigmoid) gives each passage a weight; the
weighted mean passes through a logistic output.  All weights are learned
together from the document labels.

Training uses at most ``TRAIN_DOCS`` labelled documents and ``TRAIN_BYTES`` of
their passages, the ones whose hashed doc_id comes first, on the driver; its
memory does not depend on the corpus.  Every passage of such a document counts.
Scoring broadcasts the weights (under 100 KB) and maps over all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepare, texts_as_bytes

PASSAGE = 512
TRAIN_DOCS = 4000
#: Bytes of encoded passages (0.42 of the text) that training takes at most, whole
#: documents in the same order: the bound on the driver's memory.
TRAIN_BYTES = 256 << 20
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY, SEED = 24, 12, 60, 0.01, 1e-4, 7
THRESHOLD = 0.7
HELD_OUT, FOLDS = 2, 4

#: Byte classes: lower case, upper case, digits, space, line end, other blanks,
#: sentence marks, joining marks, brackets and quotes, bars and tabs, hashes and
#: similar signs, other signs, control bytes, UTF-8 leading and following bytes.
CLASSES = 14


def _class_table() -> np.ndarray:
    table = np.full(256, 11, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b"\r\t\x0b\x0c", b".?", b",;:'-", b"\"()[]{}<>", b"|_=", b"#$%&*@", b"!")):
        table[list(chars)] = k if k < 11 else 13
    table[:9] = table[14:32] = table[127] = 12
    table[128:192] = 0
    table[192:] = 0
    return table


TABLE = _class_table()
PAIRS = CLASSES * CLASSES
EXTRA = 4
FEATURES = CLASSES + PAIRS + EXTRA


def encode(text: bytes) -> np.ndarray:
    """One row of features per passage; an empty text is one empty passage."""
    if not text:
        return np.zeros((1, FEATURES), np.float32)
    classes = TABLE[np.frombuffer(text, np.uint8)].astype(np.int64)
    n = len(classes)
    rows = -(-n // PASSAGE)
    at = np.arange(n) // PASSAGE
    sizes = np.bincount(at, minlength=rows).astype(np.float32)[:, None]
    one = np.bincount(at * CLASSES + classes, minlength=rows * CLASSES).reshape(rows, CLASSES) / sizes
    two = np.bincount(at[:-1] * PAIRS + classes[:-1] * CLASSES + classes[1:], minlength=rows * PAIRS).reshape(rows, PAIRS) / sizes
    out = np.zeros((rows, FEATURES), np.float32)
    out[:, :CLASSES] = one
    out[:, CLASSES : CLASSES + PAIRS] = np.sqrt(two)
    seen: set[bytes] = set()
    lines: set[bytes] = set()
    for i in range(rows):
        part = text[i * PASSAGE : (i + 1) * PASSAGE]
        words = part.split()
        own = set(words)
        own_lines = part.split(b"\n")
        if words:
            out[i, -4] = 1 - len(own) / len(words)
            out[i, -3] = len(own & seen) / len(own)
            out[i, -2] = min(1.0, len(part) / len(words) / 20)
        out[i, -1] = sum(x in lines for x in own_lines if len(x) > 8) / len(own_lines)
        seen |= own
        lines.update(own_lines)
    return out


def rounded(features: np.ndarray) -> np.ndarray:
    """Features in steps of 1/255, as training sees them."""
    return np.round(features * 255).clip(0, 255).astype(np.float32) / 255


@dataclass
class Model:
    """Encoder, attention and output weights."""

    mean: np.ndarray
    spread: np.ndarray
    w: dict[str, np.ndarray]

    def score(self, passages: np.ndarray) -> tuple[float, np.ndarray]:
        """The document's score and its passages' attention weights."""
        w = self.w
        h = np.tanh((passages - self.mean) / self.spread @ w["enc"] + w["enc_b"])
        a = (np.tanh(h @ w["v"]) * _sigmoid(h @ w["u"])) @ w["a"]
        a = np.exp(a - a.max())
        a /= a.sum()
        z = float(a @ h @ w["out"] + w["out_b"][0])
        return float(_sigmoid(np.float64(z))), a


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Scores of a batch of bags (rows of x from each start on), and the gradients
    of their weighted log loss by all weights."""
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    tv, su = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
    gate = tv * su
    a = gate @ w["a"]
    a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    a /= np.add.reduceat(a, starts)[bag]
    pooled = np.add.reduceat(a[:, None] * h, starts)
    p = _sigmoid(pooled @ w["out"] + w["out_b"])
    dz = ((p - labels) * weight).astype(w["out"].dtype)
    up = (dz[:, None] * w["out"])[bag]
    dot = (up * h).sum(1)
    da = a * (dot - np.add.reduceat(a * dot, starts)[bag])
    dgate = da[:, None] * w["a"]
    dv, du = dgate * su * (1 - tv**2), dgate * tv * su * (1 - su)
    dh = (a[:, None] * up + dv @ w["v"].T + du @ w["u"].T) * (1 - h**2)
    return p, {"enc": x.T @ dh, "enc_b": dh.sum(0), "v": h.T @ dv, "u": h.T @ du, "a": gate.T @ da, "out": pooled.T @ dz, "out_b": dz.sum(keepdims=True)}


def _features(bag: np.ndarray) -> np.ndarray:
    return bag.astype(np.float32) / 255 if bag.dtype == np.uint8 else bag


def train(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Learn all weights by Adam on batches of documents, classes balanced.

    Bags may stay in bytes, as they travelled; only a batch at a time becomes
    floats, so the driver holds one byte per feature of the training set.
    """
    rng = np.random.default_rng(SEED)
    n = sum(map(len, bags))
    mean = sum(_features(x).sum(0, dtype=np.float64) for x in bags) / n
    spread = np.sqrt(sum(((_features(x) - mean) ** 2).sum(0) for x in bags) / n) + 0.02
    mean, spread = mean.astype(np.float32), spread.astype(np.float32)
    w = {
        "enc": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "enc_b": np.zeros(HIDDEN),
        "v": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "u": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "a": rng.normal(0, ATTENTION**-0.5, ATTENTION), "out": rng.normal(0, HIDDEN**-0.5, HIDDEN), "out_b": np.zeros(1),
    }
    w = {k: x.astype(np.float32) for k, x in w.items()}
    m1, m2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    good = max(1, int(labels.sum()))
    weight = np.where(labels == 1, len(labels) / (2 * good), len(labels) / (2 * max(1, len(labels) - good)))
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        for first in range(0, len(order), 128):
            ids = order[first : first + 128]
            sizes = np.array([len(bags[i]) for i in ids])
            starts = np.cumsum(sizes) - sizes
            x = (np.concatenate([_features(bags[i]) for i in ids]) - mean) / spread
            _, grads = gradients(w, x, starts, labels[ids], weight[ids] / len(ids))
            t += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, g in grads.items():
                g = g + DECAY * w[k]
                m1[k] += 0.1 * (g - m1[k])
                m2[k] += 0.001 * (g * g - m2[k])
                w[k] = (w[k] - rate * m1[k] / (np.sqrt(m2[k]) + 1e-8)).astype(np.float32)
    return Model(mean, spread, w)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is out of bounds for training."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learn from at most ``train_docs`` labelled documents outside the held-out fold.

    Labels of a doc_id that disagree, and labels or ids that are null, are not
    used.  None if a class has no document.
    """
    prepare(docs.sparkSession)
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
        .groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality")
        .orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(train_docs).select("doc_id", "quality")
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = []
            for text in texts_as_bytes(batch.column(2)):
                bags.append(np.round(encode(text) * 255).clip(0, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id").select("doc_id", "quality", "text").mapInArrow(encoded, "doc_id long, quality int, bag binary")
    # A doc_id may stand in many rows: the bounds hold for rows.
    first = [F.xxhash64(F.lit(SEED), "doc_id", "bag"), F.col("doc_id")]
    bounded = chosen.orderBy(*first).limit(train_docs).withColumn("upto", F.sum(F.length("bag")).over(W.orderBy(*first).rowsBetween(W.unboundedPreceding, 0)))
    rows = sorted(bounded.where(F.col("upto") <= TRAIN_BYTES).collect(), key=lambda r: (r.doc_id, bytes(r.bag)))
    label = np.array([r.quality for r in rows], np.float32)
    if not rows or label.min() == label.max():
        return None
    return train([np.frombuffer(r.bag, np.uint8).reshape(-1, FEATURES) for r in rows], label)


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from its whole text.

    A null text counts as empty and gets the score of an empty passage; a null
    doc_id is not held out; without a model every score is 0.5.  Labels,
    language, source and doc_id have no part in a score.  Other columns are
    ignored; an empty table stays empty.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            s = [0.5 if m is None else m.score(rounded(encode(x)))[0] for x in texts_as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores ``threshold`` or more.

    Without a model nothing is known against a document, and all rows stay.
    """
    if model is None:
        return docs
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(rounded(encode(x)))[0] >= threshold for x in texts_as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def held_out_of(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT
