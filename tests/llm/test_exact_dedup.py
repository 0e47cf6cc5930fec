"""Exact deduplication against a dictionary, and the directory's growth."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, key string"


def brute(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups: dict = {}
    for i, t, _ in rows:
        groups.setdefault((t or "").translate(low), []).append(i)
    out = []
    for body, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups_equal_a_dictionary(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Hot Text", "hot text", "ÄB", "äb", "", None, "x" * 4000, f"t{rng.randrange(40)}"]), "k") for i in range(400)]
    rows += [(None, "hot text", None), (None, "alone", None), (7, "hot text", "again"), (900, "again", None), (900, "again", None)]
    got = sorted(map(tuple, E.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), capacity=4).collect()), key=str)
    assert got == brute(rows)


def test_nothing(spark):
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_colliding_keys_are_chained(spark, monkeypatch):
    rows = [(1, "a", ""), (2, "b", ""), (3, "A", "")]
    plain = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text")
    same = plain.selectExpr("doc_id", "cast(null as long) as row", "cast(5 as long) as key", "unhex(sha2(lower(text), 256)) as sha")
    monkeypatch.setattr(E, "entries", lambda docs, _: docs.selectExpr("0 as bucket", "cast(5 as long) as key", "unhex(sha2(lower(text), 256)) as sha", "doc_id as keep_id", "cast(null as long) as keep_row", "1L as size", "cast(lower(text) as binary) as body"))
    got = sorted((r.chain, r.keep_id, r.group_size) for r in E.build_index(plain, same).collect())
    assert sorted(g[1:] for g in got) == [(2, 1), (3, 2)] and [g[0] for g in got] == [0, 1]


def test_directory_doubles_and_splits_only_what_is_full():
    rng = random.Random(1)
    counts = np.zeros(1 << 10, int)
    counts[rng.sample(range(1 << 10), 300)] = 1
    counts[7] = 500
    d = E.Directory(counts, capacity=20)
    held: dict = {}
    for p, n in enumerate(counts.tolist()):
        b = d.bucket(p << 54)
        held[b] = held.get(b, 0) + n
    assert all(n <= 20 for b, n in held.items() if d.local[b] < 10)
    assert len(d.slots) == 1 << d.depth and set(d.slots) == set(range(d.buckets))
    for b in range(d.buckets):
        mine = [i for i, x in enumerate(d.slots) if x == b]
        assert mine == list(range(mine[0], mine[0] + len(mine))) and len(mine) == 1 << (d.depth - d.local[b])
        if d.local[b]:
            level = int(d.local[b]) - 1
            parent = counts.reshape(1 << level, -1).sum(1)[mine[0] >> (d.depth - level)]
            assert parent > 20  # no bucket without need
    assert d.slots.tolist() == sorted(d.slots.tolist())
    assert E.Directory(np.zeros(1 << 10), 5).buckets == 1


def test_a_large_directory_is_built_at_once():
    d = E.Directory(np.full(1 << 20, 70), capacity=1024)
    assert d.depth == 17 and d.buckets == 1 << 17


def test_one_row_of_each_group_comes_first(spark):
    rows = [(5, "a"), (5, "A"), (None, "a"), (None, "b"), (None, "b"), (1, None), (1, ""), (2, "c")]
    numbered = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    found = E.exact_dedup(numbered, row=F.col("k")).collect()
    assert sorted(r.row for r in found if r["first"]) == [1, 4, 6, 7] and len(found) == 8
