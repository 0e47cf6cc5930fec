"""Repeated passages against a dictionary of all 50-byte strings."""

import random

import numpy as np
import pytest

from marlstone.llm import repeats as R
from marlstone.llm import suffixes as S

SCHEMA = "doc_id long, text string, kind string, a string"


def brute(rows):
    body = lambda t: (t or "").encode()
    key = lambda d: float("inf") if d is None else d
    first: dict = {}
    for d, t, *_ in rows:
        b = body(t)
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, float("inf")), key(d))
    out = []
    for d, t, *_ in rows:
        b = body(t)
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key(d):
                gone[i : i + 50] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in R.remove_repeats(frame).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "naïve", "übergroß", "x", "tion", "日本"]) + rng.choice(["", "s", "ed"])
    text = lambda n: " ".join(word() + str(rng.randrange(50)) for _ in range(n))
    passages = [text(rng.randrange(5, 40)) for _ in range(8)]
    rows = []
    for i in range(120):
        t = " ".join(rng.choice(passages) if rng.random() < 0.4 else text(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6)))
        rows.append((rng.randrange(100), t, "x", "y"))
    rows += [(7, rows[0][1], "", ""), (None, rows[1][1], "", ""), (None, rows[1][1], "", ""), (500, None, "", ""), (501, "", "", ""), (502, "short", "", "")]
    rows += [(600, "a" * 300, "", ""), (601, "a" * 49, "", ""), (602, "a" * 50 + "b", "", ""), (603, "ab" * 100, "", ""), (604, "ab" * 60, "", "")]
    return rows


@pytest.mark.parametrize("hot", [200, 1])
def test_equals_a_dictionary_of_all_strings(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT_BLOCKS", hot)
    rows = corpus(hot)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_nothing_shared_and_nothing_at_all(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, "short", "", ""), (2, None, "", ""), (3, "x" * 60, "", "")]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("alphabet", [2, 4, 200])
def test_suffix_order_equals_sorting(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 50, 700):
        t = rng.integers(0, alphabet, n).astype(np.uint8)
        t[n // 3 : n // 2] = 1
        b = t.tobytes()
        order = S.suffix_order(t)
        assert sorted(order.tolist()) == list(range(n))
        cut = [b[i : i + S.DEPTH].ljust(S.DEPTH, b"\0") for i in order]
        assert cut == sorted(cut)


def test_types_of_suffixes():
    b = b"mississippi"
    got = S.smaller_than_next(np.frombuffer(b, np.uint8)).tolist()
    assert got == [b[i:] < b[i + 1 :] for i in range(len(b))]


def test_equal_windows_have_equal_fingerprints():
    rng = random.Random(2)
    s = bytes(rng.randrange(97, 123) for _ in range(400))
    a, b = s, bytes(rng.randrange(97, 123) for _ in range(133)) + s[100:300]

    def by_window(t):
        return {t[i : i + 50]: fp for fp, at, n in zip(*(x.tolist() for x in R.windows(t)), strict=True) for i in range(at, at + n)}

    x, y = by_window(a), by_window(b)
    assert len(x) == 351 and all(x[w] == y[w] for w in x.keys() & y.keys()) and len(x.keys() & y.keys()) == 151


def test_blocks_and_stretches_of_any_size_give_the_same(spark, monkeypatch):
    rows = corpus(9)
    want = brute(rows)
    monkeypatch.setattr(R, "BLOCK_BYTES", 700)
    monkeypatch.setattr(R, "STRETCH", 90)
    monkeypatch.setattr(R, "SORTED", 7)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_a_text_of_three_megabytes(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    text = " ".join(rng.choice(words) for _ in range(400_000))
    rows = [(1, text), (2, "before it " + text[1_500_000:1_500_400] + " after it"), (3, text)]
    found = {r.doc_id: r for r in R.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(text) > 2_500_000 and found[1].n_removed == 0 and found[3].n_removed == len(text)
    assert 400 <= found[2].n_removed <= 420 and bytes(found[2].kept).startswith(b"before it")


def test_segments_are_not_stored_besides_their_shuffle(spark, monkeypatch):
    """The segments alone may outweigh the input: one copy on disk, not two."""
    labels, plain = [], R.stored
    monkeypatch.setattr(R, "stored", lambda frame, label, *a: labels.append(label) or plain(frame, label, *a))
    rows = corpus(3)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)
    assert labels == ["repeat-blocks", "repeat-shared", "repeat-answers"]


def test_a_block_of_documents_is_one_packed_row():
    docs = [(5, b"abc" * 1000), (None, b""), (R.LAST, "naïve".encode()), (0, b"x"), (-3, b"y" * 10)]
    row = dict(zip(R.NAMES, R.packed_docs(7, docs), strict=True))
    assert R.unpacked_docs([row]) == docs and len(row["a"]) < 200
    row = dict(zip(R.NAMES, R.packed_docs(7, [(None, b"")]), strict=True))
    assert R.unpacked_docs([row]) == [(None, b"")]


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_fingerprints_by_their_segments(spark, monkeypatch, hot):
    monkeypatch.setattr(R, "HOT_BLOCKS", 1)
    monkeypatch.setattr(R, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(R, "BLOCK_BYTES", 700)
    rows = corpus(5)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute(rows)


def test_a_common_passage_in_one_context_is_not_hot(monkeypatch):
    """In 300 blocks, one segment each: no reason to send its windows one by one."""
    p = np.array([3, 9], np.uint32).tobytes()
    state = lambda many: np.frombuffer(next(R.shared_prints([{"blk": b, "ord": 0, "a": p, "b": bytes([2 * many, 2])} for b in range(300)])).column(4)[0].as_py(), np.uint8).tolist()
    assert state(1) == [1, 1] and state(100) == [2, 1]


def test_contexts_tell_segments_apart():
    a, b = b"q" * 30 + b"0123456789abcdefghijklmnopqrstuvwxyz" * 3, b"z" * 45 + b"0123456789abcdefghijklmnopqrstuvwxyz" * 3
    for text in (a, b):
        fps, first, n = R.windows(text)
        seen = R.contexts(text, first, n)
        pieces = [text[i : i + k + R.WIDTH - 1] for i, k in zip(first.tolist(), n.tolist(), strict=True)]
        assert len(seen) == len(pieces) and len(set(zip(seen.tolist(), pieces, strict=True))) == len(set(pieces))
