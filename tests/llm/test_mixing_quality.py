"""Mixing against its constraints; the quality model on held-out documents."""

import math
import random

import numpy as np
import pytest

from marlstone.llm import mixing, quality

SCHEMA = "doc_id long, source string, text string, target string, size string"


def targets_by_hand(sizes):
    """Share by weight, stop at three times the size, reshare the excess."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(out.values())) / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not above:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    return out


def corpus(seed, n=1500):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["a", "a", "a", "b", "c", None, "ä", "tiny" if i % 50 == 0 else "a"])
        words = rng.choice([None, "", "one", "two\twords", "w " * rng.randrange(1, 40), "w\n" * rng.randrange(1, 300)])
        rows.append((i, source, words, "x", "y"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_meets_its_targets(spark, seed):
    rows = corpus(seed)
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows) and sorted(map(str, out)) == sorted(map(str, again))
    size = {i: len((t or "").split()) for i, _, t, *_ in rows}
    by: dict = {}
    for i, s, *_ in rows:
        by[s] = by.get(s, 0) + size[i]
    want = targets_by_hand(by)
    assert math.isclose(sum(want.values()), sum(by.values()))
    taken = dict.fromkeys(by, 0)
    for r in out:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9)
        assert r.taken == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s]), (s, taken[s], want[s])


def test_rates_tilt_by_size_as_the_dual_says(spark):
    """Multipliers against bisection by hand; within a source the rate follows the size."""
    rows = corpus(5)
    size = {i: len((t or "").split()) for i, _, t, *_ in rows}
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    several = 0
    for source in {s for _, s, *_ in rows}:
        own = [r for r in found if r.source == source and r["size"] > 0]
        x = np.array([size[r.doc_id] for r in own], float)
        target = own[0].target
        if target >= 3 * x.sum() * (1 - 1e-9):
            assert all(r.rate == 3 for r in own)
            continue
        lo, hi = -2000.0, 2000.0
        value = lambda lam: (x * np.exp(np.minimum(lam * x / x.mean(), math.log(3)))).sum()
        for _ in range(200):
            lo, hi = (lo, (lo + hi) / 2) if value((lo + hi) / 2) > target else ((lo + hi) / 2, hi)
        want = np.exp(np.minimum(lo * x / x.mean(), math.log(3)))
        assert np.allclose([r.rate for r in own], want, atol=2e-5), source
        assert all(math.floor(r.rate) <= r["copies"] <= math.floor(r.rate) + 1 for r in own)
        several += len({r.rate for r in own}) > 5
    assert several >= 2


def test_one_size_a_source_and_one_document(spark):
    rows = [(i, "a" if i < 60 else "b", "w " * 7, "", "") for i in range(90)] + [(100, "c", "w " * 50, "", "")]
    found = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    want = targets_by_hand({"a": 420, "b": 210, "c": 50})
    for source, most in (("a", 7), ("b", 7), ("c", 50)):
        taken = sum(r.taken for r in found if r.source == source)
        assert abs(taken - want[source]) <= most


def test_mix_of_repeats_blanks_and_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = mixing.mix(spark.createDataFrame([(1, "a", None, "", ""), (None, None, "", "", "")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in blank) == [(-1, 0, 0), (1, 0, 0)]
    same = mixing.mix(spark.createDataFrame([(5, "a", "x y", "", "")] * 4, SCHEMA)).collect()
    assert [r.taken for r in same] == [2, 2, 2, 2]


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert scored.count() == docs.count() and len(rows) > 50
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all(r.held_out == quality.held_out_of(r.doc_id) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_labels_outside_training_change_nothing(spark):
    docs = spark.createDataFrame([(i, "Plain words in a row. " * 9 if i % 3 else "### $$$ ||| !!! " * 9, "c") for i in range(120)], "doc_id long, text string, score string")
    labels = [(i, 1 if i % 3 else 0) for i in range(120)]
    flipped = [(i, 1 - q if quality.held_out_of(i) else q) for i, q in labels] + [(None, 1), (3, None)]
    a, b = (sorted(map(tuple, quality.score(docs, quality.fit(docs, spark.createDataFrame(x, "doc_id long, quality int"))).collect())) for x in (labels, flipped))
    assert a == b and {r[3] for r in a if r[0] % 3} == {1} and {r[3] for r in a if r[0] % 3 == 0} == {0}


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a", ""), (1, None, ""), (1, "", ""), (2, "ü" * 90_000, "")], "doc_id long, text string, predicted string")
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, no_labels) is None
    assert [r.score for r in quality.score(docs, None).collect()] == [0.5] * 4
    assert quality.score(docs.limit(0), None).collect() == []
    assert quality.encode(b"x" * 1025).shape == (3, quality.FEATURES)


def test_attention_sums_to_one():
    rng = np.random.default_rng(0)
    bags = [rng.random((rng.integers(1, 5), quality.FEATURES)).astype(np.float32) for _ in range(40)]
    model = quality.train(bags, np.arange(40) % 2, epochs=2)
    score, attention = model.score(bags[0])
    assert 0 <= score <= 1 and math.isclose(attention.sum(), 1, rel_tol=1e-5)


def test_score_equals_a_loop_and_gradients_equal_differences():
    rng = np.random.default_rng(3)
    f, hid, att = quality.FEATURES, 5, 4
    w = {"enc": rng.normal(0, 0.1, (f, hid)), "enc_b": rng.normal(0, 0.1, hid), "v": rng.normal(0, 1, (hid, att)), "u": rng.normal(0, 1, (hid, att)), "a": rng.normal(0, 1, att), "out": rng.normal(0, 1, hid), "out_b": np.array([0.2])}
    mean, spread = rng.normal(0, 0.1, f), rng.uniform(0.5, 2, f)
    model = quality.Model(mean, spread, w)
    bags = [rng.normal(0, 1, (n, f)) for n in (1, 4, 7)]

    def by_hand(bag):
        sig = lambda z: 1 / (1 + math.exp(-z))
        hs, logits = [], []
        for row in bag:
            x = [(row[j] - mean[j]) / spread[j] for j in range(f)]
            h = [math.tanh(sum(x[j] * w["enc"][j][k] for j in range(f)) + w["enc_b"][k]) for k in range(hid)]
            gate = [math.tanh(sum(h[k] * w["v"][k][m] for k in range(hid))) * sig(sum(h[k] * w["u"][k][m] for k in range(hid))) for m in range(att)]
            hs.append(h)
            logits.append(sum(gate[m] * w["a"][m] for m in range(att)))
        total = sum(math.exp(z) for z in logits)
        pooled = [sum(math.exp(z) / total * h[k] for z, h in zip(logits, hs, strict=True)) for k in range(hid)]
        return sig(sum(pooled[k] * w["out"][k] for k in range(hid)) + w["out_b"][0])

    want = [by_hand(b) for b in bags]
    assert np.allclose([model.score(b)[0] for b in bags], want, atol=1e-9)
    x, starts = (np.concatenate(bags) - mean) / spread, np.array([0, 1, 5])
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 0.2, 0.3])
    p, grads = quality.gradients(w, x, starts, labels, weight)
    assert np.allclose(p, want, atol=1e-9)

    def loss():
        q = quality.gradients(w, x, starts, labels, weight)[0]
        return -(weight * (labels * np.log(q) + (1 - labels) * np.log(1 - q))).sum()

    for name, g in grads.items():
        for at in rng.integers(0, w[name].size, 4):
            flat = w[name].reshape(-1)
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            assert abs((up - loss()) / 2e-5 - g.reshape(-1)[at]) < 1e-6, name
            flat[at] = old


def test_a_label_of_many_rows_and_long_texts_stays_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_BYTES", 40 * quality.FEATURES)
    seen = {}
    monkeypatch.setattr(quality, "train", lambda bags, labels: seen.update(n=len(bags), rows=sum(map(len, bags))))
    ids = [i for i in range(40) if not quality.held_out_of(i)][:20]
    rows = [(i, f"text {i} {k} " * 80) for i in ids for k in range(30)]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, train_docs=100)
    assert seen["n"] <= 100 and seen["rows"] <= 40
