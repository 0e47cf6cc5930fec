"""Vector search against brute force; the pipeline's stages on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from marlstone.llm import ann

SCHEMA = "vec_id long, embedding array<double>, rank string, unit string"


def brute(rows, every, k):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 6:
            ok.setdefault(i, set()).add(tuple(v))
    out = []
    for q in sorted(i for i in ok if i % every == 0):
        for qv in ok[q]:
            found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, vs in ok.items() if i != q for v in vs)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def test_equals_brute_force_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "", "") for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 2.0, 0.0, 0.0, 1.0], "", "") for i in range(80)]  # one very common vector
    rows += [(2000, None, "", ""), (2010, [0.0] * 6, "", ""), (2020, [float("nan")] * 6, "", ""), (2030, [None] * 6, "", ""), (None, [1.0] * 6, "", ""), (2040, [1.0], "", ""), (2050, [float("inf")] + [0.0] * 5, "", ""), (2060, [], "", "")]
    got = ann.search(spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(4), every=10, k=7).collect()
    want = brute(rows, 10, 7)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(w[:3] for w in want)
    assert np.allclose(sorted(r.score for r in got), sorted(w[3] for w in want), rtol=1e-12)


def test_recall_of_the_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(rows, rerank=160).select("query_id", "vec_id").collect()
    x = np.array([r.embedding for r in rows.orderBy("vec_id").collect()], np.float64)
    hits = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & {r.vec_id for r in got if r.query_id == q})
    assert hits / len(got) >= 0.9


def test_anisotropic_codes_keep_the_parallel_part():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parallel = {}
    for eta in (1.0, 8.0):
        q = ann.Quantiser(8, eta).fit(x)
        packed = q.encode(x)
        approx = q.scan(packed, unit[:50])
        assert np.allclose(approx[:, 0], q.scan(packed, unit[:1])[:, 0])
        codes = np.stack([packed & 15, packed >> 4], 2).reshape(len(x), -1)
        decoded = np.concatenate([q.books[m][codes[:, m]] for m in range(q.parts)], 1)[:, :8]
        assert np.allclose(decoded @ unit[0], approx[:, 0], atol=1e-4)
        parallel[eta] = np.mean(((x - decoded) * unit).sum(1) ** 2)
    assert parallel[8.0] < parallel[1.0]


def test_no_vectors(spark):
    assert ann.search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert ann.search(spark.createDataFrame([(20, [1.0, 2.0], "", ""), (21, None, "", "")], SCHEMA)).collect() == []


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returned, written and reread."""
    folder = tmp_path_factory.mktemp("stages")
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return spark.read.parquet(f"{sf}/documents.parquet"), out


def test_stages_keep_the_columns_and_their_rules(spark, stages):
    docs, (quality, exact, near, mixed, packed) = stages
    assert quality.columns == exact.columns == near.columns == mixed.columns == docs.columns
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = quality.join(labels, "doc_id").groupBy("quality").count().collect()
    good = {r.quality: r["count"] for r in kept}
    assert good.get(0, 0) <= 0.1 * labels.where("quality = 0").count() and good[1] >= 0.95 * labels.where("quality = 1").count()
    low = F.expr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    assert exact.count() == quality.select(low).distinct().count()
    assert exact.select(F.max("doc_id")).first() == quality.select(F.max("doc_id")).first()
    assert 0 < near.count() < exact.count() and near.join(exact, near.columns, "left_semi").count() == near.count()
    assert mixed.join(near, near.columns, "left_anti").count() == 0 and mixed.groupBy("doc_id").count().where("count > 3").count() == 0
    assert packed.where("start = 0").count() == mixed.count()


def test_run_returns_the_last_stage(spark, stages):
    got = P.run(spark, "/root/testdata/sf0.01")
    assert got.columns == stages[1][-1].columns
    # Where documents are cut follows the order of rows in files; what is packed does not.
    whole = lambda frame: frame.groupBy("doc_id").agg(F.sum("length"), F.min("doc_tokens")).orderBy("doc_id").collect()
    assert whole(got) == whole(stages[1][-1])


def test_stages_on_null_and_repeated_ids_extra_columns_and_nothing(spark):
    sf = "/root/testdata/sf0.001"
    known = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in known.where("length(text) between 300 and 900").orderBy("doc_id").limit(6).collect()]
    rows = [(1, texts[0], "a"), (1, texts[0], "a"), (None, texts[1], None), (None, texts[1], None), (None, texts[1] + " end", "b"), (2, texts[2], "b"), (2, texts[3], "b"), (3, None, "b"), (4, "", "a"), (5, None, None)]
    odd = spark.createDataFrame([(i, t, "en", s, 0, "extra", "row") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars int, row string, component_id string")
    exact, near = dict(P.STAGES)["exact dedup"](spark, odd, sf), dict(P.STAGES)["MinHash near-dedup" if "MinHash near-dedup" in dict(P.STAGES) else "minhash near-dedup"]
    assert exact.columns == odd.columns
    assert sorted(((r.doc_id, r.text or "") for r in exact.collect()), key=str) == sorted([(1, texts[0]), (None, texts[1]), (None, texts[1] + " end"), (2, texts[2]), (2, texts[3]), (5, "")], key=str)
    left = near(spark, odd, sf)
    assert left.columns == odd.columns and left.where(F.col("text") == texts[0]).count() == 1 and left.where("doc_id is null").count() == 1 and left.where("coalesce(text, '') = ''").count() == 3
    mixed = dict(P.STAGES)["mixing to target weights"](spark, odd, sf)
    assert mixed.columns == odd.columns and mixed.groupBy("doc_id", "text", "source").count().where("count > 6").count() == 0
    none = odd.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0, name
