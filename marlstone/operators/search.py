"""Text search, vector search and rank fusion."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..registry import query, table

#: Public constants of the ranking function.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 4.0, "body": 1.0, "tags": 2.0}
RRF_K = 60
TERMS = ("the", "and", "with")
STOP = ("the", "of", "and", "a", "to", "in", "is")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


@F.pandas_udf(T.StringType())
def canon(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, control and format characters out, white space collapsed, case folded."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = "".join(" " if c.isspace() else "" if unicodedata.category(c) in ("Cc", "Cf") else c for c in unicodedata.normalize("NFKC", t))
        return " ".join(t.split()).casefold()

    for part in parts:
        yield part.map(one)


def bm25(docs: DataFrame, terms: tuple[str, ...], weights: dict[str, float]) -> DataFrame:
    """doc_id, score: documents that hold every term, by weighted fields.

    docs: doc_id and one text column per field.  Statistics are two aggregates;
    only rows of the query's terms are exploded and shuffled.
    """
    sized = docs.select("doc_id", *(tokens(F.col(f)).alias(f) for f in weights))
    totals = sized.agg(F.count("*").alias("n_docs"), *(F.avg(F.size(f)).alias(f"avg_{f}") for f in weights))
    long = sized.select("doc_id", F.explode(F.array(*(F.lit(t) for t in terms))).alias("term"), *weights)
    for f in weights:
        long = long.withColumn(f"tf_{f}", F.size(F.filter(f, lambda x: x == F.col("term")))).withColumn(f"len_{f}", F.size(f)).drop(f)
    hit = F.greatest(*(F.col(f"tf_{f}") for f in weights), F.lit(0)) > 0
    long = long.where(hit)
    df = long.groupBy("term").agg(F.count("*").alias("df"))
    scored = long.join(F.broadcast(df), "term").join(F.broadcast(totals))
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = sum((w * F.col(f"tf_{f}") / (1 - B + B * F.col(f"len_{f}") / F.greatest(F.col(f"avg_{f}"), F.lit(1e-9))) for f, w in weights.items()), F.lit(0.0))
    part = scored.withColumn("part", idf * tf * (K1 + 1) / (tf + K1))
    return part.groupBy("doc_id").agg(F.sum("part").alias("score"), F.count("*").alias("hits")).where(F.col("hits") == len(set(terms))).select("doc_id", "score")


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query("bm25_search", "TXT-3 TXT-4 TXT-5 TXT-6 SRT-7 JOIN-10", f"""
    WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
    t AS (SELECT doc_id, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS l FROM d, unnest(['the', 'and', 'with']) AS q(term)),
    h AS (SELECT * FROM t WHERE tf > 0), f AS (SELECT term, count(*) AS df FROM h GROUP BY term)
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf / (0.25 + 0.75 * l / a)) * 2.2 / (tf / (0.25 + 0.75 * l / a) + 1.2)), 6) AS score
    FROM h JOIN f USING (term), s GROUP BY doc_id HAVING count(*) = 3 ORDER BY score DESC, doc_id LIMIT 50""")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", F.col("text").alias("body"))
    return bm25(docs, TERMS, {"body": 1.0}).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(50)


@query("stemmed_index", "TXT-5 TXT-7 DM-11")
def stemmed_index(spark: SparkSession, sf: str) -> DataFrame:
    """The inverted index of stemmed terms: documents and occurrences by term.  No oracle: SQL has no stemmer."""
    from ..functions.stem import stemmed

    words = table(spark, sf, "benchmark").where("text is not null").select("item_id", F.explode(stemmed("text")).alias("term"))
    return words.groupBy("term").agg(F.count_distinct("item_id").alias("documents"), F.count("*").alias("occurrences"))


@query("substring_search", "TXT-2 TXT-3 SCH-1", "SELECT doc_id FROM documents WHERE contains(lower(text), 'tion of the') ORDER BY doc_id DESC LIMIT 50")
def substring_search(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.lower("text").contains("tion of the")).select("doc_id").orderBy(F.desc("doc_id")).limit(50)


@query("canon_text", "TXT-1")
def canon_text(spark: SparkSession, sf: str) -> DataFrame:
    """No oracle: SQL has no NFKC."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(canon("text"), 256).alias("canon_sha256"))


@query("jaccard_search", "VEC-6 SRT-5", f"""
    WITH q AS (SELECT list_distinct(list_filter({_TOKENS.replace('text', 'b.text')}, lambda x: NOT list_contains({list(STOP)}, x))) AS w FROM benchmark b WHERE item_id = 0),
    d AS (SELECT doc_id, list_distinct(list_filter({_TOKENS}, lambda x: NOT list_contains({list(STOP)}, x))) AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, len(list_intersect(d.w, q.w)) / nullif(len(d.w) + len(q.w) - len(list_intersect(d.w, q.w)), 0) AS score FROM d, q)
    SELECT doc_id, round(score, 6) AS score FROM s WHERE score >= 0.02 ORDER BY score DESC, doc_id LIMIT 20""")
def jaccard_search(spark: SparkSession, sf: str) -> DataFrame:
    """Lexical fallback: overlap of stop-worded token sets with one query text."""
    words = lambda c: F.array_distinct(F.filter(tokens(c), lambda x: ~x.isin(*STOP)))
    asked = table(spark, sf, "benchmark").where("item_id = 0").select(words(F.col("text"))).first()[0]
    q = F.array(*(F.lit(x) for x in asked)) if asked else F.array().cast("array<string>")
    found = table(spark, sf, "documents").where("text is not null").select("doc_id", words(F.col("text")).alias("w"))
    found = found.withColumn("score", F.try_divide(F.size(F.array_intersect("w", q)), F.size(F.array_union("w", q))))
    return found.where("score >= 0.02").select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0.0 where a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


@query("cosine_topk", "VEC-1 VEC-2 VEC-3 JOIN-18 SRT-5 SRC-19", """
    WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0)
    SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS score FROM embeddings, q WHERE vec_id <> 0 AND list_cosine_similarity(embedding::DOUBLE[], e) >= 0.05
    ORDER BY score DESC, vec_id LIMIT 50""")
def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The query vector is one literal row; candidates are scanned once."""
    rows = table(spark, sf, "embeddings")
    asked = rows.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    valid = (F.size("embedding") == F.size("q")) & ~F.exists("embedding", lambda x: F.isnan(x) | x.isNull())
    scored = rows.where("vec_id <> 0").join(F.broadcast(asked)).where(valid).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    return scored.where("score >= 0.05").select("vec_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(50)


def rrf(*rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """id, score, best: reciprocal-rank fusion of (id, rank) lists."""
    both = rankings[0]
    for r in rankings[1:]:
        both = both.unionByName(r)
    return both.groupBy("id").agg(F.sum(1.0 / (F.col("rank") + k)).alias("score"), F.min("rank").alias("best"))


@query("rrf_hybrid", "JOIN-17 SCH-3 SRT-8", f"""
    WITH d AS (SELECT doc_id, len(list_filter({_TOKENS}, lambda x: x = 'the')) AS a, len({_TOKENS}) AS b FROM documents WHERE text IS NOT NULL),
    x AS (SELECT doc_id AS id, row_number() OVER (ORDER BY a DESC, doc_id) AS rank FROM d QUALIFY rank <= 100),
    y AS (SELECT doc_id AS id, row_number() OVER (ORDER BY b, doc_id) AS rank FROM d WHERE b > 0 QUALIFY rank <= 100), u AS (SELECT *, 'words' AS via FROM x UNION ALL SELECT *, 'similar' FROM y)
    SELECT id, round(sum(1.0 / (60 + rank)), 9)::DOUBLE AS score, min(rank) AS best, CASE WHEN count(*) = 2 THEN 'words+similar' ELSE min(via) END AS reason FROM u GROUP BY id""")
def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Each ranking keeps its first 100 by a distributed top-k before it is numbered."""
    words = table(spark, sf, "documents").where("text is not null").select("doc_id", tokens(F.col("text")).alias("w"))
    sized = words.select("doc_id", F.size(F.filter("w", lambda x: x == "the")).alias("a"), F.size("w").alias("b"))
    first = sized.orderBy(F.desc("a"), "doc_id").limit(100).select(F.col("doc_id").alias("id"), F.row_number().over(W.orderBy(F.desc("a"), "doc_id")).cast("long").alias("rank"))
    second = sized.where("b > 0").orderBy("b", "doc_id").limit(100).select(F.col("doc_id").alias("id"), F.row_number().over(W.orderBy("b", "doc_id")).cast("long").alias("rank"))
    marks = first.select("id", F.lit("words").alias("by")).unionByName(second.select("id", F.lit("similar").alias("by")))
    reason = marks.groupBy("id").agg(F.when(F.count("*") == 2, "words+similar").otherwise(F.min("by")).alias("reason"))
    return rrf(first, second).join(reason, "id").select("id", F.round("score", 9).alias("score"), "best", "reason")


@query("tag_filter", "SET-8 SCH-2", "SELECT doc_id FROM documents WHERE list_has_all([lower(lang), lower(source)], ['en', 'src1'])")
def tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.transform(F.array("lang", "source"), F.lower)
    return table(spark, sf, "documents").where(F.size(F.array_except(F.array(F.lit("en"), F.lit("src1")), tags)) == 0).select("doc_id")


@query("stale_vectors", "VEC-4 SRC-20 JOIN-12", """
    WITH now AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL), old AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0)
    SELECT doc_id FROM now WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.h = now.h) ORDER BY doc_id LIMIT 16""")
def stale_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose content hash an index of two thirds of the table lacks, 16 at a time."""
    now = table(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))
    return now.join(now.where("doc_id % 3 <> 0").select("h"), "h", "left_anti").select("doc_id").orderBy("doc_id").limit(16)


@query("brand_mentions_outside", "SCH-7", """
    WITH inside AS (SELECT 'Brand#' || i AS brand FROM range(1, 6) r(i)), said AS (SELECT p_partkey, unnest(regexp_extract_all(p_brand || ' and Brand#' || (p_size % 25 + 1), 'Brand#[0-9]+')) AS brand FROM part)
    SELECT DISTINCT p_partkey, brand FROM said WHERE brand NOT IN (SELECT brand FROM inside)""")
def brand_mentions_outside(spark: SparkSession, sf: str) -> DataFrame:
    """Longest brand names mentioned in a text that the scope does not hold."""
    text = F.concat("p_brand", F.lit(" and Brand#"), (F.col("p_size") % 25 + 1).cast("string"))
    said = table(spark, sf, "part").select("p_partkey", F.explode(F.regexp_extract_all(text, F.lit("Brand#[0-9]+"), F.lit(0))).alias("brand"))
    known = table(spark, sf, "part").select(F.col("p_brand").alias("brand")).distinct()
    return said.join(known, "brand", "left_semi").where(~F.col("brand").isin(*(f"Brand#{i}" for i in range(1, 6)))).select("p_partkey", "brand").distinct()
