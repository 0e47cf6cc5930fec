"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame that is written as Parquet and reread as the next
stage's docs.  All but the last return the columns of ``documents``.  Decisions
are by row, so rows that repeat a doc_id, or have none, are told apart: of a
group of copies exactly one row stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import stored
from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.mixing import mix
from marlstone.llm.neardup import near_dedup
from marlstone.llm.packing import pack
from marlstone.llm.quality import accepted, fit

#: Near copies here are those of op3's method from 0.8 on; 0.85 is the contract of its query alone.
NEAR = 80


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with ``__row``, a hash of the row's place in its file: the same whenever
    it is read.  Two rows of one doc_id that shared it would be told apart by nothing,
    so it is always compared together with doc_id.  What is not read from files is
    written first."""
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("__row")
    try:
        return docs.select("*", place)
    except AnalysisException:
        return stored(docs, "pipeline-rows").select("*", place)


def _with(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """docs joined with what was decided by row (doc_id, row, ...)."""
    named = decided.withColumnsRenamed({"doc_id": "__decided_id", "row": "__decided_row"})
    return docs.join(named, (F.col("__row") == F.col("__decided_row")) & F.col("doc_id").eqNullSafe(F.col("__decided_id")), how)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; the rest go."""
    return accepted(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the largest doc_id."""
    rows = _numbered(docs)
    return _with(rows, exact_dedup(rows, row=F.col("__row")).where("first").select("doc_id", "row"), "left_semi").select(docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, of a similarity of ``NEAR`` hundredths or more."""
    rows = _numbered(docs)
    return _with(rows, near_dedup(rows, similarity=NEAR, row=F.col("__row")).where("first").select("doc_id", "row"), "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows = _numbered(docs)
    copies = mix(rows, row=F.col("__row")).where("copies > 0").select("doc_id", "row", F.col("copies").alias("__copies"))
    return _with(rows, copies, "inner").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("minhash near-dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learned scores or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
