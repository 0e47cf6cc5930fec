"""Trace spans as JSON lines: an allowlisted sink, and a source that counts bad lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "trace_id string, span_id string, parent_id string, type string, name string, ts double, duration_ms double, status string, session_id string, turn_id string, error_class string, tokens long, bytes long, outcome string"
#: Fields beyond the common ones that each span type may carry.
ALLOWED = {"llm": {"tokens"}, "sql": {"bytes", "outcome"}, "guard": {"outcome"}}
COMMON = {"trace_id", "span_id", "parent_id", "type", "name", "ts", "duration_ms", "status", "session_id", "turn_id", "error_class"}
SECRET = r"(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*\S+|Bearer\s+\S+"


def allowed(spans: DataFrame) -> DataFrame:
    """Only the fields a span's type may carry, text without secrets."""
    out = spans
    for name in ("tokens", "bytes", "outcome"):
        types = [t for t, fields in ALLOWED.items() if name in fields]
        out = out.withColumn(name, F.when(F.col("type").isin(*types), F.col(name)))
    return out.withColumn("name", F.regexp_replace("name", SECRET, "<SECRET>"))


def write(spans: DataFrame, path: str) -> None:
    allowed(spans).write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(spans, one row ``malformed``).  Lines that are no span are left out and counted."""
    raw = spark.read.schema(FIELDS + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    good = F.col("_corrupt").isNull() & F.col("type").isNotNull()
    return allowed(raw.where(good).drop("_corrupt")), raw.agg(F.count_if(~good).alias("malformed"))


def summary(spans: DataFrame) -> DataFrame:
    """Spans, errors, tokens and bytes by type, with nearest-rank latency."""
    from ..operators.telemetry import nearest_rank_by

    counts = spans.groupBy("type").agg(
        F.count("*").alias("spans"), F.round(F.avg((F.col("status") == "error").cast("int")), 6).alias("error_rate"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")
    )
    return counts.join(nearest_rank_by(spans, "type", "duration_ms", (50, 95)), "type", "left")
