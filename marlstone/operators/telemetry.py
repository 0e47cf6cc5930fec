"""Usage, traces, feedback, audit, conversations and evaluation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, table


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def prop(name: str) -> Column:
    return F.get_json_object("props", f"$.{name}")


def nearest_rank(values: Column, p: int) -> Column:
    """The value at rank ceil(n * p / 100); 0.0 without values."""
    ordered = F.sort_array(F.collect_list(values))
    at = F.greatest(F.lit(1), F.ceil(F.size(ordered) * F.lit(p) / 100)).cast("int")
    return F.when(F.size(ordered) == 0, 0.0).otherwise(F.try_element_at(ordered, at))


def nearest_rank_by(frame: DataFrame, key: str, value: str, points: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles by key without gathering a group: ranks by counts of distinct values."""
    counts = frame.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__n"))
    upto = counts.withColumn("__upto", F.sum("__n").over(W.partitionBy(key).orderBy(value))).withColumn("__all", F.sum("__n").over(W.partitionBy(key)))
    picks = [F.min(F.when(F.col("__upto") >= F.greatest(F.lit(1), F.ceil(F.col("__all") * p / 100)), F.col(value))).alias(f"p{p}") for p in points]
    return upto.groupBy(key).agg(*picks)


@query("latency_nearest_rank", "AGG-18", """
    WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, min(value) FILTER (k >= greatest(1, ceil(n * 50 / 100))) AS p50, min(value) FILTER (k >= greatest(1, ceil(n * 95 / 100))) AS p95 FROM r GROUP BY 1""")
def latency_nearest_rank(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_rank_by(events(spark, sf), "event_type", "value", (50, 95))


@query("quota_hourly", "AGG-20 STM-1", "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS win, count(*) AS used FROM events GROUP BY 1, 2")
def quota_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("used")).select("user_id", F.col("w.start").alias("win"), "used")


@query("quota_daily", "AGG-20 STM-1 GOV-24", "SELECT user_id, ts::DATE AS day, round(sum(value), 4) AS used, sum(value) > 500 AS over FROM events GROUP BY 1, 2")
def quota_daily(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("used"), (F.sum("value") > 500).alias("over"))


@query("trace_metrics", "AGG-19 OBS-2 SRC-15", """
    SELECT event_type, count(*) AS spans, count(*) FILTER (try_cast(props->>'$.k' AS INTEGER) > 90) AS slow, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users,
      round(count(*) FILTER (value > 100) / count(*), 6) AS error_rate FROM events GROUP BY 1""")
def trace_metrics(spark: SparkSession, sf: str) -> DataFrame:
    k = prop("k").try_cast("int")
    return events(spark, sf).groupBy("event_type").agg(
        F.count("*").alias("spans"), F.count_if(k > 90).alias("slow"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("users"),
        F.round(F.count_if(F.col("value") > 100) / F.count("*"), 6).alias("error_rate"),
    )


@query("root_cause", "OBS-3 JOIN-16 OBS-4", """
    WITH t AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'error') AS errors, max(value) AS slowest, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1, 2)
    SELECT user_id, day, CASE WHEN errors > 2 THEN 'many_errors' WHEN errors > 0 THEN 'error' WHEN slowest > 150 THEN 'slow' WHEN clicks = 0 THEN 'no_click' WHEN n < 3 THEN 'thin' ELSE 'unknown' END AS cause FROM t""")
def root_cause(spark: SparkSession, sf: str) -> DataFrame:
    """Per turn (user and day), conditional aggregates and one ordered chain of rules."""
    kind = F.col("event_type")
    t = events(spark, sf).groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(kind == "error").alias("errors"), F.max("value").alias("slowest"), F.count("*").alias("n"), F.count_if(kind == "click").alias("clicks")
    )
    cause = (
        F.when(F.col("errors") > 2, "many_errors").when(F.col("errors") > 0, "error").when(F.col("slowest") > 150, "slow").when(F.col("clicks") == 0, "no_click")
        .when(F.col("n") < 3, "thin").otherwise("unknown")
    )
    return t.select("user_id", "day", cause.alias("cause"))


@query("feedback_latest", "STO-6 STO-8 SRT-10", """
    SELECT user_id, ts::DATE AS turn, event_id, CASE WHEN event_type = 'error' THEN 'down' ELSE 'up' END AS rating FROM events WHERE event_type IN ('click', 'error')
    QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1""")
def feedback_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A later rating of the same turn replaces the earlier one."""
    rated = events(spark, sf).where(F.col("event_type").isin("click", "error")).withColumn("turn", F.to_date("ts"))
    last = rated.groupBy("user_id", "turn").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    return last.select("user_id", "turn", F.col("e.event_id").alias("event_id"), F.when(F.col("e.event_type") == "error", "down").otherwise("up").alias("rating"))


@query("feedback_counts", "AGG-17", """
    SELECT count(*) FILTER (event_type = 'click') AS up, count(*) FILTER (event_type = 'error') AS down,
      round(count(*) FILTER (event_type = 'error') / nullif(count(*) FILTER (event_type IN ('click', 'error')), 0), 6) AS down_rate FROM events""")
def feedback_counts(spark: SparkSession, sf: str) -> DataFrame:
    up, down = F.count_if(F.col("event_type") == "click"), F.count_if(F.col("event_type") == "error")
    return events(spark, sf).agg(up.alias("up"), down.alias("down"), F.round(F.try_divide(down, up + down), 6).alias("down_rate"))


@query("audit_explode", "JOIN-14", """
    SELECT event_id, unnest(['user:' || user_id, 'k:' || (props->>'$.k')]) AS target FROM events WHERE event_type = 'purchase' AND props->>'$.k' IS NOT NULL""")
def audit_explode(spark: SparkSession, sf: str) -> DataFrame:
    targets = F.to_json(F.array(F.concat(F.lit("user:"), "user_id"), F.concat(F.lit("k:"), prop("k"))))
    rows = events(spark, sf).where((F.col("event_type") == "purchase") & prop("k").isNotNull()).withColumn("targets", targets)
    return rows.select("event_id", F.explode(F.from_json("targets", "array<string>")).alias("target"))


@query("audit_dedupe", "STO-1 STO-4", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def audit_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of an idempotency key stays."""
    return events(spark, sf).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("audit_page", "SRT-9", "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND event_id > 100 ORDER BY event_id LIMIT 100")
def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where((F.col("event_type") == "view") & (F.col("event_id") > 100)).select("event_id", "user_id").orderBy("event_id").limit(100)


@query("erase_user", "STO-3 JOIN-15 STO-2", """
    WITH gone AS (SELECT DISTINCT user_id FROM events WHERE user_id % 10 = 3)
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'erased-' || left(sha256(user_id::VARCHAR), 8) ELSE user_id::VARCHAR END AS actor FROM events
    WHERE event_type = 'error' OR user_id NOT IN (SELECT user_id FROM gone)""")
def erase_user(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of erased users go; audit rows (errors here) stay under a pseudonym."""
    e = events(spark, sf)
    gone = e.where("user_id % 10 = 3").select("user_id").distinct()
    audit = e.where("event_type = 'error'").select("event_id", F.concat(F.lit("erased-"), F.left(F.sha2(F.col("user_id").cast("string"), 256), F.lit(8))).alias("actor"))
    rest = e.where("event_type <> 'error'").join(gone, "user_id", "left_anti").select("event_id", F.col("user_id").cast("string").alias("actor"))
    return audit.unionByName(rest)


@query("erase_plan", "AGG-27", "SELECT event_type, count(*) AS n FROM events WHERE user_id % 10 = 3 GROUP BY 1")
def erase_plan(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).where("user_id % 10 = 3").groupBy("event_type").agg(F.count("*").alias("n"))


@query("fingerprint_retention", "STO-9 STM-2", "SELECT user_id, count(*) AS kept FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def fingerprint_retention(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return e.where(F.col("ts") >= e.agg(F.max("ts") - F.expr("interval 7 days")).scalar()).groupBy("user_id").agg(F.count("*").alias("kept"))


# -- conversations ----------------------------------------------------------------------


@query("conversation_turns", "CTX-1", """
    SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS exchange FROM conversations""")
def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("exchange"))


@query("history_window", "CTX-2 CTX-3", """
    WITH r AS (SELECT conv_id, turn, least(length(text), 4000) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations),
    s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY age) AS total FROM r WHERE age <= 12)
    SELECT conv_id, turn, n::INTEGER AS chars FROM s WHERE total <= 48000""")
def history_window(spark: SparkSession, sf: str) -> DataFrame:
    """The last 12 turns within 48,000 characters, 4,000 a message; the oldest leave first."""
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = table(spark, sf, "conversations").select("conv_id", "turn", F.least(F.length("text"), F.lit(4000)).alias("chars"), F.row_number().over(newest).alias("age")).where("age <= 12")
    return r.withColumn("total", F.sum("chars").over(W.partitionBy("conv_id").orderBy("age"))).where("total <= 48000").select("conv_id", "turn", "chars")


@query("drop_counts", "CTX-4", "SELECT role, CASE WHEN length(text) > 400 THEN 'long' ELSE 'kept' END AS reason, count(*) AS n FROM conversations GROUP BY 1, 2")
def drop_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("role", F.when(F.length("text") > 400, "long").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


@query("intent_classes", "CLS-1 CLS-2 CLS-3", r"""
    SELECT conv_id, turn, regexp_matches(lower(text), '\b(top|best|biggest)\b.*\b(customers?|buyers?|clients?)\b') AS ranking, regexp_matches(lower(text), '\b(email|phone|address)\b') AS personal,
      regexp_matches(lower(text), '^\s*(select|with)\b') AS sql_request, regexp_matches(lower(text), '^\s*(it|that|those|them|this)\b') AS unresolved FROM conversations WHERE text IS NOT NULL""")
def intent_classes(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, sf, "conversations").where("text is not null").select(
        "conv_id", "turn", t.rlike(r"\b(top|best|biggest)\b.*\b(customers?|buyers?|clients?)\b").alias("ranking"), t.rlike(r"\b(email|phone|address)\b").alias("personal"),
        t.rlike(r"^\s*(select|with)\b").alias("sql_request"), t.rlike(r"^\s*(it|that|those|them|this)\b").alias("unresolved"),
    )


# -- evaluation ------------------------------------------------------------------------------


@query("gates_recall", "AGG-24 EVL-2 EVL-3", """
    WITH r AS (SELECT toxic, quality, d.lang, contains(text, '###') OR contains(text, '!!') AS flagged FROM labels JOIN documents d USING (doc_id))
    SELECT lang, count(*) AS cases, round(count(*) FILTER (flagged AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0), 6) AS recall,
      count(*) FILTER (flagged AND quality = 1) AS false_positives, coalesce(count(*) FILTER (flagged AND quality = 0) / nullif(count(*) FILTER (quality = 0), 0) >= 0.5, false) AS passed FROM r GROUP BY 1""")
def gates_recall(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    r = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select("lang", "quality", (t.contains("###") | t.contains("!!")).alias("flagged"))
    bad = F.col("quality") == 0
    recall = F.try_divide(F.count_if(F.col("flagged") & bad), F.count_if(bad))
    return r.groupBy("lang").agg(F.count("*").alias("cases"), F.round(recall, 6).alias("recall"), F.count_if(F.col("flagged") & ~bad).alias("false_positives"), F.coalesce(recall >= 0.5, F.lit(False)).alias("passed"))


@query("gates_matrix", "AGG-26 EVL-5", """
    SELECT quality, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'es') AS es, count(*) FILTER (lang = 'fr') AS fr FROM labels JOIN documents USING (doc_id) GROUP BY 1""")
def gates_matrix(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return joined.groupBy("quality").pivot("lang", ["de", "en", "es", "fr"]).agg(F.count("doc_id")).na.fill(0, ["de", "en", "es", "fr"])


@query("judge_agreement", "AGG-25", "SELECT round(avg(CASE WHEN (quality >= 1) = (toxic < 1) THEN 1 ELSE 0 END), 6) AS agreement FROM labels")
def judge_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").agg(F.round(F.avg(((F.col("quality") >= 1) == (F.col("toxic") < 1)).cast("int")), 6).alias("agreement"))


@query("expectation_checks", "EVL-1 EVL-6", """
    SELECT doc_id, contains(text, 'the') OR contains(text, 'de') AS must_contain, NOT contains(text, '@') AS must_not_contain FROM documents WHERE text IS NOT NULL""")
def expectation_checks(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "documents").where("text is not null").select("doc_id", (t.contains("the") | t.contains("de")).alias("must_contain"), (~t.contains("@")).alias("must_not_contain"))


@query("injection_scan", "GRD-x")
def injection_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rule codes of conversation texts; no oracle, the scan folds Unicode."""
    from ..guards import injection_code

    return table(spark, sf, "conversations").where("text is not null").select(injection_code("text").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("stream_usage", "STM-1 STM-6", "SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS win, count(*) AS used FROM events GROUP BY 1, 2")
def stream_usage(spark: SparkSession, sf: str) -> DataFrame:
    """The stream twin of quota_hourly, run to the end of what is there."""
    import tempfile
    import uuid

    from ..streaming import quotas

    base = (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='marlstone-stream-')}").rstrip("/") + f"/usage-{uuid.uuid4().hex}"
    quotas.run_complete(quotas.usage(quotas.read_events(spark, sf)), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").withColumn("win", F.col("win").cast("timestamp_ntz"))
