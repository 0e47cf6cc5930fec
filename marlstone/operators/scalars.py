"""Scalar function packs, including the dialect's own semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dialect as D
from ..registry import query, table


@query("str_pack", "STR-1 STR-2 STR-3 STR-4 STR-5 STR-6 STR-7 STR-8 STR-9 STR-10", """
    SELECT p_partkey, p_brand || '-' || p_type AS joined, substr(p_name, 2, 3) AS part, replace(p_brand, '#', '/') AS slashed, lpad(p_brand, 10, '*') AS lp, rpad(p_brand, 10, '.') AS rp,
      left(p_name, 2) AS l2, right(p_name, 2) AS r2, starts_with(p_brand, 'Brand#1') AS sw, ends_with(p_brand, '5') AS ew, contains(lower(p_name), 'a') AS has, instr(p_brand, '#')::INTEGER AS pos,
      trim('  ' || p_brand || ' ') AS trimmed, ltrim('xx' || p_brand, 'x') AS lt, upper(p_brand) AS up, lower(p_brand) AS low, length(p_name)::INTEGER AS n FROM part""")
def str_pack(spark: SparkSession, sf: str) -> DataFrame:
    b, n = F.col("p_brand"), F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", F.concat(b, F.lit("-"), "p_type").alias("joined"), F.substring(n, 2, 3).alias("part"), F.replace(b, F.lit("#"), F.lit("/")).alias("slashed"),
        F.lpad(b, 10, "*").alias("lp"), F.rpad(b, 10, ".").alias("rp"), F.left(n, F.lit(2)).alias("l2"), F.right(n, F.lit(2)).alias("r2"), F.startswith(b, F.lit("Brand#1")).alias("sw"),
        F.endswith(b, F.lit("5")).alias("ew"), D.contains_substr(n, "A").alias("has"), F.instr(b, "#").alias("pos"), F.trim(F.concat(F.lit("  "), b, F.lit(" "))).alias("trimmed"),
        F.ltrim(F.concat(F.lit("xx"), b), F.lit("x")).alias("lt"), F.upper(b).alias("up"), F.lower(b).alias("low"), F.length(n).alias("n"),
    )


@query("initcap_pack", "STR-9", "SELECT p_partkey, list_aggregate(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS title FROM part")
def initcap_pack(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.initcap("p_type").alias("title"))


@query("regex_pack", "STR-11 STR-12 STR-13", r"""
    SELECT p_partkey, regexp_matches(p_brand, '#1[0-9]') AS has, CASE WHEN regexp_matches(p_brand, '#(1[0-9])') THEN regexp_extract(p_brand, '#(1[0-9])', 1) END AS number,
      CASE WHEN regexp_matches(p_brand, '[0-9]+') THEN regexp_extract(p_brand, '[0-9]+') END AS digits, regexp_replace(p_brand, '([A-Za-z]+)#([0-9]+)', '\2 \1') AS swapped FROM part""")
def regex_pack(spark: SparkSession, sf: str) -> DataFrame:
    b = F.col("p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", b.rlike("#1[0-9]").alias("has"), D.regexp_extract(b, "#(1[0-9])").alias("number"), D.regexp_extract(b, "[0-9]+").alias("digits"),
        F.regexp_replace(b, "([A-Za-z]+)#([0-9]+)", "$2 $1").alias("swapped"),
    )


@query("math_pack", "MTH-1 MTH-2 MTH-3 MTH-4 MTH-5", """
    SELECT c_custkey, round(c_acctbal, 1) AS r, ceil(c_acctbal)::BIGINT AS c, floor(c_acctbal)::BIGINT AS f, abs(c_acctbal) AS a, round(sqrt(abs(c_acctbal)), 6) AS s, pow(c_nationkey, 2)::DOUBLE AS p,
      round(ln(abs(c_acctbal) + 1), 6) AS l, round(exp(c_nationkey / 10), 6) AS e, sign(c_acctbal)::DOUBLE AS sg, round(log10(abs(c_acctbal) + 1), 6) AS lg,
      (c_custkey % 7) AS m, (c_custkey // 7) AS d, CASE WHEN c_nationkey > 5 THEN greatest(c_nationkey, 10) END AS g, least(c_nationkey, 10) AS le,
      CASE WHEN c_nationkey = 0 THEN NULL ELSE round(c_acctbal / c_nationkey, 6) END AS q FROM customer""")
def math_pack(spark: SparkSession, sf: str) -> DataFrame:
    x, k = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        "c_custkey", F.round(x, 1).alias("r"), F.ceil(x).alias("c"), F.floor(x).alias("f"), F.abs(x).alias("a"), F.round(F.sqrt(F.abs(x)), 6).alias("s"), F.pow(k, F.lit(2)).alias("p"),
        F.round(F.ln(F.abs(x) + 1), 6).alias("l"), F.round(F.exp(k / 10), 6).alias("e"), F.sign(x).alias("sg"), F.round(D.log(F.abs(x) + 1, 10), 6).alias("lg"),
        (F.col("c_custkey") % 7).alias("m"), F.expr("c_custkey div 7").alias("d"), D.greatest(F.when(k > 5, k), F.lit(10)).alias("g"), D.least(k, F.lit(10)).alias("le"),
        F.round(D.safe_divide(x, k), 6).alias("q"),
    )


@query("safe_arithmetic", "MTH-5", "SELECT c_custkey, c_custkey + 1 AS plus, c_custkey - 1 AS minus, c_custkey * 2 AS times, NULL::BIGINT AS overflow FROM customer")
def safe_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    k, most = F.col("c_custkey"), F.lit((1 << 63) - 1)
    return table(spark, sf, "customer").select("c_custkey", F.try_add(k, F.lit(1)).alias("plus"), F.try_subtract(k, F.lit(1)).alias("minus"), F.try_multiply(k, F.lit(2)).alias("times"), F.try_add(most, F.abs(k) + 1).alias("overflow"))


@query("cast_pack", "CST-1 CST-2 CND-1", """
    SELECT p_partkey, p_size::VARCHAR AS txt, try_cast(replace(p_brand, 'Brand#', '') AS INTEGER) AS num, try_cast(p_brand AS INTEGER) AS bad, coalesce(try_cast(p_brand AS INTEGER), -1) AS filled,
      nullif(p_size, 1) AS ni, CASE WHEN p_size > 25 THEN 'b' ELSE 's' END AS cond, strptime('2024-03-0' || (p_size % 9 + 1), '%Y-%m-%d')::DATE AS day FROM part""")
def cast_pack(spark: SparkSession, sf: str) -> DataFrame:
    b, s = F.col("p_brand"), F.col("p_size")
    day = F.to_date(F.concat(F.lit("2024-03-0"), (s % 9 + 1).cast("string")), "yyyy-MM-dd")
    return table(spark, sf, "part").select(
        "p_partkey", s.cast("string").alias("txt"), F.replace(b, F.lit("Brand#"), F.lit("")).try_cast("int").alias("num"), b.try_cast("int").alias("bad"),
        F.coalesce(b.try_cast("int"), F.lit(-1)).alias("filled"), F.nullif(s, F.lit(1)).alias("ni"), F.when(s > 25, "b").otherwise("s").alias("cond"), day.alias("day"),
    )


@query("date_pack", "DT-1 DT-2 DT-3 DT-6 DT-8 DT-9 DT-10", """
    SELECT o_orderkey, o_orderdate::DATE AS day, date_trunc('month', o_orderdate)::DATE AS month, date_trunc('quarter', o_orderdate)::DATE AS quarter, date_trunc('year', o_orderdate)::DATE AS year,
      (o_orderdate::DATE - dayofweek(o_orderdate)::INTEGER) AS sunday_week, (o_orderdate::DATE + INTERVAL 3 DAY)::DATE AS plus3, (o_orderdate::DATE - INTERVAL 1 MONTH)::DATE AS minus_month,
      year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, (dayofweek(o_orderdate) + 1)::INTEGER AS dow, dayofyear(o_orderdate)::INTEGER AS doy,
      floor((dayofyear(o_orderdate) + 6 - dayofweek(o_orderdate)) / 7)::INTEGER AS week, last_day(o_orderdate) AS last, strftime(o_orderdate, '%Y/%m') AS text, make_date(year(o_orderdate), 1, 2) AS made FROM orders""")
def date_pack(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        "o_orderkey", day.alias("day"), F.trunc(day, "MM").alias("month"), F.trunc(day, "quarter").alias("quarter"), F.trunc(day, "year").alias("year"), D.trunc_week(day).alias("sunday_week"),
        F.date_add(day, 3).alias("plus3"), F.add_months(day, -1).alias("minus_month"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofweek(day).alias("dow"), F.dayofyear(day).alias("doy"),
        D.week_of_year(day).alias("week"), F.last_day(day).alias("last"), F.date_format(day, "yyyy/MM").alias("text"), F.make_date(F.year(day), F.lit(1), F.lit(2)).alias("made"),
    )


@query("diff_boundary_pack", "DT-4 DT-5", """
    WITH d AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS a, o_orderdate::DATE AS b, l_shipdate AS ta, o_orderdate AS tb FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_orderkey, l_linenumber, date_diff('day', b, a)::INTEGER AS days, ((a - dayofweek(a)::INTEGER) - (b - dayofweek(b)::INTEGER)) // 7 AS weeks,
      date_diff('month', b, a)::INTEGER AS months, date_diff('quarter', b, a)::INTEGER AS quarters, date_diff('year', b, a)::INTEGER AS years, date_sub('hour', tb, ta) AS whole_hours FROM d""")
def diff_boundary_pack(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.to_date("l_shipdate"), F.to_date("o_orderdate")
    return joined.select(
        "l_orderkey", "l_linenumber", *(D.date_diff(a, b, u).alias(n) for u, n in (("DAY", "days"), ("WEEK", "weeks"), ("MONTH", "months"), ("QUARTER", "quarters"), ("YEAR", "years"))),
        F.timestamp_diff("HOUR", "o_orderdate", "l_shipdate").alias("whole_hours"),
    )


@query("current_times", "DT-7")
def current_times(spark: SparkSession, sf: str) -> DataFrame:
    """One value per statement; no oracle, the clock differs."""
    return spark.range(1).select(F.current_date().alias("day"), F.current_timestamp().alias("at"))
