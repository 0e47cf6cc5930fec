"""Joins, aggregates, windows, sorts and set operations of the query language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, table


def part(spark, sf):
    return table(spark, sf, "part")


def customer(spark, sf):
    return table(spark, sf, "customer")


def orders(spark, sf):
    return table(spark, sf, "orders")


def lineitem(spark, sf):
    return table(spark, sf, "lineitem")


# -- joins ---------------------------------------------------------------------


@query("join_inner", "JOIN-1 PRJ-1", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).join(customer(spark, sf), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("join_left", "JOIN-2", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def join_left(spark: SparkSession, sf: str) -> DataFrame:
    return customer(spark, sf).join(orders(spark, sf), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("join_right", "JOIN-2", "SELECT c_nationkey, n_name, count(c_custkey) AS n FROM customer RIGHT JOIN nation ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1, 2")
def join_right(spark: SparkSession, sf: str) -> DataFrame:
    on = (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > 9000)
    return customer(spark, sf).join(table(spark, sf, "nation"), on, "right").groupBy("c_nationkey", "n_name").agg(F.count("c_custkey").alias("n"))


@query("join_full", "JOIN-2", """
    SELECT coalesce(s_nationkey, c_nationkey) AS nation, suppliers, customers FROM
      (SELECT s_nationkey, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
      FULL JOIN (SELECT c_nationkey, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON s_nationkey = c_nationkey""")
def join_full(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    c = customer(spark, sf).where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    return s.join(c, F.col("s_nationkey") == F.col("c_nationkey"), "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nation"), "suppliers", "customers")


@query("join_cross", "JOIN-3", "SELECT r_name, n_name FROM region, nation")
def join_cross(spark: SparkSession, sf: str) -> DataFrame:
    """Two fixed lists of the schema, 5 and 25 rows."""
    return table(spark, sf, "region").crossJoin(table(spark, sf, "nation")).select("r_name", "n_name")


@query("join_theta", "JOIN-4", """
    SELECT r.r_name, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
    JOIN region r ON r.r_regionkey = a.n_regionkey GROUP BY 1""")
def join_theta(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return pairs.join(table(spark, sf, "region"), F.col("a.n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("join_self", "JOIN-5", """
    SELECT a.p_brand, count(*) AS n FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey GROUP BY 1""")
def join_self(spark: SparkSession, sf: str) -> DataFrame:
    a, b = part(spark, sf).alias("a"), part(spark, sf).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_brand", "p_size", "p_type")]
    return a.join(b, [*same, F.col("a.p_partkey") < F.col("b.p_partkey")]).groupBy(F.col("a.p_brand").alias("p_brand")).agg(F.count("*").alias("n"))


@query("join_semi", "JOIN-6", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def join_semi(spark: SparkSession, sf: str) -> DataFrame:
    big = orders(spark, sf).where("o_totalprice > 300000").select("o_custkey")
    return customer(spark, sf).join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("join_anti", "JOIN-7", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def join_anti(spark: SparkSession, sf: str) -> DataFrame:
    done = orders(spark, sf).where("o_orderstatus = 'F'")
    return customer(spark, sf).join(done, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("join_exists", "JOIN-7", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49) GROUP BY 1")
def join_exists(spark: SparkSession, sf: str) -> DataFrame:
    heavy = lineitem(spark, sf).where("l_quantity > 49")
    return orders(spark, sf).join(heavy, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("join_not_in", "JOIN-8", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 40)")
def join_not_in(spark: SparkSession, sf: str) -> DataFrame:
    """NOT IN over a list that holds a null keeps nothing; null keys are kept only by an empty list.

    As NOT IN it would be planned as a broadcast of the whole list.
    """
    part(spark, sf).createOrReplaceTempView("part_for_not_in")
    lineitem(spark, sf).where("l_quantity < 40").select("l_partkey").createOrReplaceTempView("list_for_not_in")
    return spark.sql("""
        SELECT p_partkey FROM part_for_not_in LEFT ANTI JOIN (SELECT DISTINCT l_partkey FROM list_for_not_in) ON p_partkey = l_partkey
        WHERE NOT EXISTS (SELECT 1 FROM list_for_not_in WHERE l_partkey IS NULL) AND (p_partkey IS NOT NULL OR NOT EXISTS (SELECT 1 FROM list_for_not_in))""")


# -- projections and filters -----------------------------------------------------


@query("filter_pack", "PRJ-1 PRJ-3 PRJ-4 PRJ-5 FLT-1 FLT-2 FLT-3 FLT-4 FLT-5 FLT-6 FLT-9", """
    SELECT DISTINCT p_brand, p_type, -p_size AS minus_size, CASE WHEN p_size > 40 THEN 'large' WHEN p_size > 20 THEN 'middle' ELSE 'small' END AS size_class, DATE '2024-01-01' + 1 AS day
    FROM part WHERE (p_size BETWEEN 10 AND 45 OR p_brand LIKE 'Brand#1%') AND p_type NOT IN ('none') AND p_name IS NOT NULL AND NOT p_size = 11 AND (p_retailprice > 950) IS TRUE""")
def filter_pack(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    kept = part(spark, sf).where(
        (size.between(10, 45) | F.col("p_brand").like("Brand#1%")) & ~F.col("p_type").isin("none") & F.col("p_name").isNotNull() & ~(size == 11) & (F.col("p_retailprice") > 950).eqNullSafe(True)
    )
    label = F.when(size > 40, "large").when(size > 20, "middle").otherwise("small")
    return kept.select("p_brand", "p_type", (-size).alias("minus_size"), label.alias("size_class"), F.date_add(F.lit("2024-01-01").cast("date"), 1).alias("day")).distinct()


@query("scalar_subquery", "PRJ-6 SRC-4", "SELECT o_orderkey, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 6) AS of_max FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def scalar_subquery(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    most, mean = o.agg(F.max("o_totalprice")).scalar(), o.agg(F.avg("o_totalprice")).scalar()
    return o.where(F.col("o_totalprice") > mean).select("o_orderkey", F.round(F.col("o_totalprice") / most, 6).alias("of_max"))


@query("literal_select", "SRC-5", "SELECT 1 AS x, 'a' AS y, NULL::INTEGER AS z")
def literal_select(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT 1 AS x, 'a' AS y, CAST(NULL AS INT) AS z")


@query("nested_cte", "SRC-4", """
    WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), by_cust AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY 1)
    SELECT n, count(*) AS customers FROM (SELECT * FROM by_cust) AS x GROUP BY n""")
def nested_cte(spark: SparkSession, sf: str) -> DataFrame:
    by_cust = orders(spark, sf).where("o_totalprice > 100000").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return by_cust.groupBy("n").agg(F.count("*").alias("customers"))


@query("having_filter", "FLT-7", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def having_filter(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 12")


# -- aggregates --------------------------------------------------------------------


@query("agg_basic", "AGG-1 AGG-4 AGG-5 AGG-12 AGG-16", """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, min(l_tax) AS low, max(l_tax) AS high FROM lineitem GROUP BY 1, 2""")
def agg_basic(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high")
    )


@query("agg_distinct", "AGG-2", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states FROM orders GROUP BY 1")
def agg_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("customers"), F.count_distinct("o_orderstatus").alias("states"))


@query("agg_stats", "AGG-8", """
    SELECT p_type, round(stddev_samp(p_retailprice), 6) AS sd, round(stddev_pop(p_retailprice), 6) AS sdp, round(var_samp(p_retailprice), 4) AS v, round(var_pop(p_retailprice), 4) AS vp FROM part GROUP BY 1""")
def agg_stats(spark: SparkSession, sf: str) -> DataFrame:
    x = "p_retailprice"
    return part(spark, sf).groupBy("p_type").agg(
        F.round(F.stddev_samp(x), 6).alias("sd"), F.round(F.stddev_pop(x), 6).alias("sdp"), F.round(F.var_samp(x), 4).alias("v"), F.round(F.var_pop(x), 4).alias("vp")
    )


@query("agg_percentiles", "AGG-9", """
    SELECT p_brand, median(p_retailprice) AS med, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, quantile_disc(p_size, 0.25) AS q1 FROM part GROUP BY 1""")
def agg_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    part(spark, sf).createOrReplaceTempView("part_for_percentiles")
    return spark.sql("""SELECT p_brand, median(p_retailprice) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY p_retailprice), 6) AS p90,
        CAST(percentile_disc(0.25) WITHIN GROUP (ORDER BY p_size) AS INT) AS q1 FROM part_for_percentiles GROUP BY 1""")


@query("agg_bool", "AGG-10 AGG-3", "SELECT o_orderstatus, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_totalprice > 400000) AS any_huge, count(*) FILTER (o_totalprice > 200000) AS big FROM orders GROUP BY 1")
def agg_bool(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("o_totalprice")
    return orders(spark, sf).groupBy("o_orderstatus").agg(F.bool_and(t > 1000).alias("all_big"), F.bool_or(t > 400000).alias("any_huge"), F.count_if(t > 200000).alias("big"))


@query("agg_corr", "AGG-11", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1")
def agg_corr(spark: SparkSession, sf: str) -> DataFrame:
    return lineitem(spark, sf).groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("agg_string", "AGG-6", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations, string_agg(DISTINCT r_name, ',') AS once FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_string(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).createOrReplaceTempView("nations_for_listagg")
    return spark.sql("SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations, listagg(DISTINCT r_name, ',') AS once FROM nations_for_listagg GROUP BY 1")


@query("agg_approx_distinct", "AGG-7")
def agg_approx_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """No oracle: the sketch's error is its own."""
    return lineitem(spark, sf).groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"))


@query("agg_any_value", "AGG-5", "SELECT n_regionkey, any_value(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def agg_any_value(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_regionkey").agg(F.any_value("r_name").alias("r_name"))


@query("agg_group_all", "AGG-13", "SELECT p_brand, p_type, count(*) AS n, sum(p_size)::BIGINT AS size FROM part GROUP BY ALL")
def agg_group_all(spark: SparkSession, sf: str) -> DataFrame:
    part(spark, sf).createOrReplaceTempView("part_for_group_all")
    return spark.sql("SELECT p_brand, p_type, count(*) AS n, sum(p_size) AS size FROM part_for_group_all GROUP BY ALL")


@query("agg_conditional", "AGG-15", "SELECT l_linestatus, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned, count(CASE WHEN l_discount > 0.05 THEN 1 END) AS discounted FROM lineitem GROUP BY 1")
def agg_conditional(spark: SparkSession, sf: str) -> DataFrame:
    returned = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0)
    return lineitem(spark, sf).groupBy("l_linestatus").agg(F.round(F.sum(returned), 2).alias("returned"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("discounted"))


# -- windows -------------------------------------------------------------------------


@query("win_rank_family", "WIN-1 WIN-2 WIN-3", """
    SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr,
      round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)""")
def win_rank_family(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("p_brand").orderBy("p_size")
    full = W.partitionBy("p_brand").orderBy("p_size", "p_partkey")
    return part(spark, sf).select(
        "p_partkey", F.row_number().over(full).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"),
        F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
    )


@query("win_ntile", "WIN-4", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quartile FROM customer")
def win_ntile(spark: SparkSession, sf: str) -> DataFrame:
    return customer(spark, sf).select("c_custkey", F.ntile(4).over(W.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("quartile"))


@query("win_lag_lead", "WIN-5", """
    SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2, 0) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def win_lag_lead(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return orders(spark, sf).select("o_orderkey", F.lag("o_totalprice").over(w).alias("before"), F.lead("o_totalprice", 2, 0.0).over(w).alias("later"))


@query("win_first_last_nth", "WIN-6", """
    SELECT o_orderkey, first_value(o_orderkey) OVER w AS first, last_value(o_orderkey) OVER w AS last, nth_value(o_orderkey, 2) OVER w AS second FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def win_first_last_nth(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    key = "o_orderkey"
    return orders(spark, sf).select(key, F.first_value(key).over(w).alias("first"), F.last_value(key).over(w).alias("last"), F.nth_value(key, 2).over(w).alias("second"))


@query("win_frame_rows", "WIN-7 WIN-8", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM orders")
def win_frame_rows(spark: SparkSession, sf: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)
    return orders(spark, sf).select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("moving"))


@query("win_frame_range", "WIN-8", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part")
def win_frame_range(spark: SparkSession, sf: str) -> DataFrame:
    return part(spark, sf).select("p_partkey", F.count("*").over(W.partitionBy("p_brand").orderBy("p_size").rangeBetween(-2, 2)).alias("near"))


@query("win_share", "WIN-9", "SELECT p_brand, sum(p_size)::BIGINT AS size, round(sum(p_size) / sum(sum(p_size)) OVER (), 6)::DOUBLE AS share FROM part GROUP BY 1")
def win_share(spark: SparkSession, sf: str) -> DataFrame:
    by = part(spark, sf).groupBy("p_brand").agg(F.sum("p_size").alias("size"))
    return by.withColumn("share", F.round(F.col("size") / F.sum("size").over(W.partitionBy()), 6))


@query("win_qualify", "WIN-10 FLT-8", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def win_qualify(spark: SparkSession, sf: str) -> DataFrame:
    best = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return orders(spark, sf).withColumn("place", best).where("place = 1").select("o_custkey", "o_orderkey")


# -- sorts, limits, sets ----------------------------------------------------------------


@query("sort_limit_offset", "SRT-1 SRT-2 SRT-3", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
def sort_limit_offset(spark: SparkSession, sf: str) -> DataFrame:
    return orders(spark, sf).select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(20)


@query("newest_n_per_owner", "SRT-6 SRT-13", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def newest_n_per_owner(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf, "events").withColumn("place", place).where("place <= 20").select("user_id", "event_id")


@query("row_cap_truncation", "SRT-4 SRC-11 GOV-22", """
    SELECT c_custkey, (SELECT count(*) > 200 FROM customer WHERE c_acctbal > 0) AS truncated FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 200""")
def row_cap_truncation(spark: SparkSession, sf: str) -> DataFrame:
    """One row beyond the cap is read, so truncation is known without a count."""
    read = customer(spark, sf).where("c_acctbal > 0").select("c_custkey").orderBy("c_custkey").limit(201)
    seen = read.withColumn("at", F.row_number().over(W.orderBy("c_custkey"))).withColumn("truncated", F.count("*").over(W.partitionBy()) > 200)
    return seen.where("at <= 200").select("c_custkey", "truncated")


def _nations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = customer(spark, sf).where("c_acctbal > 8000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return c, s


_C, _S = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


@query("set_union_all", "SET-1", f"{_C} UNION ALL {_S}")
def set_union_all(spark: SparkSession, sf: str) -> DataFrame:
    c, s = _nations(spark, sf)
    return c.unionAll(s)


@query("set_union", "SET-2", f"{_C} UNION {_S}")
def set_union(spark: SparkSession, sf: str) -> DataFrame:
    c, s = _nations(spark, sf)
    return c.union(s).distinct()


@query("set_intersect", "SET-3", f"{_C} INTERSECT {_S}")
def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    c, s = _nations(spark, sf)
    return c.intersect(s)


@query("set_except", "SET-4", f"{_C} EXCEPT {_S}")
def set_except(spark: SparkSession, sf: str) -> DataFrame:
    c, s = _nations(spark, sf)
    return c.subtract(s)


@query("set_scope_cover", "SET-7 SCH-6", """
    SELECT p_type, list_sort(list(DISTINCT p_brand)) <@ ['Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5'] AS covered FROM part WHERE p_size <= 2 GROUP BY 1""")
def set_scope_cover(spark: SparkSession, sf: str) -> DataFrame:
    brands = part(spark, sf).where("p_size <= 2").groupBy("p_type").agg(F.collect_set("p_brand").alias("brands"))
    return brands.select("p_type", (F.size(F.array_except("brands", F.array(*(F.lit(f"Brand#{i}") for i in range(1, 6))))) == 0).alias("covered"))
