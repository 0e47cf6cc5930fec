"""Shop questions: revenue, returns, margins, cohorts, churn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import RETURNED, order_items, orders, products, shop_sql, users
from ..registry import query

BRANDS = ("Brand#1", "Brand#2")


def sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that count as revenue: not returned."""
    return order_items(spark, sf_dir).where(F.col("status") != RETURNED)


def with_product(items: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return items.join(products(spark, sf_dir).withColumnRenamed("id", "p_id"), F.col("product_id") == F.col("p_id"))


def money(column: str | Column) -> Column:
    """Sum of amounts, exact to the hundredth: prices times discounts have four decimals."""
    amount = F.col(column) if isinstance(column, str) else column
    return F.round(F.sum(amount.cast("decimal(18,4)")), 2).cast("double")


@query("top_categories_by_revenue", "SRC-1 JOIN-1 AGG-4 SRT-1 SRT-2 FIG-14", shop_sql("""
    SELECT category, round(sum(sale_price::DECIMAL(18,4)), 2)::DOUBLE AS revenue FROM order_items JOIN products ON product_id = id
    WHERE status <> 'Returned' GROUP BY category ORDER BY revenue DESC, category LIMIT 5"""))
def top_categories_by_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_product(sold(spark, sf_dir), spark, sf_dir).groupBy("category").agg(money("sale_price").alias("revenue")).orderBy(F.desc("revenue"), "category").limit(5)


@query("monthly_revenue_trend", "DT-2 AGG-4", shop_sql("""
    SELECT date_trunc('month', created_at)::DATE AS month, round(sum(sale_price::DECIMAL(18,4)), 2)::DOUBLE AS revenue FROM order_items WHERE status <> 'Returned' GROUP BY 1"""))
def monthly_revenue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sold(spark, sf_dir).groupBy(F.trunc("created_at", "MM").alias("month")).agg(money("sale_price").alias("revenue"))


@query("order_status_mix_share", "AGG-1 WIN-9", shop_sql("""
    SELECT status, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM shop_orders GROUP BY status"""))
def order_status_mix_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = orders(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("return_rate_by_category", "AGG-3 MTH-5", shop_sql("""
    SELECT category, round(count(*) FILTER (status = 'Returned') / count(*), 6) AS return_rate FROM order_items JOIN products ON product_id = id GROUP BY category"""))
def return_rate_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.try_divide(F.count_if(F.col("status") == RETURNED), F.count("*"))
    return with_product(order_items(spark, sf_dir), spark, sf_dir).groupBy("category").agg(F.round(rate, 6).alias("return_rate"))


@query("average_order_value", "AGG-14 FIG-14", shop_sql("""
    SELECT round(avg(total), 2) AS aov FROM (SELECT order_id, sum(sale_price) AS total FROM order_items WHERE status <> 'Returned' GROUP BY order_id)"""))
def average_order_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sold(spark, sf_dir).groupBy("order_id").agg(F.sum("sale_price").alias("total")).agg(F.round(F.avg("total"), 2).alias("aov"))


@query("delivery_days_by_category", "DT-5 FLT-6", shop_sql("""
    SELECT category, round(avg(date_diff('day', created_at::DATE, delivered_at::DATE)), 4) AS days FROM order_items JOIN products ON product_id = id
    WHERE delivered_at IS NOT NULL GROUP BY category"""))
def delivery_days_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff("delivered_at", "created_at")
    return with_product(order_items(spark, sf_dir).where(F.col("delivered_at").isNotNull()), spark, sf_dir).groupBy("category").agg(F.round(F.avg(days), 4).alias("days"))


@query("gross_margin_by_brand", "PRJ-3 SRT-2", shop_sql("""
    SELECT brand, round(sum((sale_price - cost)::DECIMAL(18,4)), 2)::DOUBLE AS margin FROM order_items JOIN products ON product_id = id
    WHERE status <> 'Returned' GROUP BY brand ORDER BY margin DESC, brand LIMIT 10"""))
def gross_margin_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_product(sold(spark, sf_dir), spark, sf_dir).groupBy("brand").agg(money(F.col("sale_price") - F.col("cost")).alias("margin")).orderBy(F.desc("margin"), "brand").limit(10)


@query("brand_monthly_units", "FLT-2 DT-2", shop_sql("""
    SELECT date_trunc('month', created_at)::DATE AS month, sum(quantity)::BIGINT AS units FROM order_items JOIN products ON product_id = id WHERE brand = 'Brand#1' GROUP BY 1"""))
def brand_monthly_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = with_product(order_items(spark, sf_dir), spark, sf_dir).where(F.col("brand") == BRANDS[0])
    return mine.groupBy(F.trunc("created_at", "MM").alias("month")).agg(F.sum("quantity").cast("long").alias("units"))


@query("brand_category_split", "FLT-3", shop_sql("""
    SELECT brand, category, count(*) AS n, round(sum(sale_price::DECIMAL(18,4)), 2)::DOUBLE AS revenue FROM order_items JOIN products ON product_id = id
    WHERE brand IN ('Brand#1', 'Brand#2') AND status <> 'Returned' GROUP BY brand, category"""))
def brand_category_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = with_product(sold(spark, sf_dir), spark, sf_dir).where(F.col("brand").isin(*BRANDS))
    return mine.groupBy("brand", "category").agg(F.count("*").alias("n"), money("sale_price").alias("revenue"))


@query("brand_return_rate_by_month", "AGG-3 MTH-5 FLT-2", shop_sql("""
    SELECT date_trunc('month', created_at)::DATE AS month, round(count(*) FILTER (status = 'Returned') / count(*), 6) AS return_rate
    FROM order_items JOIN products ON product_id = id WHERE brand = 'Brand#2' GROUP BY 1"""))
def brand_return_rate_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = with_product(order_items(spark, sf_dir), spark, sf_dir).where(F.col("brand") == BRANDS[1])
    return mine.groupBy(F.trunc("created_at", "MM").alias("month")).agg(F.round(F.try_divide(F.count_if(F.col("status") == RETURNED), F.count("*")), 6).alias("return_rate"))


@query("aov_by_segment", "AGG-14 JOIN-1 FIG-14", shop_sql("""
    SELECT traffic_source, round(sum(sale_price) / count(DISTINCT order_id), 2) AS aov FROM order_items JOIN users ON user_id = id WHERE status <> 'Returned' GROUP BY 1"""))
def aov_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = sold(spark, sf_dir).join(users(spark, sf_dir), F.col("user_id") == F.col("id"))
    by_order = joined.groupBy("traffic_source", "order_id").agg(F.sum("sale_price").alias("total"))
    return by_order.groupBy("traffic_source").agg(F.round(F.sum("total") / F.count("*"), 2).alias("aov"))


@query("customer_new_vs_returning", "FIG-14 AGG-14", shop_sql("""
    WITH f AS (SELECT user_id, min(date_trunc('month', created_at)) AS first FROM shop_orders GROUP BY 1)
    SELECT date_trunc('month', created_at)::DATE AS month, count(DISTINCT o.user_id) FILTER (date_trunc('month', created_at) = first) AS new_customers,
      count(DISTINCT o.user_id) FILTER (date_trunc('month', created_at) > first) AS returning_customers
    FROM shop_orders o JOIN f USING (user_id) GROUP BY 1"""))
def customer_new_vs_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = orders(spark, sf_dir).select("user_id", F.trunc("created_at", "MM").alias("month")).distinct()
    first = active.withColumn("first", F.min("month").over(W.partitionBy("user_id")))
    return first.groupBy("month").agg(F.count_if(F.col("month") == F.col("first")).alias("new_customers"), F.count_if(F.col("month") > F.col("first")).alias("returning_customers"))


@query("repeat_purchase_cohorts", "FIG-14 WIN-7", shop_sql("""
    WITH a AS (SELECT DISTINCT user_id, date_trunc('month', created_at)::DATE AS month FROM shop_orders),
    c AS (SELECT user_id, month, min(month) OVER (PARTITION BY user_id) AS cohort FROM a)
    SELECT cohort, date_diff('month', cohort, month) AS months_later, count(*) AS customers FROM c GROUP BY 1, 2"""))
def repeat_purchase_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = orders(spark, sf_dir).select("user_id", F.trunc("created_at", "MM").alias("month")).distinct()
    cohorts = active.withColumn("cohort", F.min("month").over(W.partitionBy("user_id")))
    return cohorts.groupBy("cohort", F.months_between("month", "cohort").cast("long").alias("months_later")).agg(F.count("*").alias("customers"))


@query("churn_monthly", "FIG-14 JOIN-7", shop_sql("""
    WITH a AS (SELECT DISTINCT user_id, date_trunc('month', created_at)::DATE AS month FROM shop_orders), last AS (SELECT max(month) AS m FROM a)
    SELECT month, count(*) AS customers, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a n WHERE n.user_id = a.user_id AND n.month = a.month + INTERVAL 1 MONTH)) AS churned
    FROM a WHERE month < (SELECT m FROM last) GROUP BY month"""))
def churn_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = orders(spark, sf_dir).select("user_id", F.trunc("created_at", "MM").alias("month")).distinct()
    following = F.lead("month").over(W.partitionBy("user_id").orderBy("month"))
    marked = active.withColumn("stays", F.coalesce(following == F.add_months("month", 1), F.lit(False)))
    counts = marked.groupBy("month").agg(F.count("*").alias("customers"), F.count_if(~F.col("stays")).alias("churned"))
    return counts.where(F.col("month") < active.agg(F.max("month")).scalar())
