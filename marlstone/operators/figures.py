"""Figures derived from results, and statements checked against them."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import shop_sql
from ..registry import query, table
from .business import money, sold

REL_TOL = 0.005
UNITS = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "mln": 1e6, "million": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "t": 1e12, "tn": 1e12, "trillion": 1e12}
NUMBER = re.compile(
    r"(?<![\w.])(?P<paren>\()?(?P<sign>[-+−])?(?P<cur>(?:USD|EUR|GBP|INR|Rs\.?|A\$|[$€£₹])\s?)?"
    r"(?P<num>[0-9]{1,3}(?:,[0-9]{2},[0-9]{3}|(?:,[0-9]{3})+|(?:[ '][0-9]{3})+)(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?)(?P<exp>[eE][-+]?[0-9]+)?"
    r"\s?(?P<unit>%|percent(?:age points)?\b|pp\b|(?:k|mn|mln|m|bn|b|tn|t|thousand|million|billion|trillion)\b)?(?P<close>\))?", re.I,
)
ISO = re.compile(r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b")


def scan_numbers(text: str, most: int = 200) -> list[dict]:
    """Numbers stated in a text: value, tolerance, percent, either sign.

    Dates are blanked first; whole numbers up to 10 without a unit are skipped.
    """
    text = ISO.sub(lambda m: " " * len(m[0]), text)
    out = []
    for m in NUMBER.finditer(text):
        unit = (m["unit"] or "").lower()
        percent = unit in ("%", "pp") or unit.startswith("percent")
        digits = re.sub(r"[, ']", "", m["num"])
        value = float(digits + (m["exp"] or ""))
        scale = 1.0 if percent else UNITS.get(unit, 1.0)
        if not unit and not m["cur"] and "." not in digits and value <= 10:
            continue
        decimals = len(digits.split(".")[1]) if "." in digits else 0
        bracketed = bool(m["paren"] and m["close"])
        negative = m["sign"] in ("-", "−") or bracketed and bool(m["cur"])
        out.append({"value": (-value if negative else value) * scale, "tolerance": 0.5 * 10**-decimals * scale, "percent": percent, "either_sign": bracketed and not m["cur"]})
        if len(out) == most:
            break
    return out


def dates_in(text: str) -> list[date | None]:
    """ISO dates of a text; an impossible day is None, in no window."""
    out = []
    for y, m, d in ISO.findall(text):
        try:
            out.append(date(int(y), int(m), int(d)))
        except ValueError:
            out.append(None)
    return out


def matches(stated: dict, pool: list[float], exact_only: bool = False) -> bool:
    """Whether a figure of the pool rounds to the stated number, or is within 0.5 %."""
    for x in pool:
        for y in (x, x * 100) if stated["percent"] else (x,):
            for v in (stated["value"], -stated["value"]) if stated["either_sign"] else (stated["value"],):
                gap = abs(v - y)
                if gap <= stated["tolerance"] * (1 + 1e-9) or not exact_only and gap <= REL_TOL * abs(y):
                    return True
    return False


def long_form(frame: DataFrame, ids: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """(ids, column, value): a result's numeric columns as rows, null and non-finite left out."""
    long = frame.unpivot(list(ids), [F.col(c).cast("double").alias(c) for c in columns], "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def id_like(frame: DataFrame, column: str) -> DataFrame:
    """One row: whether a column looks like an identifier (20 or more, all distinct whole numbers)."""
    c = F.col(column)
    return frame.agg(((F.count(c) >= 20) & (F.count(c) == F.count_distinct(c)) & (F.count_if(c != F.floor(c)) == 0)).alias("id_like"))


def derived(series: DataFrame, order: str, value: str) -> DataFrame:
    """Totals, shares, consecutive and first-to-last changes of an ordered series."""
    w, whole = W.orderBy(order), W.partitionBy()
    x, before = F.col(value), F.lag(value).over(w)
    ends = W.orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first_value(value).over(ends), F.last_value(value).over(ends)
    return series.select(
        order, F.round(F.sum(x).over(whole), 2).alias("total"), F.round(x / F.sum(x).over(whole), 6).alias("share"), F.round(x + before, 2).alias("sum_with_previous"),
        F.round(x - before, 2).alias("change"), F.round(F.try_divide(x - before, before), 6).alias("growth"), F.round(last - first, 2).alias("first_to_last"),
        F.round(F.try_divide(last - first, first), 6).alias("growth_overall"),
    )


_MONTHLY = "SELECT date_trunc('month', created_at)::DATE AS month, round(sum(sale_price::DECIMAL(18,4)), 2)::DOUBLE AS revenue FROM order_items WHERE status <> 'Returned' GROUP BY 1"


@query("figures_totals_shares_growth", "FIG-4 FIG-5 FIG-6 FIG-7 AGG-23", shop_sql(f"""
    WITH m AS ({_MONTHLY}) SELECT month, round(sum(revenue) OVER (), 2) AS total, round(revenue / sum(revenue) OVER (), 6) AS share, round(revenue + lag(revenue) OVER w, 2) AS sum_with_previous,
      round(revenue - lag(revenue) OVER w, 2) AS change, round((revenue - lag(revenue) OVER w) / lag(revenue) OVER w, 6) AS growth,
      round((SELECT arg_max(revenue, month) - arg_min(revenue, month) FROM m), 2) AS first_to_last,
      round((SELECT (arg_max(revenue, month) - arg_min(revenue, month)) / arg_min(revenue, month) FROM m), 6) AS growth_overall FROM m WINDOW w AS (ORDER BY month)"""))
def figures_totals_shares_growth(spark: SparkSession, sf: str) -> DataFrame:
    """The series has a row per month, so its windows are small."""
    monthly = sold(spark, sf).groupBy(F.trunc("created_at", "MM").alias("month")).agg(money("sale_price").alias("revenue"))
    return derived(monthly, "month", "revenue")


@query("figures_long_form", "FIG-1 FIG-2 DM-13", shop_sql("""
    SELECT category, unnest(['n', 'revenue']) AS "column", unnest([n, revenue]) AS value FROM
      (SELECT category, count(*)::DOUBLE AS n, round(sum(sale_price::DECIMAL(18,4)), 2)::DOUBLE AS revenue FROM order_items JOIN products ON product_id = id GROUP BY 1)"""))
def figures_long_form(spark: SparkSession, sf: str) -> DataFrame:
    from .business import order_items, with_product

    by = with_product(order_items(spark, sf), spark, sf).groupBy("category").agg(F.count("*").alias("n"), money("sale_price").alias("revenue"))
    return long_form(by, ("category",), ("n", "revenue"))


@query("figures_id_like", "FIG-3", "SELECT true AS id_like")
def figures_id_like(spark: SparkSession, sf: str) -> DataFrame:
    return id_like(table(spark, sf, "customer"), "c_custkey")


@query("figures_pairwise", "FIG-8", shop_sql("""
    SELECT brand, round(r + c, 2) AS pair_sum, round(r - c, 2) AS pair_difference FROM (SELECT brand, sum(retail_price) AS r, sum(cost) AS c FROM products GROUP BY 1)"""))
def figures_pairwise(spark: SparkSession, sf: str) -> DataFrame:
    from ..catalog import products

    by = products(spark, sf).groupBy("brand").agg(F.sum("retail_price").alias("r"), F.sum("cost").alias("c"))
    return by.select("brand", F.round(F.col("r") + F.col("c"), 2).alias("pair_sum"), F.round(F.col("r") - F.col("c"), 2).alias("pair_difference"))


@query("figures_match", "FIG-9 FIG-12 FIG-16", shop_sql(f"""
    WITH m AS ({_MONTHLY}), s AS (SELECT month, revenue, round(revenue / 1e6, 1) * 1e6 AS stated FROM m)
    SELECT month, stated, EXISTS (SELECT 1 FROM m WHERE abs(m.revenue - stated) <= 50000 * (1 + 1e-9) OR abs(m.revenue - stated) <= 0.005 * abs(m.revenue)) AS matched FROM s"""))
def figures_match(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly revenue as stated in millions with one decimal, looked up among all months."""
    monthly = sold(spark, sf).groupBy(F.trunc("created_at", "MM").alias("month")).agg(money("sale_price").alias("revenue"))
    stated = monthly.select("month", (F.round(F.col("revenue") / 1e6, 1) * 1e6).alias("stated"))
    pool = monthly.select(F.col("revenue").alias("figure"))
    gap = F.abs(F.col("figure") - F.col("stated"))
    hit = (gap <= 50_000 * (1 + 1e-9)) | (gap <= REL_TOL * F.abs("figure"))
    found = stated.join(pool, hit, "left_semi").select("month", F.lit(True).alias("hit"))
    return stated.join(found, "month", "left").select("month", "stated", F.coalesce("hit", F.lit(False)).alias("matched"))


@query("figures_in_window", "FIG-11", """
    SELECT o_orderkey, o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AS inside FROM orders""")
def figures_in_window(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", day.between(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date")).alias("inside"))
