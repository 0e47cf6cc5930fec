"""The shop: four views over the warehouse tables, and what each column is.

``users``, ``orders``, ``order_items`` and ``products`` are projections of the
star schema.  The classification says which columns are personal, which are
quasi-identifiers, and which are keys; views only expose classified columns, so
personal columns cannot be referenced at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

#: No column holds the cost of a product; this share of its retail price stands in.
COST_SHARE = 0.6


@dataclass(frozen=True)
class Column:
    """How a column may be used: id key, customer key, quasi-identifier, raw time."""

    type: str
    description: str = ""
    id_key: bool = False
    user_key: bool = False
    quasi: bool = False
    raw_time: bool = False


TABLES: dict[str, dict[str, Column]] = {
    "users": {
        "id": Column("bigint", "customer", id_key=True, user_key=True),
        "country": Column("string", "nation of the customer", quasi=True),
        "state": Column("string", "region of the customer", quasi=True),
        "traffic_source": Column("string", "market segment", quasi=True),
        "balance": Column("double", "account balance", quasi=True),
    },
    "orders": {
        "order_id": Column("bigint", "order", id_key=True),
        "user_id": Column("bigint", "customer who ordered", id_key=True, user_key=True),
        "status": Column("string", "state of the order"),
        "priority": Column("string", "priority of the order"),
        "created_at": Column("timestamp", "when the order was placed"),
    },
    "order_items": {
        "order_id": Column("bigint", "order", id_key=True),
        "user_id": Column("bigint", "customer who ordered", id_key=True, user_key=True),
        "product_id": Column("bigint", "product sold"),
        "quantity": Column("double", "units sold"),
        "sale_price": Column("double", "price after discount"),
        "status": Column("string", "state of the item"),
        "created_at": Column("timestamp", "when the order was placed"),
        "delivered_at": Column("timestamp", "when the item was delivered"),
    },
    "products": {
        "id": Column("bigint", "product"),
        "name": Column("string", "product name"),
        "brand": Column("string", "brand"),
        "category": Column("string", "kind of product"),
        "size": Column("int", "size class"),
        "retail_price": Column("double", "list price"),
        "cost": Column("double", "cost of the product"),
    },
}

#: Personal columns of the warehouse that no view exposes.
PERSONAL = {"users": frozenset({"first_name", "last_name", "email", "street_address", "postal_code", "latitude", "longitude", "user_geom", "c_name"})}
RETURNED = "Returned"


def kind(column: Column) -> str:
    """key, quasi_identifier, metric or dimension."""
    if column.id_key:
        return "key"
    if column.quasi:
        return "quasi_identifier"
    return "metric" if column.type in ("double", "int", "decimal", "float") else "dimension"


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("retail_price"), (F.col("p_retailprice") * COST_SHARE).alias("cost"),
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"),
    )


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    status = F.when(F.col("l_returnflag") == "R", RETURNED).when(F.col("l_linestatus") == "O", "Processing").otherwise("Complete")
    return (
        table(spark, sf_dir, "lineitem").join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sale_price"), status.alias("status"),
            F.col("o_orderdate").alias("created_at"), F.col("l_shipdate").alias("delivered_at"),
        )
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions are fixed lists of the schema: 25 and 5 rows."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.col("n_name").alias("country"), F.col("r_name").alias("state"),
        F.col("c_mktsegment").alias("traffic_source"), F.col("c_acctbal").alias("balance"),
    )


VIEWS = {"users": users, "orders": orders, "order_items": order_items, "products": products}

#: The views for DuckDB, in front of an oracle's own WITH list.
SHOP_SQL = """
products AS (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS category, p_size AS size, p_retailprice AS retail_price, p_retailprice * 0.6 AS cost FROM part),
shop_orders AS (SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS created_at FROM orders),
order_items AS (SELECT l_orderkey AS order_id, o_custkey AS user_id, l_partkey AS product_id, l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS sale_price,
  CASE WHEN l_returnflag = 'R' THEN 'Returned' WHEN l_linestatus = 'O' THEN 'Processing' ELSE 'Complete' END AS status, o_orderdate AS created_at, l_shipdate AS delivered_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
users AS (SELECT c_custkey AS id, n_name AS country, r_name AS state, c_mktsegment AS traffic_source, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""


def shop_sql(body: str) -> str:
    """An oracle over the shop views; orders are named shop_orders there."""
    rest = body.strip()
    if rest[:4].upper() == "WITH":
        return f"WITH {SHOP_SQL.strip()}, {rest[4:]}"
    return f"WITH {SHOP_SQL.strip()} {rest}"
