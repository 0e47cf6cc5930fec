"""Product scope: who may see which brands, and the scoped views that enforce it.

A session's SQL names the shop tables; it gets views that already hold only the
rows of its scope and no personal column.  Products are filtered by brand;
items, orders and users follow by semi-joins along product -> item -> order and
user, so a query cannot reach a row outside its scope, whatever its shape.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog


class ScopeRefused(ValueError):
    """A scope that may not be used; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Scope:
    """Brands of a session, or all of them explicitly."""

    brands: tuple[str, ...] = ()
    everything: bool = False

    def __post_init__(self) -> None:
        if self.everything and self.brands or any(not isinstance(b, str) or not b.strip() for b in self.brands):
            raise ScopeRefused("scope_invalid")
        if not self.everything and not self.brands:
            raise ScopeRefused("empty_scope")

    @property
    def key(self) -> str:
        """Names the scope in caches and stores without telling its brands."""
        if self.everything:
            return "all"
        return "brands:" + hashlib.sha256("\x1f".join(sorted(set(self.brands))).encode()).hexdigest()[:32]

    def covers(self, other: Scope) -> bool:
        return self.everything or not other.everything and set(other.brands) <= set(self.brands)


def scoped_views(spark: SparkSession, sf_dir: str, scope: Scope) -> dict[str, DataFrame]:
    """The four shop tables as the scope sees them (brand names match by exact case)."""
    views = {name: view(spark, sf_dir) for name, view in catalog.VIEWS.items()}
    if scope.everything:
        return views
    products = views["products"].where(F.col("brand").isin(*sorted(set(scope.brands))))
    ids = products.select(F.col("id").alias("__product"))
    items = views["order_items"].join(ids, F.col("product_id") == F.col("__product"), "left_semi")
    placed = items.select(F.col("order_id").alias("__order"))
    buyers = items.select(F.col("user_id").alias("__user"))
    return {
        "products": products, "order_items": items,
        "orders": views["orders"].join(placed, F.col("order_id") == F.col("__order"), "left_semi"),
        "users": views["users"].join(buyers, F.col("id") == F.col("__user"), "left_semi"),
    }


def unknown_brands(spark: SparkSession, sf_dir: str, scope: Scope) -> DataFrame:
    """Brands of the scope that no product has."""
    named = spark.createDataFrame([(b,) for b in sorted(set(scope.brands))], "brand string")
    return named.join(catalog.products(spark, sf_dir).select("brand").distinct(), "brand", "left_anti")


def bind(spark: SparkSession, sf_dir: str, scope: Scope) -> SparkSession:
    """A session of its own whose only tables are the scoped views."""
    own = spark.newSession()
    for name, view in scoped_views(own, sf_dir, scope).items():
        view.createOrReplaceTempView(name)
    return own
