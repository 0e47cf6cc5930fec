"""Registered queries: name -> (function, survey ids, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .workers import importable

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    run: Run
    ids: tuple[str, ...]
    oracle: str | None


REGISTERED: dict[str, Registered] = {}


def query(name: str, ids: str, oracle: str | None = None) -> Callable[[Run], Run]:
    """Register a query; ``ids`` are the survey rows it covers."""

    def add(fn: Run) -> Run:
        if name in REGISTERED:
            raise ValueError(f"query {name} is registered twice")
        REGISTERED[name] = Registered(name, fn, tuple(ids.split()), oracle)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
