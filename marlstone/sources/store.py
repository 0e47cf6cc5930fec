"""The application store: versioned Parquet tables with a single writer.

A table is a folder of snapshots; ``CURRENT`` names the one that counts, and is
replaced last, so a reader sees the old or the new snapshot and never a mixture.
Spark has no transactions: one lock per store orders the writers of a driver.
"""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Table name -> schemas by version; a later version only adds columns.
SCHEMAS: dict[str, list[str]] = {
    "audit_event": ["event_id string, ts timestamp, actor string, pending_action string, event_type string, target_ids array<string>, n long, outcome string, details map<string,string>"],
    "feedback": ["feedback_id string, user_id string, session_id string, turn_id string, rating string, comment string, state string, created_at timestamp"],
    "saved_report": [
        "report_id string, owner string, title string, body string, tags array<string>, idempotency_key string, created_at timestamp",
        "report_id string, owner string, title string, body string, tags array<string>, idempotency_key string, created_at timestamp, scope_key string",
    ],
    "report_vector": ["report_id string, owner string, model string, vector array<float>, content_hash string"],
    "preference": ["user_id string, document string, updated_at timestamp"],
}


class StoreError(RuntimeError):
    """A write that may not happen; ``code`` says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Store:
    spark: SparkSession
    root: str
    lock: threading.RLock = field(default_factory=threading.RLock)

    def _fs(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _current(self, table: str) -> str | None:
        fs, where = self._fs(f"{self.root}/{table}/CURRENT")
        return self.spark.read.text(where.toString()).first()[0] if fs.exists(where) else None

    def schema(self, table: str) -> str:
        return SCHEMAS[table][-1]

    def read(self, table: str) -> DataFrame:
        """The table under its latest schema; columns that an old snapshot lacks are null."""
        at = self._current(table)
        if at is None:
            return self.spark.createDataFrame([], self.schema(table))
        return self.spark.read.schema(self.schema(table)).parquet(f"{self.root}/{table}/{at}")

    def write(self, table: str, rows: DataFrame) -> None:
        """Replace the table by a new snapshot."""
        with self.lock:
            at = f"v{time.time_ns()}-{uuid.uuid4().hex[:8]}"
            old = self._current(table)
            columns = self.spark.createDataFrame([], self.schema(table)).columns
            rows.select(*columns).write.mode("errorifexists").parquet(f"{self.root}/{table}/{at}")
            fs, where = self._fs(f"{self.root}/{table}/CURRENT")
            out = fs.create(where, True)
            out.writeBytes(at)
            out.close()
            if old:
                fs.delete(self._fs(f"{self.root}/{table}/{old}")[1], True)

    def append(self, table: str, rows: DataFrame, unique: tuple[str, ...] = ()) -> int:
        """Add rows; those whose ``unique`` key is taken (or null-free repeated) are ignored."""
        with self.lock:
            old = self.read(table)
            new = rows
            if unique:
                new = rows.dropDuplicates(list(unique)).join(old.select(*unique), list(unique), "left_anti")
            new = new.select(*old.columns)
            added = new.count()
            if added:
                self.write(table, old.unionByName(new))
            return added

    def upsert(self, table: str, rows: DataFrame, key: tuple[str, ...], order: str, parent: tuple[str, str] | None = None) -> None:
        """Keep the latest row of each key; with ``parent`` only rows whose parent exists."""
        with self.lock:
            if parent:
                rows = rows.join(self.read(parent[0]).select(parent[1]).distinct(), parent[1], "left_semi")
            both = self.read(table).withColumn("__new", F.lit(0)).unionByName(rows.select(*self.read(table).columns).withColumn("__new", F.lit(1)))
            latest = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order), F.desc("__new")))
            self.write(table, both.withColumn("__place", latest).where("__place = 1").drop("__place", "__new"))

    def compare_and_set(self, table: str, where: F.Column, column: str, expected: str, value: str) -> bool:
        """Set a column where it still holds the expected value; False if nothing did."""
        with self.lock:
            rows = self.read(table)
            hit = where & (F.col(column) == expected)
            if rows.where(hit).count() != 1:
                return False
            self.write(table, rows.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column))))
            return True

    def audited_delete(self, table: str, key: str, ids: list[str], owner: str, action: str, dependents: tuple[tuple[str, str], ...] = ()) -> int:
        """Delete exactly the listed rows of an owner, audit row first.

        Every id must exist once and belong to the owner, else nothing is
        deleted and ``delete.failed`` is recorded.  A replayed action deletes
        nothing.
        """
        with self.lock:
            if self.read("audit_event").where((F.col("pending_action") == action) & (F.col("event_type") == "report.deleted")).count():
                return 0
            rows = self.read(table)
            target = rows.where(F.col(key).isin(*ids) & (F.col("owner") == owner))
            counts = target.agg(F.count("*").alias("n"), F.count_distinct(key).alias("d")).first()
            if not counts.n == counts.d == len(set(ids)):
                self._audit(owner, action, "delete.failed", ids, 0, "refused")
                raise StoreError("set_changed")
            self._audit(owner, action, "report.deleted", ids, counts.n, "ok")
            gone = self.spark.createDataFrame([(i,) for i in ids], f"{key} string")
            for name, column in dependents:
                self.write(name, self.read(name).join(gone.withColumnRenamed(key, column), column, "left_anti"))
            self.write(table, rows.join(gone, key, "left_anti"))
            return counts.n

    def erase(self, user: str, tables: dict[str, str]) -> dict[str, int]:
        """Remove a user's rows from every table and pseudonymise the audit log."""
        with self.lock:
            plan = {t: self.read(t).where(F.col(c) == user).count() for t, c in tables.items()}
            name = "erased-" + hashlib.sha256(user.encode()).hexdigest()[:16]
            self._audit(name, uuid.uuid4().hex, "user.erased", [], sum(plan.values()), "ok")
            for t, c in tables.items():
                self.write(t, self.read(t).where(~F.col(c).eqNullSafe(user)))
            log = self.read("audit_event")
            self.write("audit_event", log.withColumn("actor", F.when(F.col("actor") == user, name).otherwise(F.col("actor"))))
            if any(self.read(t).where(F.col(c) == user).count() for t, c in tables.items()) or self.read("audit_event").where(F.col("actor") == user).count():
                raise StoreError("erase_incomplete")
            return plan

    def _audit(self, actor: str, action: str, kind: str, ids: list[str], n: int, outcome: str) -> None:
        row = self.spark.range(1).select(
            F.lit(uuid.uuid4().hex).alias("event_id"), F.current_timestamp().alias("ts"), F.lit(actor).alias("actor"), F.lit(action).alias("pending_action"), F.lit(kind).alias("event_type"),
            F.array(*(F.lit(i) for i in ids)).cast("array<string>").alias("target_ids"), F.lit(n).cast("long").alias("n"), F.lit(outcome).alias("outcome"), F.create_map().cast("map<string,string>").alias("details"),
        )
        self.append("audit_event", row, ("pending_action", "event_type"))
