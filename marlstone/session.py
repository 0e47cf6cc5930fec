"""One governed statement: decide, bind to the scope, protect, run, release."""

from __future__ import annotations

import hashlib
import math
import threading
from collections import OrderedDict
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .differencing import Fingerprint, Store
from .functions.pii import scrub
from .plans import policy, rewrite, text
from .scope import Scope, bind

ROW_CAP = 200
QUERY_BYTES, SESSION_BYTES = 10**9, 10**10
MEMO = 64
FAILURES = 3
#: Always the same, so it never tells whether a group was hidden.
NOTE = "Groups with fewer than {k} customers are hidden."

ERRORS = {"DIVIDE_BY_ZERO": "BAD_ARITHMETIC", "ARITHMETIC_OVERFLOW": "BAD_ARITHMETIC", "CAST_INVALID_INPUT": "BAD_CAST", "PARSE_SYNTAX_ERROR": "SQL_SYNTAX", "UNRESOLVED_COLUMN": "UNKNOWN_COLUMN", "TABLE_OR_VIEW_NOT_FOUND": "SOURCE"}


@dataclass
class Budget:
    """Bytes that statements may scan: per statement and over the session."""

    per_query: int = QUERY_BYTES
    session: int = SESSION_BYTES
    used: int = 0

    def reserve(self, estimate: int) -> str | None:
        if estimate > self.per_query:
            return "COST_CAP"
        if self.used + estimate > self.session:
            return "SESSION_BUDGET"
        self.used += estimate
        return None


@dataclass
class GovernedSession:
    """A user's session: ``run_sql`` returns an envelope, ``frame`` the DataFrame."""

    spark: SparkSession
    sf_dir: str
    scope: Scope
    user: str = "user"
    k: int = 5
    store: Store = field(default_factory=Store)
    budget: Budget = field(default_factory=Budget)
    aggregate_only: bool = False
    deadline: float = 60.0

    def __post_init__(self) -> None:
        if not 2 <= self.k <= 1000:
            raise ValueError("k must be from 2 to 1000")
        self.bound = bind(self.spark, self.sf_dir, self.scope)
        self.shadow = policy.shadow_session(self.spark)
        self.memo: OrderedDict[str, tuple] = OrderedDict()
        self.turn: set[str] = set()
        self.failures = 0
        self.tag = "marlstone-" + hashlib.sha256(f"{self.user}{id(self)}".encode()).hexdigest()[:16]
        self.lock = threading.Lock()

    def new_turn(self) -> None:
        self.turn.clear()
        self.failures = 0

    def statement_key(self, sql: str) -> str:
        return hashlib.sha256(f"{self.scope.key}\x1f{self.data_version()}\x1f{text.normal_form(sql)}".encode()).hexdigest()

    def data_version(self) -> str:
        """Names, sizes and times of the tables' files: another one after new data."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        files = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
        return ",".join(sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in files))

    def decide(self, sql: str) -> policy.Decision:
        decision = policy.check_sql(self.spark, sql, self.shadow)
        if decision.allowed and self.aggregate_only and (decision.facts.row_grain or decision.facts.outputs_id) and decision.facts.tables & {"users", "orders", "order_items"}:
            return policy.Decision(False, "customer_grain")
        return decision

    def frame(self, sql: str) -> DataFrame:
        """The governed DataFrame; raises ``policy.Refused``."""
        decision = self.decide(sql)
        if not decision.allowed:
            raise policy.Refused(decision.reason)
        plain = self._plain(sql)
        if decision.facts.uses_qi and decision.facts.grouped:
            return rewrite.with_minimum(self.bound, plain, self.k)
        if decision.facts.uses_qi and rewrite.population(self.bound, plain).first().customers < self.k:
            raise policy.Refused("small_cell_unplaceable")
        return self.bound.sql(plain)

    def _plain(self, sql: str) -> str:
        return policy._unqualified(sql, policy.parsed(self.spark, sql))

    def cancel(self) -> None:
        """Stop the statement that runs, from any thread."""
        self.bound.interruptTag(self.tag)

    def run_sql(self, sql: str, purpose: str = "") -> dict[str, Any]:
        """{ok, data, meta} or {ok: false, error}; one statement at a time."""
        if not self.lock.acquire(timeout=1):
            return _error("TOOL_BUSY")
        try:
            return self._run(sql)
        except policy.Refused as e:
            return self._failed(e.code, policy.HINTS.get(e.code, ""))
        except PySparkException as e:
            return self._failed(ERRORS.get((e.getCondition() or "").split(".")[0], "RUNTIME"))
        finally:
            self.lock.release()

    def _failed(self, code: str, hint: str = "") -> dict[str, Any]:
        self.failures += 1
        return _error("GIVE_UP" if self.failures >= FAILURES else code, hint)

    def _run(self, sql: str) -> dict[str, Any]:
        if self.failures >= FAILURES:
            return _error("GIVE_UP")
        key = self.statement_key(sql)
        if key in self.turn:
            return _error("DUPLICATE_QUERY")
        decision = self.decide(sql)
        if not decision.allowed:
            raise policy.Refused(decision.reason)
        facts = decision.facts
        grouped = facts.uses_qi and facts.grouped
        if key in self.memo:
            columns, rows, people = self.memo[key]
            self.memo.move_to_end(key)
        else:
            plain, people = self._plain(sql), None
            if facts.uses_qi and not grouped:
                counted = rewrite.population(self.bound, plain)
                if refused := self.budget.reserve(estimate(counted)):
                    return self._failed(refused)
                people = self._collected(counted)[0]
                if people[0] < self.k:
                    raise policy.Refused("small_cell_unplaceable")
            frame = rewrite.with_minimum(self.bound, plain, self.k, len(facts.grouping)) if grouped else self.bound.sql(plain)
            if refused := self.budget.reserve(estimate(frame)):
                return self._failed(refused)
            columns, rows = frame.columns, self._collected(frame)
            self.memo[key] = (columns, rows, people)
            if len(self.memo) > MEMO:
                self.memo.popitem(last=False)
        truncated = len(rows) > ROW_CAP
        if facts.uses_qi and not self.store.check_and_record(self._fingerprint(facts, rows, truncated, people), self.k):
            raise policy.Refused("differencing")
        if grouped:
            hidden = len(facts.grouping) + 2
            columns, rows = columns[:-hidden], [r[:-hidden] for r in rows]
        self.turn.add(key)
        self.failures = 0
        data = [{c: safe(v) for c, v in zip(names(columns), r, strict=True)} for r in rows[:ROW_CAP]]
        return {"ok": True, "data": data, "meta": {"columns": names(columns), "rows": len(data), "truncated": truncated, "note": NOTE.format(k=self.k) if decision.facts.uses_qi else "", "tables": sorted(decision.facts.tables)}}

    def _collected(self, frame: DataFrame) -> list[tuple]:
        """One row beyond the cap, under a deadline that cancels the job."""
        self.bound.addTag(self.tag)
        timer = threading.Timer(self.deadline, self.cancel)
        timer.start()
        try:
            return [tuple(r) for r in frame.limit(ROW_CAP + 1).collect()]
        finally:
            timer.cancel()
            self.bound.removeTag(self.tag)

    def _fingerprint(self, facts: policy.Facts, rows: list[tuple], truncated: bool, people: tuple | None) -> Fingerprint:
        """What the answer tells.  An ungrouped one tells a single cell: all it is about."""
        if people is not None:
            return Fingerprint(self.user, self.scope.key, (), facts.filters, {(): people[0]}, {(): people[1]}, False, self.store.clock())
        shown = [d for d, _ in facts.grouping]
        cells, sizes = {}, {}
        for r in rows:
            *labels, customers, n = r[len(r) - len(shown) - 2 :]
            cell = tuple(sorted((d, self.store.digest("null" if v is None else f"={v}")) for d, v in zip(shown, labels, strict=True)))
            cells[cell], sizes[cell] = customers, n
        return Fingerprint(self.user, self.scope.key, facts.dims, facts.filters, cells, sizes, facts.cut or truncated, self.store.clock())


def _error(code: str, hint: str = "") -> dict[str, Any]:
    return {"ok": False, "error": {"code": code, "hint": hint}}


def estimate(frame: DataFrame) -> int:
    """Bytes the plan's leaves will read, after pruning."""
    todo, total = [frame._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        children = [node.children().apply(i) for i in range(node.children().size())]
        if not children:
            total += int(str(node.stats().sizeInBytes()))
        todo += children
    return total


def names(columns: list[str]) -> list[str]:
    """Scrubbed column names; a repeated one gets _2, _3, ..."""
    out: list[str] = []
    for c in columns:
        base = scrub(c).text
        name, i = base, 1
        while name in out:
            i += 1
            name = f"{base}_{i}"
        out.append(name)
    return out


def safe(value: Any, depth: int = 8) -> Any:
    """A cell as JSON can hold it: text scrubbed, times ISO, non-finite null."""
    if depth < 0:
        return None
    if value is None or isinstance(value, (bool, int)):
        return value
    if isinstance(value, (float, Decimal)):
        x = float(value)
        return x if math.isfinite(x) else None
    if isinstance(value, str):
        return scrub(value).text
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return "[binary]"
    if isinstance(value, dict):
        return {str(k): safe(v, depth - 1) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [safe(v, depth - 1) for v in value]
    return str(value)
