"""Two-phase deletion of reports: a preview bound by a token, then exactly that set."""

from __future__ import annotations

import hashlib
import hmac
import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .sources.store import Store, StoreError

PREVIEW, EXPIRES, GRACE = 100, 600, 60
NEGATED = re.compile(r"\b(?:not|except|but|without|keep)\b", re.I)


@dataclass
class Pending:
    action: str
    owner: str
    turn: int
    ids: tuple[str, ...]
    proof: str
    at: float


@dataclass
class Deletion:
    store: Store
    key: bytes = b"local"
    clock: object = time.time
    pending: dict[str, Pending] = field(default_factory=dict)
    done: set[str] = field(default_factory=set)

    def _proof(self, owner: str, ids: tuple[str, ...]) -> str:
        return hmac.new(self.key, json.dumps([owner, sorted(ids)]).encode(), hashlib.sha256).hexdigest()

    def select(self, owner: str, said: str) -> tuple[str, ...]:
        """Ids, or a phrase of three characters or more; negations and wildcards are refused."""
        if NEGATED.search(said) or re.search(r"[*%?]", said):
            raise StoreError("selector_refused")
        mine = self.store.read("saved_report").where(F.col("owner") == owner)
        names = [x for x in re.split(r"[,\s]+", said.strip()) if x]
        by_id = [r.report_id for r in mine.where(F.col("report_id").isin(*names)).select("report_id").collect()]
        if by_id and len(by_id) == len(set(names)):
            return tuple(sorted(by_id))
        if len(said.strip()) < 3:
            raise StoreError("selector_refused")
        needle = said.strip().lower()
        found = mine.where(F.lower("title").contains(needle) | F.lower("body").contains(needle)).select("report_id").collect()
        return tuple(sorted(r.report_id for r in found))

    def preview(self, owner: str, said: str, turn: int) -> Pending:
        ids = self.select(owner, said)
        if not ids:
            raise StoreError("nothing_selected")
        action = hashlib.sha256(f"{owner}{ids}{self.clock()}".encode()).hexdigest()[:16]
        self.pending[action] = Pending(action, owner, turn, ids, self._proof(owner, ids), self.clock())
        return self.pending[action]

    def confirm(self, action: str, owner: str, turn: int, word: str) -> int:
        """Delete the previewed set; the first check that fails names the refusal."""
        p = self.pending.get(action)
        expected = "delete" if p is None or len(p.ids) <= PREVIEW else f"delete {len(p.ids)}"
        checks = (
            ("declined", word.isascii() and word.strip().lower() == expected), ("wrong_action", p is not None or action in self.done), ("replayed", action not in self.done),
            ("wrong_owner", p is not None and p.owner == owner), ("timeout", p is not None and self.clock() - p.at <= EXPIRES + GRACE), ("wrong_turn", p is not None and turn == p.turn + 1),
            ("proof_mismatch", p is not None and hmac.compare_digest(p.proof, self._proof(owner, p.ids))),
        )
        for code, fine in checks:
            if not fine:
                raise StoreError(code)
        n = self.store.audited_delete("saved_report", "report_id", list(p.ids), owner, action, (("report_vector", "report_id"),))
        self.done.add(action)
        del self.pending[action]
        return n
