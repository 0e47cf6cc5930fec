"""Seed questions, profiles and evaluation cases from YAML or JSON, entry by entry."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

TRIO = "trio_id string, question string, sql string, summary string, tags array<string>, brands array<string>"
REJECT = "position int, code string"
CASE = "case_id string, suite string, input string, tags array<string>, must_contain array<string>, must_not_contain array<string>"


def load(path: str) -> Any:
    """YAML where the library is there, else JSON."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need PyYAML; use JSON") from e
    return yaml.safe_load(text)


def problem(entry: Any, seen: set[str]) -> str | None:
    """Why an entry is rejected."""
    if not isinstance(entry, dict):
        return "not_a_mapping"
    for name in ("trio_id", "question", "sql", "summary"):
        if not isinstance(entry.get(name), str) or not entry[name].strip():
            return f"missing_{name}"
    if entry["trio_id"] in seen:
        return "duplicate_id"
    for name in ("tags", "brands"):
        if not isinstance(entry.get(name, []), list) or any(not isinstance(x, str) for x in entry.get(name, [])):
            return f"bad_{name}"
    return None


def trios(spark: SparkSession, entries: list[Any], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a code); strict raises on the first rejection."""
    good, bad, seen = [], [], set()
    for i, e in enumerate(entries):
        if code := problem(e, seen):
            if strict:
                raise ValueError(f"entry {i}: {code}")
            bad.append((i, code))
        else:
            seen.add(e["trio_id"])
            good.append((e["trio_id"], e["question"], e["sql"], e["summary"], e.get("tags", []), e.get("brands", [])))
    return spark.createDataFrame(good, TRIO), spark.createDataFrame(bad, REJECT)


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation cases: one file, one case; the parent folder is the suite."""
    rows = []
    for path in sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yaml", ".yml", ".json")):
        e = load(str(path))
        for one in e if isinstance(e, list) else [e]:
            rows.append((one["id"], path.parent.name, one.get("input", ""), one.get("tags", []), one.get("must_contain", []), one.get("must_not_contain", [])))
    return spark.createDataFrame(rows, CASE)
