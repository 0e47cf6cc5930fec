"""The report library: arguments, search modes, opening, draft rules."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .operators.search import FIELD_WEIGHTS, bm25, cosine, rrf

MOST_REPORTS, MOST_HITS = 200, 50
DRAFT_SECTIONS = ("summary", "findings", "actions")


@dataclass
class SearchArgs:
    words: str = ""
    tags: list[str] = field(default_factory=list)
    since: date | None = None
    until: date | None = None


def parse_search_args(text: str) -> SearchArgs:
    """``words tag:x from:2024-01-01 to:2024-02-01`` in any order."""
    out, words = SearchArgs(), []
    for part in text.split():
        name, _, value = part.partition(":")
        if name == "tag" and value:
            out.tags.append(value.casefold())
        elif name in ("from", "to") and re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            setattr(out, "since" if name == "from" else "until", date.fromisoformat(value))
        else:
            words.append(part)
    out.words = " ".join(words)
    return out


def normalize_query(text: str) -> str | None:
    """Canonical query; None if it has under 3 letters or digits or over 100 characters."""
    text = " ".join(unicodedata.normalize("NFKC", text).split()).casefold()
    return text if len(text) <= 100 and sum(c.isalnum() for c in text) >= 3 else None


def terms_of(text: str, most: int = 16) -> tuple[str, ...]:
    return tuple(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))[:most]


def visible(reports: DataFrame, owner: str, scope_brands: list[str] | None) -> DataFrame:
    """An owner's newest reports; those outside the current scope lose their title and body.

    Reports carry ``brands``; None as scope means all brands.
    """
    mine = reports.where(F.col("owner") == owner).orderBy(F.desc("created_at"), F.desc("report_id")).limit(MOST_REPORTS)
    if scope_brands is None:
        return mine.withColumn("in_scope", F.lit(True))
    inside = F.size(F.array_except("brands", F.array(*(F.lit(b) for b in scope_brands)).cast("array<string>"))) == 0
    hidden = lambda c: F.when(F.col("in_scope"), F.col(c)).otherwise(F.lit("[outside your scope]"))
    return mine.withColumn("in_scope", inside).withColumns({"title": hidden("title"), "body": hidden("body")})


def search(reports: DataFrame, args: SearchArgs, mode: str = "substring", vectors: DataFrame | None = None, asked: list[float] | None = None, min_score: float = 0.3) -> DataFrame:
    """report_id, score, reason in order of relevance (date in substring mode)."""
    kept = reports
    if args.tags:
        kept = kept.where(F.size(F.array_except(F.array(*(F.lit(t) for t in args.tags)), F.transform("tags", F.lower))) == 0)
    if args.since:
        kept = kept.where(F.to_date("created_at") >= F.lit(args.since))
    if args.until:
        kept = kept.where(F.to_date("created_at") <= F.lit(args.until))
    needle = normalize_query(args.words) if args.words else ""
    if mode == "substring":
        hit = F.lit(True) if not needle else F.lower("title").contains(needle) | F.lower("body").contains(needle)
        return kept.where(hit & F.lit(needle is not None)).orderBy(F.desc("created_at"), "report_id").select("report_id", F.lit(None).cast("double").alias("score"), F.lit("words").alias("reason"))
    plain = kept.select(F.col("report_id").alias("doc_id"), "title", "body", F.array_join("tags", " ").alias("tags"))
    words = bm25(plain, terms_of(args.words) or ("",), FIELD_WEIGHTS).select(F.col("doc_id").alias("id"), "score")
    if mode == "ranked":
        return words.select(F.col("id").alias("report_id"), "score", F.lit("words").alias("reason")).orderBy(F.desc("score"), "report_id").limit(MOST_HITS)
    q = F.array(*(F.lit(float(x)) for x in asked or []))
    near = vectors.join(kept.select("report_id"), "report_id", "left_semi").where(F.size("vector") == len(asked or [])).select(F.col("report_id").alias("id"), cosine(F.col("vector"), q).alias("score")).where(F.col("score") >= min_score)
    top = lambda f: f.orderBy(F.desc("score"), "id").limit(MOST_HITS).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).select("id", "rank")
    a, b = top(words), top(near)
    marks = a.select("id", F.lit(1).alias("m")).unionByName(b.select("id", F.lit(2).alias("m"))).groupBy("id").agg(F.sum("m").alias("m"))
    reason = F.when(F.col("m") == 3, "words+similar").when(F.col("m") == 1, "words").otherwise("similar")
    fused = rrf(a, b).join(marks, "id")
    return fused.orderBy(F.desc("score"), "best", "id").limit(MOST_HITS).select(F.col("id").alias("report_id"), "score", reason.alias("reason"))


def open_report(reports: DataFrame, said: str) -> tuple[str, list]:
    """('one', [row]), ('many', rows) or ('none', []) for an id, a row number or a phrase."""
    listed = reports.orderBy(F.desc("created_at"), "report_id").limit(MOST_REPORTS).collect()
    by_id = [r for r in listed if r.report_id == said]
    if by_id:
        return "one", by_id
    if said.isdigit() and 0 < int(said) <= len(listed):
        return "one", [listed[int(said) - 1]]
    needle = normalize_query(said)
    found = [r for r in listed if needle and needle in f"{r.title} {r.body}".casefold()]
    return ("none", []) if not found else ("one", found) if len(found) == 1 else ("many", found)


def draft_problems(draft: dict) -> list[str]:
    """Rules of a report draft: sections, 120 words of summary at most, 3 actions or more."""
    out = [f"missing_{s}" for s in DRAFT_SECTIONS if not draft.get(s)]
    if len(str(draft.get("summary", "")).split()) > 120:
        out.append("summary_too_long")
    if len(draft.get("actions") or []) < 3:
        out.append("too_few_actions")
    return out
