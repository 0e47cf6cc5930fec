"""Operator 8: secret scan with an incremental blob ledger, in SQL functions only.

Every version of every text is content-addressed by its SHA-256.  The ledger, a
Parquet table, records for each blob which rules, at which version, have been
scanned and what they found.  A run combines equal blobs, scans only the blob
and rule-version pairs that the ledger lacks, appends them, and joins the
findings back to all rows (paths) that hold a blob.

Positions come from the built-in expressions alone: the pieces between the
matches (``split``) and the matches (``regexp_extract_all``), taken in turn,
add up to the offsets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_table, stored

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``maybe`` is a cheap test of the whole text."""

    kind: str
    version: int
    pattern: str
    maybe: Callable[[Column], Column]
    accept: Callable[[Column], Column] | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds come first; their order breaks ties on the start.
BASE = ("assign", "access", "hex")
RULES = (
    Rule("assign", 1, ASSIGN, lambda t: t.rlike(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6),
    Rule("access", 1, "AKIA[A-Z0-9]{16,}", lambda t: t.contains("AKIA")),
    Rule("hex", 1, "[0-9a-f]{24,}", lambda t: t.rlike("[0-9a-f]{24}")),
    Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", lambda t: t.contains("PRIVATE KEY-----")),
    Rule("forge", 1, "gh[pousr]_[A-Za-z0-9]{36,}", lambda t: t.contains("ghp_") | t.contains("gho_") | t.contains("ghu_") | t.contains("ghs_") | t.contains("ghr_")),
    Rule("chat", 1, "xox[abprs]-[A-Za-z0-9-]{10,}", lambda t: t.contains("xox")),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", lambda t: t.contains("eyJ")),
)

#: Matches of a text whose offsets are added up in one array.
STRETCH = 64

SPAN = "struct<start: int, rank: int, end: int, kind: string, rule: string>"
LEDGER = f"blob string, rules array<string>, spans array<{SPAN}>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed a single time, though use may name it often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """The accepted matches of one rule, with code-point offsets."""
    none = F.array().cast(f"array<{SPAN}>")
    turns = F.zip_with(
        F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda gap, hit: F.struct(F.length(gap).alias("skip"), F.length(hit).alias("n"), (hit.isNotNull() & (rule.accept(hit) if rule.accept else F.lit(True))).alias("good")),
    )

    def one(acc: Column, turn: Column) -> Column:
        start = acc["at"] + turn["skip"]
        end = start + F.coalesce(turn["n"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(rule.name).alias("rule"))
        return F.struct(end.alias("at"), F.when(turn["good"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(f"array<{SPAN}>").alias("out"))

    def stretches(every: Column) -> Column:
        """By stretches of STRETCH turns, so that no array grows turn by turn over a whole text."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / STRETCH).cast("int")), lambda i: F.slice(every, i * STRETCH + 1, F.lit(STRETCH)))
        return once(parts, placed)

    def placed(parts: Column) -> Column:
        lengths = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda n, turn: n + turn["skip"] + F.coalesce(turn["n"], F.lit(0))))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        begins = F.aggregate(lengths, zero, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        own = lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), one, lambda acc: acc["out"])
        return F.flatten(F.zip_with(parts, begins, own))

    return F.when(rule.maybe(text), once(turns, stretches)).otherwise(none)


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    """The ledger's rows; none where it does not exist yet."""
    spark = docs.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(LEDGER).parquet(ledger) if there else spark.createDataFrame([], LEDGER)


def scan_into(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the blob and rule-version pairs that the ledger lacks, and append them."""
    names = F.array(*(F.lit(r.name) for r in rules))
    blobs = docs.select(F.sha2(F.col("text"), 256).alias("blob"), "text").dropDuplicates(["blob"])
    seen = read_ledger(docs, ledger).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    todo = blobs.join(seen, "blob", "left").withColumn("rules", F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("rules") > 0)
    none = F.array().cast(f"array<{SPAN}>")
    found = [F.when(F.array_contains("rules", r.name), spans_of(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)]
    todo.select("blob", "rules", F.concat(*found).alias("spans")).write.mode("append").parquet(ledger)


def secret_spans(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and spans (kind, start, end) by start, then kind as in ``rules``.

    One row per input row.  A null text counts as empty.  Null and repeated
    doc_ids pass through; other columns are ignored; an empty table stays
    empty.  ``ledger`` is a Parquet path that later runs may share; without it
    a fresh one is kept in the shared folder.  A blob that two runs appended at
    the same time counts once.
    """
    ledger = ledger or new_table(docs.sparkSession, "blob-ledger")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    scan_into(plain, ledger, rules)
    current = F.array(*(F.lit(r.name) for r in rules))
    known = (
        read_ledger(docs, ledger).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("all"))
        .select("blob", F.array_sort(F.array_distinct(F.filter("all", lambda s: F.array_contains(current, s["rule"])))).alias("spans"))
    )
    known = stored(known, "secret-findings")  # joined as a table of its own, so that a hot blob's rows can be split
    paths = plain.select("doc_id", F.sha2("text", 256).alias("blob"))
    return paths.join(known, "blob").select("doc_id", "blob", "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns from secret_spans()."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
