"""What a statement used, in words; literals, labels and notes derived from it."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import SparkSession

from .catalog import TABLES
from .plans import policy
from .scope import Scope

WORDS = {"users": "customers", "orders": "orders", "order_items": "items sold", "products": "products"}
COLUMN_WORDS = {"sale_price": "sale price", "created_at": "order date", "delivered_at": "delivery date", "traffic_source": "market segment", "retail_price": "list price"}


def describe_data_used(facts: policy.Facts) -> str:
    """Tables and columns in business words; key columns are left out."""
    parts = []
    for t in sorted(facts.tables):
        shown = sorted(COLUMN_WORDS.get(c, c.replace("_", " ")) for u, c in facts.columns if u == t and not TABLES[t][c].id_key)
        parts.append(WORDS[t] + (f" ({', '.join(shown)})" if shown else ""))
    return "Based on " + "; ".join(parts) + "." if parts else "Based on no table."


def brand_literals(spark: SparkSession, sql: str) -> set[str]:
    """Brands that a statement names in comparisons with a ``brand`` column."""
    out: set[str] = set()
    for n in policy.parsed(spark, sql).walk():
        if n.name in ("EqualTo", "EqualNullSafe", "In") and any(c.name == "UnresolvedAttribute" and c.parts[-1].lower() == "brand" for c in n.children):
            out |= {str(c.fields.get("value")) for c in n.children if c.name == "Literal"}
    return out


def humanize_identifiers(text: str) -> str:
    """Table and column names in a text as business words."""
    words = WORDS | COLUMN_WORDS
    return re.sub(r"\b(" + "|".join(sorted(words, key=len, reverse=True)) + r")\b", lambda m: words[m[0]], text)


def strip_sql(text: str) -> str:
    """Fenced blocks and bare statements out of a text."""
    text = re.sub(r"```.*?```", "", text, flags=re.S)
    return re.sub(r"(?im)^\s*(?:select|with)\b.*?(?:;|\n\s*\n|\Z)", "", text, flags=re.S).strip()


def assumptions_footer(scope: Scope, facts: policy.Facts) -> str:
    """What the figures assume."""
    said = ["All products." if scope.everything else f"Brands: {', '.join(sorted(scope.brands))}."]
    if ("order_items", "sale_price") in facts.columns:
        said.append("Revenue leaves out returned items.")
    if "orders" in facts.tables and "users" in facts.tables:
        said.append("A customer has churned who ordered in one month and not in the next.")
    return " ".join(said)


def label_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:16]


def sanitised_labels(labels: dict[str, str]) -> dict[str, str]:
    """Job labels: lower case, safe characters, ids hashed."""
    clean = lambda s: re.sub(r"[^a-z0-9_-]", "_", s.lower())[:63]
    return {clean(k): label_hash(v) if k.endswith(("_id", "user", "session")) else clean(v) for k, v in labels.items()}
