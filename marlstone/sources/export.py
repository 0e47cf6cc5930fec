"""Reports as text files in a folder of their own."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(report: DataFrame) -> DataFrame:
    """One text column: title, tags and body of each report."""
    tags = F.when(F.size("tags") > 0, F.concat(F.lit("\n\nTags: "), F.array_join("tags", ", "))).otherwise("")
    return report.select(F.concat(F.lit("# "), "title", tags, F.lit("\n\n"), "body", F.lit("\n")).alias("value"))


def export(report: DataFrame, folder: str, title: str) -> str:
    """Write to a new folder named after the title; an existing one is an error."""
    name = re.sub(r"[^a-z0-9]+", "-", title.lower()).strip("-") or "report"
    path = f"{folder.rstrip('/')}/{name}"
    markdown(report).write.mode("errorifexists").text(path)
    return path
