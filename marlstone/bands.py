"""Merging of small customer bands, as a DataFrame operator.

Rows with fewer than k customers become one row, ``other bands``.  If that row
is still below k, the smallest remaining band joins it (ties by label); if none
remains, the small rows are hidden.  The result has at most a row per band, so
the windows below run over a capped answer, not over data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OTHER = "other bands"


def merge_small_bands(rows: DataFrame, label: str, count: str, additive: tuple[str, ...] = (), windows: tuple[str, ...] = (), k: int = 5) -> DataFrame:
    """Bands of k customers or more; sums for the additive columns of the merged
    row, null elsewhere, and null window columns once anything was merged."""
    every = W.partitionBy()
    small = F.col(count) < k
    flagged = (
        rows.withColumn("__small", small).withColumn("__sum", F.sum(F.when(small, F.col(count))).over(every))
        .withColumn("__place", F.row_number().over(W.partitionBy("__small").orderBy(count, label)))
    )
    partner = ~F.col("__small") & (F.col("__sum") < k) & (F.col("__place") == 1)
    flagged = flagged.withColumn("__merge", F.coalesce(F.col("__small") | partner, F.lit(False)))
    summed = {count, *additive}
    total = flagged.where("__merge").groupBy().agg(F.count("*").alias("__n"), *(F.sum(c).alias(f"__{c}") for c in summed)).where((F.col("__n") > 0) & (F.col(f"__{count}") >= k))
    kinds = dict(rows.dtypes)
    one = total.select(*(F.lit(OTHER).alias(c) if c == label else (F.col(f"__{c}") if c in summed else F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns))
    masked = [F.when(F.col("__sum").isNull(), F.col(c)).alias(c) if c in windows else F.col(c) for c in rows.columns]
    return flagged.where(~F.col("__merge")).select(*masked).unionByName(one)
