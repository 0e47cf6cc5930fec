"""Operator 6: mix sources to target weights by entropy balancing.

Targets.  Sources in code-point order, null last, weigh 1, 2, 3, 1, 2, 3, ...
and share all words.  A source's target stops at ``max_epochs`` times its own
size; the excess is shared again by weight, until no target is above.

Rates.  Among all ways to reweight the documents that meet the targets, take the
one closest in relative entropy to one of each document, with no rate above
``max_epochs``.  The dual is convex, one multiplier per token constraint, and its
optimum tilts documents exponentially: a document of ``size`` words in source s
is taken exp(lambda_s * size / mean_s) times, up to the bound.  Each Newton
iteration sums the gradient and the Hessian over all documents in parallel (by
source and size, of which both are functions); a step that leaves the bracket
known so far is replaced by its middle.

Copies.  Every document gets floor(rate) copies.  The fractions that are left are
settled in the order of hash minus fraction, hash being uniform by document: a
document whose fraction is larger comes sooner.  Three passes over counts by 256
bins of that order find where the missing words are reached, so a source with any
number of rows sends 256 numbers per pass.  What is left of the gap is then
closed by single documents whose size fits it best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, prepare, stored, texts_as_bytes

MAX_EPOCHS = 3.0
WEIGHTS = (1.0, 2.0, 3.0)
#: Newton steps in one Spark job, and such jobs at most.
CHAIN, CHAINS = 4, 15
BITS, LEVELS = 8, 3
FITS = 3
SEED = 20


def sized(docs: DataFrame, row: Column | None) -> DataFrame:
    """doc_id, row, source, size (words between ASCII white space), unit (uniform by document), stored."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_as_bytes(batch.column(3))
            n, h = [len(x.split()) for x in texts], [xxhash.xxh64_intdigest(x, SEED) >> 1 for x in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(h, pa.int64())], names=["doc_id", "row", "source", "size", "h"])

    given = F.lit(None).cast("long") if row is None else row.cast("long")
    plain = docs.select(F.col("doc_id").cast("long"), given.alias("row"), F.col("source").cast("string"), F.col("text").cast("string"))
    counted = plain.mapInArrow(count, "doc_id long, row long, source string, size long, h long")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "doc_id", "h"), 11) / float(1 << 53)
    return stored(counted.select("doc_id", "row", "source", "size", unit.alias("unit")), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, words, mean (of the documents that hold words), target: one row per source.

    With sources sorted by cap / weight, the shared level is the first one at
    which every remaining source stays within its cap.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("words"), (F.sum("size") / F.greatest(F.lit(1), F.sum((F.col("size") > 0).cast("int")))).alias("mean"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighted = by_source.withColumn("weight", weight).withColumn("cap", F.col("words") * max_epochs)
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    before = filling.rowsBetween(W.unboundedPreceding, -1)
    after = filling.rowsBetween(0, W.unboundedFollowing)
    levels = weighted.withColumn(
        "level", (F.sum("words").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    )
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    shared = levels.withColumn("shared", F.min_by(F.col("level"), F.when(fits.isNotNull(), F.struct(F.col("cap") / F.col("weight"), F.col("source")))).over(whole))
    return shared.select("source", "words", "mean", F.least(F.col("cap"), F.coalesce(F.col("shared") * F.col("weight"), F.col("cap"))).alias("target"))


def tilted(lam: Column, size: Column, mean: Column, max_epochs: float) -> Column:
    """The rate exp(lam * size / mean), max_epochs at most."""
    return F.least(F.lit(float(max_epochs)), F.exp(F.least(lam * size / mean, F.lit(math.log(max_epochs) + 1))))


def near(value: Column, target: Column) -> Column:
    return F.abs(value - target) <= 1e-7 * target + 0.05


def newton_step(state: DataFrame, sizes: DataFrame, max_epochs: float) -> DataFrame:
    """One iteration: the dual's gradient and Hessian by source, and the next multiplier."""
    s = state.withColumnRenamed("source", "s_source")
    lam, size, mean, n = F.col("lam"), F.col("size"), F.col("mean"), F.col("n")
    rate = tilted(lam, size, mean, max_epochs)
    sums = (
        sizes.join(s, F.col("source").eqNullSafe(F.col("s_source"))).groupBy("source", "words", "mean", "target", "lam", "lo", "hi")
        .agg(F.sum(n * size * rate).alias("value"), F.sum(F.when(rate < max_epochs, n * size * size / mean * rate).otherwise(0.0)).alias("slope"))
    )
    low = F.col("value") < F.col("target")
    lo, hi = F.when(low, lam).otherwise(F.col("lo")), F.when(low, F.col("hi")).otherwise(lam)
    middle = F.when(lo.isNull(), 2 * hi - 1).when(hi.isNull(), 2 * lo + 1).otherwise((lo + hi) / 2)
    step = lam - (F.col("value") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
    inside = step.isNotNull() & (lo.isNull() | (step > lo)) & (hi.isNull() | (step < hi)) & (F.abs(step - lam) <= 2 * (1 + F.abs(lam)))
    done = near(F.col("value"), F.col("target"))
    after = F.when(done, lam).when(inside, step).otherwise(middle)
    return sums.select("source", "words", "mean", "target", after.alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done"))


def multipliers(sizes: DataFrame, table: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, words, mean, target, lam: the dual's solution, one row per source; stored.

    lam is null where every document is taken max_epochs times, or none has words.
    """
    counts = stored(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-counts")
    full = (F.col("words") == 0) | (F.col("target") >= F.col("words") * max_epochs * (1 - 1e-9))
    none = F.lit(None).cast("double")
    known = stored(table, "mix-targets")
    state = known.where(~full).select("source", "words", "mean", "target", F.lit(0.0).alias("lam"), none.alias("lo"), none.alias("hi"), F.lit(False).alias("done"))
    for _ in range(CHAINS):
        for _ in range(CHAIN):
            state = newton_step(state, counts, max_epochs)
        state = stored(state, "mix-newton")
        if not state.where("not done").take(1):
            break
    solved = state.select("source", "words", "mean", "target", "lam")
    return stored(solved.unionByName(known.where(full).select("source", "words", "mean", "target", none.alias("lam"))), "mix-multipliers")


def rated(sizes: DataFrame, solved: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Every document with its rate, whole copies (base) and place in its source's order (h); stored."""
    s = solved.withColumnRenamed("source", "s_source")
    # Rounded, so that sums taken in another order give the same rates again.
    tilt = F.round(tilted(F.col("lam"), F.col("size"), F.col("mean"), max_epochs), 9)
    joined = sizes.join(s, F.col("source").eqNullSafe(F.col("s_source")))
    out = joined.withColumn("rate", F.when(F.col("size") == 0, 1.0).when(F.col("lam").isNull(), float(max_epochs)).otherwise(tilt))
    out = out.withColumn("base", F.floor("rate"))
    place = (F.col("unit") - (F.col("rate") - F.col("base")) + 1) / 2
    out = out.withColumn("h", F.floor(place * float(1 << 52)).cast("long") * 2048).withColumn("can", (F.col("base") < max_epochs) & (F.col("size") > 0))
    return stored(out.select("doc_id", "row", "source", "size", "words", "target", "rate", "base", "h", "can"), "mix-rates")


def digit(level: int) -> Column:
    return F.shiftrightunsigned("h", 64 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, row: Column | None = None) -> DataFrame:
    """How often the mix takes each document.

    Returns one row per input row: doc_id, source, size, source_size, target,
    rate, copies (0 to max_epochs), taken (copies * size), and row where one is
    given.  A null text has size 0 and is taken once, which takes no word; a null
    source is a source of its own; rows of one doc_id and text share
    a place in the order; other columns are ignored; an empty table gives an
    empty result.  Reruns agree.
    """
    prepare(docs.sparkSession)
    sizes = sized(docs, row)
    solved = multipliers(sizes, targets(sizes, weights, max_epochs), max_epochs)
    docs_rated = rated(sizes, solved, max_epochs)
    discard(sizes)
    left = docs_rated.groupBy("source", "target").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("gap"))
    state = stored(left.select("source", F.col("gap").cast("double").alias("gap"), F.lit(0).cast("long").alias("prefix"), (F.col("gap") > 0.5).alias("open")), "mix-sources")

    for level in range(LEVELS):
        inside = F.lit(True) if level == 0 else F.shiftrightunsigned("h", 64 - BITS * level) == F.col("prefix")
        s = state.withColumnRenamed("source", "s_source")
        bins = (
            docs_rated.where("can").join(s, F.col("source").eqNullSafe(F.col("s_source"))).where(F.col("open") & inside)
            .groupBy("source", digit(level).alias("bin")).agg(F.sum("size").alias("n"), F.first("gap").alias("gap"))
        )
        upto = F.sum("n").over(W.partitionBy("source").orderBy("bin"))
        found = (
            bins.withColumn("upto", upto).groupBy("source")
            .agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bin", (F.col("upto") - F.col("n")).alias("before")))).alias("at"), F.max("upto").alias("all"))
            .withColumnRenamed("source", "f_source")
        )
        # A source whose candidates all fit takes every bin: its place is beyond the last.
        at = F.coalesce(F.col("at.bin"), F.lit(1 << BITS))
        used = F.coalesce(F.col("at.before"), F.col("all"), F.lit(0))
        state = stored(
            state.join(found, F.col("source").eqNullSafe(F.col("f_source")), "left").select(
                "source", F.when(F.col("open"), F.col("gap") - used).otherwise(F.col("gap")).alias("gap"),
                F.when(F.col("open"), F.col("prefix") * (1 << BITS) + at).otherwise(F.col("prefix")).alias("prefix"), "open",
            ), "mix-sources",
        )

    lead = F.shiftrightunsigned("h", 64 - BITS * LEVELS)
    joined = docs_rated.join(state.withColumnRenamed("source", "s_source"), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    at_edge = F.col("open") & F.col("can") & (lead == F.col("prefix"))
    edge = joined.where(at_edge).withColumn("upto", F.sum("size").over(W.partitionBy("source").orderBy("h", "size", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0)))
    picked = joined.where(~at_edge).withColumn("extra", (F.col("open") & F.col("can") & (lead < F.col("prefix"))).cast("int")).unionByName(
        edge.withColumn("extra", (F.col("upto") <= F.col("gap")).cast("int")).drop("upto")
    )
    columns = ["doc_id", "row", "source", "size", "h", "words", "target", "rate", "base", "can", "open", "extra"]
    picked = stored(picked.select(*columns), "mix-picked")
    discard(docs_rated)

    for _ in range(FITS):
        gaps = picked.groupBy("source", "target").agg((F.first("target") - F.sum((F.col("base") + F.col("extra")) * F.col("size"))).alias("left"))
        g = gaps.select(F.col("source").alias("g_source"), "left")
        off = F.abs(F.col("left") - F.col("size"))
        fit = (
            picked.where(F.col("open") & F.col("can") & (F.col("extra") == 0)).join(g, F.col("source").eqNullSafe(F.col("g_source")))
            .where(off < F.col("left")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "h", "doc_id", "row", "size")).alias("fit"))
        ).select(F.col("source").alias("f_source"), F.col("fit.doc_id").alias("f_doc"), F.col("fit.row").alias("f_row"), F.col("fit.h").alias("f_h"), F.col("fit.size").alias("f_size"))
        same = F.col("doc_id").eqNullSafe(F.col("f_doc")) & F.col("row").eqNullSafe(F.col("f_row")) & (F.col("h") == F.col("f_h")) & (F.col("size") == F.col("f_size"))
        hit = F.col("f_size").isNotNull() & same & (F.col("extra") == 0) & F.col("open")
        before = picked
        picked = stored(picked.join(fit, F.col("source").eqNullSafe(F.col("f_source")), "left").withColumn("extra", F.when(hit, 1).otherwise(F.col("extra"))).select(*columns), "mix-picked")
        discard(before)

    copies = (F.col("base") + F.col("extra")).cast("int")
    out = picked.select("doc_id", "row", "source", "size", F.col("words").alias("source_size"), "target", "rate", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
    return out.drop("row") if row is None else out
