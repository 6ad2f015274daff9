"""Mixing sources to target weights with hash-threshold histograms, in Spark expressions only.

Each document has a fixed pseudo-random key. Sizes are summed by source and by the key's leading bits; the running sum
shows in which histogram bucket a source's budget ends; only that bucket is split by the next bits, and so on, until
a threshold is left that a plain filter applies. Nothing is sorted but the few rows of the last boundary bucket.
A source whose target exceeds its size repeats whole documents: each one floor(target / size) times, and those below
the threshold once more. Thresholds are nested: a larger budget keeps all that a smaller one kept.

Defined cases: null text has size 0 and is taken 0 words; a null source is a source of its own, last in order;
repeated rows are rows of their own, told apart by their rank; a source without words has target 0; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import pick, stored, word_count

#: Bits of the key that one histogram resolves, and how many histograms are refined one after the other.
LEVEL_BITS, LEVELS = 10, 3


def mix_key(doc_id: Column) -> Column:
    """30 bits of the identifier's MD5: the same in every run, engine and cluster."""
    head = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.shiftright(F.conv(head, 16, 10).cast("long"), 2)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """sources (source, source_size) with a target each: the total shared by weight, no target above max_repeat times
    the source's size, the excess reshared by weight. Sources reach their limits in order of limit per weight, so the
    level at which sharing settles follows from running sums: no iteration. One row a source goes through one task."""
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((order - 1) % len(weights) + 1).cast("int"))
    x = sources.select("source", "source_size", cycle.alias("weight")).withColumn("limit", F.col("source_size") * max_repeat)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    below, on = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    x = x.select(
        "*",
        F.coalesce(F.sum("limit").over(below), F.lit(0)).alias("limits_below"),
        F.coalesce(F.sum("weight").over(below), F.lit(0)).alias("weights_below"),
        F.sum("source_size").over(on).alias("total"),
        F.sum("weight").over(on).alias("weights"),
    )
    # The level if exactly the sources before this one are held at their limits; it holds from the first that has room.
    x = x.withColumn("level", (F.col("total") - F.col("limits_below")) / (F.col("weights") - F.col("weights_below")))
    x = x.withColumn("room", F.col("level") * F.col("weight") <= F.col("limit"))
    level = F.min(F.when(F.col("room"), F.struct(F.col("limit") / F.col("weight"), F.col("limits_below"), F.col("level").alias("at")))).over(on)["at"]
    x = x.withColumn("settled", level)
    return x.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("settled") * F.col("weight")).alias("target"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Every row with doc_id, source, size, source_size, target and copies (how often the mix takes the whole document).

    The document at the boundary is kept if that brings its source nearer to the target, so a source misses its target by
    at most half that document.
    """
    slim = stored(_sized(pick(docs, "doc_id", "source", "text")).drop("text"), "mix")
    return _apply(slim, _plan(slim, weights, max_repeat), max_repeat).select("doc_id", "source", "size", "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The mix itself: docs' rows, whole, as often as the mix takes them. docs has unique column names."""
    plan = _plan(stored(_sized(docs.select("doc_id", "source", "text")).drop("text"), "mix"), weights, max_repeat)
    taken = _apply(_sized(docs), plan, max_repeat).filter(F.col("copies") > 0)
    again = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_again")
    return taken.select(*docs.columns, again).drop("_again")


def _sized(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return docs.withColumns({"size": word_count(F.col("text")), "key": mix_key(F.col("doc_id")), "crc": crc})


def _plan(slim: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """One row a source: target, whole repeats, the boundary key (prefix) and the budget left for the rows that have it."""
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, max_repeat)
    size, target = F.col("source_size"), F.col("target")
    whole = F.when(size > 0, F.least(F.floor(target / size), F.lit(max_repeat))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("budget", target - F.col("whole") * size)
    plan = stored(plan.withColumn("prefix", F.lit(0).cast("long")), "mix-plan")
    # Level by level: histogram of the boundary bucket only, the bucket in which the budget ends, what lies before it.
    total_bits = LEVEL_BITS * LEVELS
    for level in range(1, LEVELS + 1):
        left = total_bits - LEVEL_BITS * level
        inside = slim.join(plan.select(F.col("source").alias("s"), "prefix"), F.col("source").eqNullSafe(F.col("s")))
        inside = inside.filter(F.shiftright("key", left + LEVEL_BITS) == F.col("prefix"))
        hist = inside.groupBy("source", F.shiftright("key", left).alias("bucket")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "s")
        ends = plan.join(hist, F.col("source").eqNullSafe(F.col("s")), "left")
        past = F.max(F.when(F.col("upto") <= F.col("budget"), F.struct("bucket", "upto"))).alias("p")
        held = F.sort_array(F.collect_list("bucket")).alias("held")  # at most 2 ** LEVEL_BITS values
        ends = ends.groupBy("source", "source_size", "target", "whole", "budget", "prefix").agg(past, held)
        later = F.filter("held", lambda b: F.col("p.bucket").isNull() | (b > F.col("p.bucket")))
        after = F.when(F.size(later) > 0, F.element_at(later, 1)).otherwise(F.shiftleft(F.col("prefix"), LEVEL_BITS) + (1 << LEVEL_BITS))
        plan = stored(ends.select("source", "source_size", "target", "whole", (F.col("budget") - F.coalesce(F.col("p.upto"), F.lit(0))).alias("budget"), after.alias("prefix")), "mix-plan")
    return plan


def _apply(rows: DataFrame, plan: DataFrame, max_repeat: int) -> DataFrame:
    """rows with the plan's figures and copies. Below the boundary key: in. At it: by rank, while it brings the sum nearer."""
    joined = rows.join(plan.select(F.col("source").alias("s"), "source_size", "target", "whole", "budget", "prefix"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    clear = joined.filter(F.col("key") != F.col("prefix")).withColumn("more", F.when(F.col("key") < F.col("prefix"), 1).otherwise(0))
    edge = Window.partitionBy("source", "key").orderBy("doc_id", "crc", "size").rowsBetween(Window.unboundedPreceding, 0)
    tied = joined.filter(F.col("key") == F.col("prefix")).withColumn("upto", F.sum("size").over(edge))
    tied = tied.withColumn("more", F.when(F.col("upto") - F.col("size") / 2 < F.col("budget"), 1).otherwise(0)).drop("upto")
    return clear.unionByName(tied).withColumn("copies", F.least(F.col("whole") + F.col("more"), F.lit(max_repeat)).cast("long"))
