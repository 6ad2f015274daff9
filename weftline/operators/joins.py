"""Joins by time tolerance and by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def band_join(left: DataFrame, right: DataFrame, key: str, by: list[str], left_at: str, right_at: str, width, order: str, value: str, missing: str) -> DataFrame:  # noqa: ANN001
    """For each row of left, by its unique key, `value` of the first row of right, in `order`, that lies less than width from
    it; `missing` if none does. Gives (key, value). First match, not nearest; equal in order: the lesser value.

    No pairs are made. Both sides are cut into slots of the given width. A row of left asks three: its own counts whole, the
    one after it up to left + width, the one before it down to left - width. Asks and rows of a slot are sorted by place once
    a direction, and a running minimum answers them, so a dense slot costs a sort, not its square.
    """
    at = F.col("_at")
    slot = lambda c: F.floor(F.col(c) / width).cast("long")
    holds = right.select(*by, slot(right_at).alias("_slot"), F.col(right_at).alias("_at"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_row"))
    asks = left.select(key, *by, F.col(left_at).alias("_at"), F.explode(F.array(*map(F.lit, (-1, 0, 1)))).alias("_side"), slot(left_at).alias("_slot"))
    asks = asks.withColumns({"_slot": F.col("_slot") + F.col("_side"), "_at": at + F.col("_side") * width})
    both = asks.unionByName(holds, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "_slot")
    is_row = F.col("_row").isNotNull()  # an ask comes before rows of its place: those are too far
    so_far = lambda first: F.min("_row").over(inside.orderBy(first, is_row).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumns({"_up": so_far(at.asc()), "_down": so_far(at.desc()), "_all": F.min("_row").over(inside)})
    found = found.filter(F.col("_side").isNotNull())
    best = F.when(F.col("_side") == 0, F.col("_all")).when(F.col("_side") == 1, F.col("_up")).otherwise(F.col("_down"))
    return found.groupBy(key).agg(F.coalesce(F.min(best)["v"], F.lit(missing)).alias(value))


def zip_positions(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the same place of an item, side by side; a place that one of them lacks goes."""
    return a.join(b, ["media_id", "seg_idx"])
