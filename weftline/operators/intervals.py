"""Interval operators. Times are numbers in any one unit (seconds as doubles, microseconds as longs); limits use it too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import trim_space

#: Fixed values, in seconds: least and greatest length of an interval, padding a side.
MIN_LENGTH, MAX_LENGTH, PADDING = 0.5, 8.0, 0.1
_NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)$"


def _number(text: Column) -> Column:
    text = trim_space(text)
    return F.when(text.rlike(_NUMBER), F.expr("try_cast(1 as double)") * text.try_cast("double"))


def parse_detector_log(log: DataFrame) -> DataFrame:
    """Lines (media_id, line_no, line) to events (media_id, line_no, starts, start_at, ends, end_at).

    starts: a silence begins at start_at, a number that takes the rest of the line. ends: one ends, at end_at if a number
    and a bar follow.
    """
    line = trim_space(F.col("line"))
    after = F.regexp_extract(line, r"silence_start: (.*)$", 1)
    end_rest = F.regexp_extract(line, r"silence_end: ([^|]*)\|", 1)
    x = log.select("media_id", "line_no", _number(after).alias("start_at"), F.when(line.contains("silence_end: "), True).otherwise(False).alias("ends"), _number(end_rest).alias("end_at"))
    x = x.withColumn("starts", F.col("start_at").isNotNull())
    return x.filter("starts OR ends")


def speech_intervals(media: DataFrame, events: DataFrame) -> DataFrame:
    """Complement of silences: media (media_id, total) and events as parse_detector_log gives them, to (media_id, start,
    end). Speech runs from the last parsed end of a silence, at first 0, to the next start, if that lies later; and to the
    total, unless the log ends inside a silence."""
    order = Window.partitionBy("media_id").orderBy("line_no")
    zero = F.lit(0)
    begin = F.coalesce(F.last("end_at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), zero)
    found = events.withColumn("begin", begin).filter(F.col("starts") & (F.col("start_at") > F.col("begin"))).select("media_id", F.col("begin").alias("start"), F.col("start_at").alias("end"))
    state = events.groupBy("media_id").agg(F.max_by(F.col("starts") & ~F.col("ends"), "line_no").alias("silent"), F.max_by("end_at", F.when(F.col("end_at").isNotNull(), F.col("line_no"))).alias("last_end"))
    tail = media.join(state, "media_id", "left").select("media_id", F.coalesce("last_end", zero).alias("start"), F.col("total").alias("end"), F.coalesce("silent", F.lit(False)).alias("silent"))
    tail = tail.filter(~F.col("silent") & (F.col("end") > F.col("start"))).drop("silent")
    return found.unionByName(tail)


def activity_islands(events: DataFrame, key: str, at: str, gap) -> DataFrame:  # noqa: ANN001
    """Gaps and islands: runs of a key's events no more than gap apart, as (key, island, start, end, n)."""
    order = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
    x = events.select(key, at).withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "island").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def pad(x: DataFrame, by=PADDING, total: str | None = None) -> DataFrame:  # noqa: ANN001
    """Both sides longer by `by`, within 0 and the total (a column)."""
    end = F.col("end") + by
    return x.withColumns({"start": F.greatest(F.col("start") - by, F.lit(0)), "end": F.least(end, F.col(total)) if total else end})


def long_enough(x: DataFrame, least=MIN_LENGTH) -> DataFrame:  # noqa: ANN001
    return x.filter(F.col("end") - F.col("start") >= least)


def split_long(x: DataFrame, most=MAX_LENGTH) -> DataFrame:  # noqa: ANN001
    """Intervals longer than `most` in pieces of that length, the rest however short; adds piece from 0."""
    length = F.col("end") - F.col("start")
    last = F.when(length > most, F.ceil(length / most).cast("int") - 1).otherwise(0)
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("start") + F.col("piece") * most
    return x.withColumns({"end": F.when(F.col("piece") < last, start + most).otherwise(F.col("end")), "start": start})


def or_whole(media: DataFrame, x: DataFrame, total: str = "total") -> DataFrame:
    """Media without any interval get one, [0, total]. x: media_id, start, end."""
    return media.select("media_id", total).join(x.select("media_id", "start", "end"), "media_id", "left").select("media_id", F.coalesce("start", F.lit(0)).alias("start"), F.when(F.col("start").isNull(), F.col(total)).otherwise(F.col("end")).alias("end"))


def voice_segments(media: DataFrame, log: DataFrame) -> DataFrame:
    """The detector's log to the final segments, numbered: complement, padding, least length, splitting, fallback."""
    x = speech_intervals(media, parse_detector_log(log))
    x = long_enough(pad(x.join(media, "media_id"), total="total"))
    x = or_whole(media, split_long(x))
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("start", "end")) - 1
    return x.select("media_id", number.cast("int").alias("seg_idx"), F.col("start").alias("start_sec"), F.col("end").alias("end_sec"))


def to_samples(x: DataFrame, samples: str = "n_samples", rate: int = 16_000) -> DataFrame:
    """start_sec, end_sec as sample numbers, truncated and within 0 and the number of samples; empty ones go."""
    number = lambda c: F.greatest((F.col(c) * rate).cast("long"), F.lit(0).cast("long"))
    x = x.withColumns({"start_sample": number("start_sec"), "end_sample": F.least(number("end_sec"), F.col(samples))})
    return x.filter(F.col("start_sample") < F.col("end_sample"))
