"""Numbering, micro-batches and ordered documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions.text import is_blank, json_record, srt_time

#: Rows of a micro-batch, the label of a row without speaker, the byte-order mark.
BATCH_ROWS, NO_SPEAKER, MARK = 10, "Speaker", "﻿"


def with_number(x: DataFrame, by: list[str], order: list[str], name: str, start: int = 0) -> DataFrame:
    return x.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1 + start).cast("int"))


def micro_batches(x: DataFrame, by: list[str], order: list[str], rows: int = BATCH_ROWS) -> DataFrame:
    """batch_id by position, the last one short."""
    return x.withColumn("batch_id", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / rows).cast("int"))


def ordered_text(order: Column, line: Column, between: str) -> Column:
    """Aggregate: lines in order as one document."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda s: s["l"]), between)


def batch_json(x: DataFrame, by: list[str], order: str, speaker: str) -> DataFrame:
    """One JSON array a batch, a record a line, with n, their number, and rows, the batch's rows in order. A record's id is
    its place in the item (the column order)."""
    record = F.concat(F.lit("  "), json_record(F.col(order), F.col("start_sec"), F.col("end_sec"), F.col("text"), F.col(speaker)))
    row = F.struct(order, *(c for c in x.columns if c not in (*by, "batch_id", order)))
    rows = F.array_sort(F.collect_list(row)).alias("rows")  # a batch's, so their number is bounded
    return x.groupBy(*by, "batch_id").agg(F.concat(F.lit("[\n"), ordered_text(F.col(order), record, ",\n"), F.lit("\n]")).alias("json"), F.count(F.lit(1)).alias("n"), rows)


def cue_lines(chunks: DataFrame) -> DataFrame:
    """Numbered cues of rows whose text is not blank: media_id, number, cue."""
    x = with_number(chunks.filter(~is_blank(F.col("text"))), ["media_id"], ["seg_idx"], "number", 1)
    label = F.coalesce("speaker_id", F.lit(NO_SPEAKER))
    cue = F.format_string("%d\n%s --> %s\n[%s] %s\n\n", "number", srt_time(F.col("start_sec")), srt_time(F.col("end_sec")), label, F.col("text"))
    return x.select("media_id", "number", cue.alias("cue"))


def srt_documents(chunks: DataFrame) -> DataFrame:
    """One document an item, led by a byte-order mark."""
    return cue_lines(chunks).groupBy("media_id").agg(F.concat(F.lit(MARK), ordered_text(F.col("number"), F.col("cue"), "")).alias("srt"))


def last_rows(x: DataFrame, order: list[str], n: int = 5000) -> DataFrame:
    """The last n rows in order: a bounded top-n, not a sort of all."""
    return x.orderBy(*(F.col(c).desc() for c in order)).limit(n)
