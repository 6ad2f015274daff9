"""Sinks: subtitle documents as files, muxing by an external tool, and what happens when that fails."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.batches import srt_documents


def write_srt(chunks: DataFrame, path: str) -> None:
    """One text file an item, in a folder named after it, written by the executors."""
    docs = srt_documents(chunks).repartitionByRange("media_id")
    body = F.regexp_replace("srt", r"\n\z", "")  # the writer ends the line
    docs.select("media_id", body.alias("value")).write.mode("overwrite").partitionBy("media_id").text(path)


def append_logs(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


Muxer = Callable[[str, str, str, str], None]


def tool_muxer(tool: str) -> Muxer:
    """Copies audio and video, adds the subtitles as a track marked with its language."""

    def run(video: str, srt: str, codec: str, out: str) -> None:
        subprocess.run([tool, "-y", "-i", video, "-i", srt, "-c:v", "copy", "-c:a", "copy", "-c:s", codec, "-metadata:s:s:0", "language=rus", out], check=True, capture_output=True)

    return run


def mux(items: DataFrame, muxer: Muxer) -> DataFrame:
    """items: media_id, video, srt, codec, output, srt_output, all paths on a store that executors share. Returns media_id,
    result_path, muxed, error: the muxed file, or a copy of the subtitles where muxing fails; a failed copy is said, too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    muxer(r.video, r.srt, r.codec, r.output)
                    rows.append((r.media_id, r.output, True, None))
                except Exception as e:  # any failure of the tool leads to the plain file
                    error = str(e)
                    try:
                        shutil.copyfile(r.srt, r.srt_output)
                    except OSError as x:
                        error += f"; {x}"
                    rows.append((r.media_id, r.srt_output, False, error))
            yield pd.DataFrame(rows, columns=["media_id", "result_path", "muxed", "error"])

    return items.select("media_id", "video", "srt", "codec", "output", "srt_output").mapInPandas(run, "media_id string, result_path string, muxed boolean, error string")
