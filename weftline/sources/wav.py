"""Waveforms: samples, rate and duration from WAV bytes, read by Spark as binary files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: extensions of video files that are taken as input.
VIDEO_GLOB = "*.{mp4,mkv,avi,mov,webm}"


def read_binary(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """media_id (the path), content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("media_id"), "content")


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", VIDEO_GLOB).load(path).select(F.col("path").alias("media_id"), "length", "modificationTime")


def decode(raw: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples in [-1, 1) of 16-bit PCM, of the first channel; a broken file gives none."""
    try:
        with wave.open(io.BytesIO(raw)) as w:
            if w.getsampwidth() != 2:
                return w.getframerate(), np.zeros(0, np.float32)
            x = np.frombuffer(w.readframes(w.getnframes()), "<i2")
            return w.getframerate(), (x[:: w.getnchannels()] / np.float32(32768)).astype(np.float32)
    except (wave.Error, EOFError):
        return 0, np.zeros(0, np.float32)


def samples(content: Column) -> Column:
    """struct(rate, samples) of WAV bytes."""

    @F.pandas_udf("rate int, samples array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = [decode(bytes(b)) for b in s]
            yield pd.DataFrame({"rate": [r for r, _ in got], "samples": [x for _, x in got]})

    return run(content)


def duration(content: Column) -> Column:
    """Seconds, from the header alone and without Python: bytes of the data chunk over bytes a second. For the usual layout
    with the format chunk first."""
    text = F.hex(F.substring(content, 1, 240))  # the header, not the samples
    little = lambda at: F.conv(F.concat(*(F.substring(text, 2 * (at + k) + 1, 2) for k in (3, 2, 1, 0))), 16, 10).cast("double")
    data = F.instr(F.substring(text, 73, 400), "64617461")
    at = 36 + ((data - 1) / 2).cast("int")
    size = F.conv(F.concat(*(F.substr(text, 2 * (at + 4 + k) + 1, F.lit(2)) for k in (3, 2, 1, 0))), 16, 10).cast("double")
    return F.when(data > 0, size / F.nullif(little(28), F.lit(0.0)))


def to_wav(x: np.ndarray, rate: int = 16_000) -> bytes:
    """16-bit mono WAV bytes of samples in [-1, 1)."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 32767 / 32768) * 32768).astype("<i2").tobytes())
    return out.getvalue()
