"""Band log-energies of audio segments: framed, Hamming-windowed spectra summed into linear bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bands, frame size, hop, most frames of a segment, sampling rate.
BANDS, FRAME, HOP, MOST_FRAMES, RATE = 13, 256, 128, 100, 16_000


def band_log_energy(samples: np.ndarray, bands: int = BANDS, size: int = FRAME, hop: int = HOP, most: int = MOST_FRAMES) -> np.ndarray:
    """ln(mean over frames of the band's summed magnitudes + 1e-10); zeros if there is no frame. The last full frame
    is not used."""
    count = min((len(samples) - size) // hop, most) if len(samples) >= size else 0
    if count <= 0:
        return np.zeros(bands)
    at = np.arange(count)[:, None] * hop + np.arange(size)
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(size) / size)
    spectrum = np.abs(np.fft.rfft(samples[at] * window, axis=1)).sum(axis=0)
    band = (np.arange(len(spectrum)) / len(spectrum) * bands).astype(int)
    return np.log(np.bincount(band, spectrum, bands) / count + 1e-10)


def energies(samples: Column, **sizes: int) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([band_log_energy(np.asarray(x, float), **sizes) for x in s])

    return run(samples)


def segment_features(audio: DataFrame, segments: DataFrame) -> DataFrame:
    """audio (media_id, samples array<float>, one row an item), segments (media_id, seg_idx, start_sec, end_sec) to
    (media_id, seg_idx, vec). Each segment's slice, at most the frames used, is cut in the JVM, so that Python sees no more."""
    x = segments.join(audio, "media_id")
    start = F.greatest((F.col("start_sec") * RATE).cast("int"), F.lit(0))
    end = F.least((F.col("end_sec") * RATE).cast("int"), F.size("samples"))
    need = FRAME + HOP * (MOST_FRAMES + 1)
    cut = F.slice("samples", start + 1, F.greatest(F.least(end - start, F.lit(need)), F.lit(0)))
    return x.select("media_id", "seg_idx", energies(cut).alias("vec"))
