"""Order-dependent leader clustering and labels by first appearance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: cosine distance below which a vector joins a cluster.
THRESHOLD = 1.2


def leaders(vectors: np.ndarray, threshold: float, least_norm: float = 1e-10) -> np.ndarray:
    """Cluster of each vector in order: the nearest first member closer than the threshold, the first of ties, or a new
    cluster. A zero vector is at distance 2 from all."""
    held = np.empty_like(vectors)
    norms = np.empty(len(vectors))
    out = np.empty(len(vectors), np.int64)
    n = 0
    for i, v in enumerate(vectors):
        norm = np.sqrt(v @ v)
        d = np.full(n, 2.0)
        product = norms[:n] * norm
        ok = product >= least_norm
        d[ok] = 1 - (held[:n][ok] @ v) / product[ok]
        best = int(d.argmin()) if n else -1
        if n and d[best] < threshold:
            out[i] = best
        else:
            held[n], norms[n], out[i] = v, norm, n
            n += 1
    return out


def leader_clusters(features: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """media_id, seg_idx, cluster. Sequential inside an item, parallel across items; a step costs its item's clusters."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg_idx", kind="stable")
        pdf["cluster"] = leaders(np.array(pdf["vec"].tolist(), float).reshape(len(pdf), -1), threshold)
        return pdf[["media_id", "seg_idx", "cluster"]]

    kinds = dict(features.dtypes)
    return features.select("media_id", "seg_idx", "vec").groupBy("media_id").applyInPandas(run, f"media_id {kinds['media_id']}, seg_idx {kinds['seg_idx']}, cluster long")


def speaker_labels(clusters: DataFrame) -> DataFrame:
    """speaker_id = Speaker_<n>, n by the clusters' first appearance in the item."""
    first = F.min("seg_idx").over(Window.partitionBy("media_id", "cluster"))
    number = F.dense_rank().over(Window.partitionBy("media_id").orderBy("_first"))
    return clusters.withColumn("_first", first).withColumn("speaker_id", F.concat(F.lit("Speaker_"), number.cast("string"))).drop("_first")


def speaker_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("media_id").agg(F.count_distinct("speaker_id").alias("n_speakers"), F.count(F.lit(1)).alias("n_segments"))
