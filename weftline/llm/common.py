"""What the training-data operators share: tables on the shared folder, column safety, partition counts."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of bytes outside space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Input bytes (as Spark estimates them) that one shuffle partition should hold at most.
BYTES_PER_PARTITION = 32 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Where neither is set and
    all runs in one process (a local master, as in tests), a new local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*frames: DataFrame) -> None:
    """Delete stored tables (others are left alone) that nothing will read again: what was made of them is stored, too."""
    for df in frames:
        if hasattr(df, "stored_path"):
            delete(df.sparkSession, df.stored_path)


def release(spark: SparkSession) -> None:
    """Let go of what no DataFrame holds any more: Spark deletes shuffle files when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(df: DataFrame) -> int:
    """Shuffle partitions for work on df: the session's setting, more where the input's estimated size asks for it."""
    held = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    try:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # an estimate only
        size = 0
    return max(held, min(size // BYTES_PER_PARTITION, 1 << 20))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; a name that occurs several times (or in another case) gives its first exact match."""
    have = df.columns
    if len(set(map(str.lower, have))) == len(have):
        return df.select(*(F.col(f"`{n}`") for n in names))
    marked = df.toDF(*(f"c{i}" for i in range(len(have))))
    return marked.select(*(F.col(f"c{have.index(n)}").alias(n) for n in names))


def word_count(text: Column) -> Column:
    """Words of a text, null: 0. Built in, so it stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
