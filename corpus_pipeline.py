"""A corpus pipeline of five stages: language, near duplicates, repeated passages, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads
it back as the next stage's docs. All stages but the last return the columns of documents.

Defined cases, for every stage: columns beside those of documents are not read, whatever their names, in any case of
letters; texts of any length are handled whole; an empty table gives an empty table with the stage's columns. What nulls, empty
texts and repeated rows come to is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import documents, pick, stored
from weftline.llm.language import identify, train_identifier
from weftline.llm.mixing import mixed_rows
from weftline.llm.near_dedup import survivors
from weftline.llm.packing import pack_documents
from weftline.llm.suffix_dedup import deduplicated_texts

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier, fitted on their own labels, does not reject. Null texts and texts without a letter
    go, unless no labelled text has one: then nothing can be judged, and all stay. Null languages teach nothing; repeated rows
    are judged alike; null doc_ids, sources and n_chars pass."""
    docs = pick(docs, *COLUMNS)
    who = train_identifier(docs.select("doc_id", "text", "lang"))
    return identify(docs, who).filter(~F.col("rejected")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by five-word shingles at similarity 0.8: that of least doc_id, nulls last, then of least
    text hash. Rows are judged by their texts: null and repeated doc_ids link nothing and keep nothing. Texts without a word
    are linked with nothing. Rows that repeat both doc_id and text count as one document."""
    docs = pick(docs, *COLUMNS).withColumn("_hash", F.xxhash64("text"))
    kept = survivors(docs, words_per_shingle=5, percent=80).select(F.col("doc_id").alias("kept_id"), "text_hash")
    left = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("_hash") == F.col("text_hash")), "left_semi")
    same = Window.partitionBy("doc_id", "_hash").orderBy("source", "lang")
    return left.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") == 1).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes and more that stand in an earlier place too: of each the first copy stays, by doc_id
    (nulls last), then by text. Texts of which nothing but white space is left go; untouched ones stay as they are, null and
    empty ones too. n_chars, where not null, follows a changed text. Of repeated rows the first keeps its text."""
    return deduplicated_texts(pick(docs, *COLUMNS), 200).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated as their source's target asks. Null is a source of its own; texts without words (null ones too)
    have size 0 and go as their source's copies say; repeated rows are rows of their own."""
    return mixed_rows(pick(docs, *COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 2048 tokens, as op10's: null and empty texts are an end token, repeated rows
    and null doc_ids are packed each."""
    return pack_documents(pick(docs, *COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: Models, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
