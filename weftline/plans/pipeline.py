"""From audio to subtitles, many items at a time: detect, recognise, tell speakers apart, translate, render.

Stages are functions of DataFrames keyed by media_id; the segments feed two branches (text, speakers) that Spark may run at
once. An item's failure is a row of the status table, not a failed job.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import between_tags, bracketed, is_blank, translation_prompt
from weftline.model import ANSWER_JSON
from weftline.operators.batches import batch_json, micro_batches, srt_documents
from weftline.operators.clustering import THRESHOLD, leader_clusters, speaker_labels
from weftline.operators.intervals import to_samples, voice_segments
from weftline.operators.joins import band_join, zip_positions
from weftline.operators.json_records import parse_records
from weftline.operators.signal import segment_features
from weftline.plans.adapters import Limits, Recognizer, Translator, ask, detect_silence, recognize
from weftline.sources.config import AppConfig, missing_settings
from weftline.sources.wav import samples

log = logging.getLogger(__name__)

#: Progress of each stage in percent.
PROGRESS = {"extract": 5, "vad": 15, "stt": 30, "diarize": 50, "translate": 70, "mux": 90, "done": 100}
#: Start tolerance of the speaker join in seconds, label of a chunk without a speaker.
TOLERANCE, UNKNOWN = 0.5, "S?"


def load_audio(files: DataFrame, rate: int = 16_000) -> DataFrame:
    """media_id, content to media_id, samples, n_samples, total (seconds)."""
    x = files.withColumn("s", samples(F.col("content")))
    return x.select("media_id", "s.samples", F.size("s.samples").cast("long").alias("n_samples"), (F.size("s.samples") / F.coalesce(F.nullif(F.col("s.rate"), F.lit(0)), F.lit(rate))).alias("total"))


def require(x: DataFrame, what: str, *columns: str) -> DataFrame:
    """x, or an error that names what a stage lacks, before anything runs."""
    lacking = [c for c in columns if c not in x.columns]
    if lacking:
        raise ValueError(f"{what} lack the column {', '.join(lacking)}")
    return x


def detect(audio: DataFrame, threshold_db: float = -40.0) -> DataFrame:
    require(audio, "audio", "media_id", "samples", "total")
    return voice_segments(audio.select("media_id", "total"), detect_silence(audio, threshold_db))


def transcribe(audio: DataFrame, segments: DataFrame, factory: Callable[[], Recognizer]) -> DataFrame:
    """Chunks with cleaned, non-blank text; speaker_id null."""
    require(audio, "audio", "media_id", "samples", "n_samples")
    require(segments, "segments", "media_id", "seg_idx", "start_sec", "end_sec")
    cut = to_samples(segments.join(audio.select("media_id", "samples", "n_samples"), "media_id"))
    cut = cut.withColumn("slice", F.slice("samples", (F.col("start_sample") + 1).cast("int"), (F.col("end_sample") - F.col("start_sample")).cast("int")))
    got = recognize(cut, factory).withColumn("text", between_tags(F.col("text"), "asr_text"))
    return got.filter(~is_blank(F.col("text"))).withColumn("speaker_id", F.lit(None).cast("string"))


def diarize(audio: DataFrame, segments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Segments with speaker_id; an item with one segment has one speaker."""
    require(segments, "segments", "media_id", "seg_idx", "start_sec", "end_sec")
    labels = speaker_labels(leader_clusters(segment_features(audio.select("media_id", "samples"), segments), threshold))
    return zip_positions(segments, labels.select("media_id", "seg_idx", "speaker_id"))


def translate(chunks: DataFrame, speakers: DataFrame, factory: Callable[[], Translator] | None, rows: int = 10, limits: Limits = Limits()) -> DataFrame:
    """Chunks with translated text and the speaker. Each batch is one prompt and one call. A record of the answer belongs to the row
    whose id it carries, without an id to the row of its start; the first of several counts. A row without a record, and any of
    a prompt too long to send, keeps its text in brackets; blank ones go. n_asked, n_answered and n_matched count a
    batch's rows, the answer's records and the rows that found one. Without a translator all passes through."""
    require(chunks, "chunks", "media_id", "seg_idx", "start_sec", "end_sec", "text")
    require(speakers, "speakers", "media_id", "seg_idx", "start_sec", "speaker_id")
    x = chunks.withColumn("chunk_id", F.struct("media_id", "seg_idx"))
    who = band_join(x, speakers.withColumnRenamed("speaker_id", "speaker"), "chunk_id", ["media_id"], "start_sec", "start_sec", TOLERANCE, "seg_idx", "speaker", UNKNOWN)
    x = micro_batches(x.join(who, "chunk_id").drop("chunk_id"), ["media_id"], ["seg_idx"], rows)
    if factory is None:
        return x.withColumns({"translated": F.lit(False), **{c: F.lit(0).cast("long") for c in ("n_asked", "n_answered", "n_matched")}})
    columns = [c for c in x.columns if c not in ("media_id", "batch_id")]
    asked = batch_json(x, ["media_id"], "seg_idx", "speaker").withColumnRenamed("n", "n_asked")
    raw = ask(asked.withColumn("json", translation_prompt(F.col("json"))), factory, limits=limits)
    got = raw.withColumn("records", F.coalesce(parse_records(F.col("raw"), ANSWER_JSON), F.array())).drop("raw")

    def answer(row: Column) -> Column:
        own = F.filter("records", lambda r: F.coalesce(r["id"] == row["seg_idx"], r["start_sec"] == row["start_sec"]))
        return F.struct(row.alias("row"), F.get(own, F.lit(0)).alias("new"))

    got = got.withColumn("pairs", F.transform("rows", answer)).drop("rows")
    got = got.select("media_id", "batch_id", "n_asked", F.size("records").cast("long").alias("n_answered"), F.size(F.filter("pairs", lambda p: p["new"].isNotNull())).cast("long").alias("n_matched"), F.explode("pairs").alias("p"))
    new = F.col("p.new").isNotNull()
    out = got.filter(new | ~is_blank(F.col("p.row.text"))).withColumns({
        "translated": new, "new_text": F.coalesce("p.new.text", bracketed(F.col("p.row.text"))), "new_speaker": F.when(new, F.coalesce("p.new.speaker_id", "p.row.speaker")),
    })
    said = {"text": F.col("new_text").alias("text"), "speaker_id": F.col("new_speaker").alias("speaker_id")}
    return out.select("media_id", "batch_id", *(said.get(c, F.col(f"p.row.{c}")) for c in columns), "translated", "n_asked", "n_answered", "n_matched")


def status(audio: DataFrame, chunks: DataFrame) -> DataFrame:
    """media_id, stage, percent, n_chunks, error: items without any recognised chunk are errors."""
    n = chunks.groupBy("media_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    x = audio.select("media_id").join(n, "media_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0).cast("long")))
    ok = F.col("n_chunks") > 0
    return x.select("media_id", F.when(ok, "done").otherwise("error").alias("stage"), F.when(ok, PROGRESS["done"]).otherwise(PROGRESS["stt"]).alias("percent"), "n_chunks", F.when(~ok, "nothing was recognised").alias("error"))


def stored_under(path: str) -> Callable[[DataFrame, str], DataFrame]:
    """Writes a stage's table as Parquet below path and gives it back as read from there."""

    def store(x: DataFrame, name: str) -> DataFrame:
        x.write.mode("overwrite").parquet(f"{path}/{name}")
        return x.sparkSession.read.schema(x.schema).parquet(f"{path}/{name}")

    return store


def run(files: DataFrame, recognizer: Callable[[], Recognizer], translator: Callable[[], Translator] | None = None, threshold_db: float = -40.0, on_progress: Callable[[str, int, float], None] | None = None, store: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """files (media_id, content) to tables: segments, chunks, speakers, translated, srt, status.

    With store (see stored_under) each stage runs when its turn comes, once, and on_progress then gets its name, percent and
    seconds; later stages read what was stored. Without, the tables are lazy, and on_progress tells of their planning only.
    """
    require(files, "files", "media_id", "content")
    out: dict[str, DataFrame] = {}

    def stage(name: str, key: str, make: Callable[[], DataFrame]) -> None:
        began = time.perf_counter()
        out[key] = store(make(), key) if store else make()
        if on_progress:
            on_progress(name, PROGRESS[name], time.perf_counter() - began)

    stage("extract", "audio", lambda: load_audio(files))
    stage("vad", "segments", lambda: detect(out["audio"], threshold_db))
    stage("stt", "chunks", lambda: transcribe(out["audio"], out["segments"], recognizer))
    stage("diarize", "speakers", lambda: diarize(out["audio"], out["segments"]))
    stage("translate", "translated", lambda: translate(out["chunks"], out["speakers"], translator))
    stage("mux", "srt", lambda: srt_documents(require(out["translated"], "translated chunks", "seg_idx", "text", "speaker_id")))
    out["status"] = status(out["audio"], out["chunks"])
    return out


class Runs:
    """One run at a time: what an application asks of it."""

    def __init__(self) -> None:
        self._one = threading.Lock()

    def busy(self) -> bool:
        return self._one.locked()

    def process(self, files: DataFrame, recognizer: Callable[[], Recognizer], translator: Callable[[], Translator] | None = None, **how) -> dict[str, DataFrame]:  # noqa: ANN003
        """run(), unless another one is under way."""
        if not self._one.acquire(blocking=False):
            raise RuntimeError("another run is under way")
        try:
            return run(files, recognizer, translator, **how)
        finally:
            self._one.release()


def unattended(environ: Mapping[str, str], config: AppConfig, process: Callable[[str, AppConfig], str], tell: Callable[[str, int, str | None], None], variable: str = "WEFTLINE_INPUT") -> bool:
    """A run that the environment asks for: `variable` names the input. Nothing happens without it, or where the configuration
    lacks what a run needs. process does the work and returns the result's path; tell gets started, then done or error."""
    path = environ.get(variable)
    if not path:
        return False
    lacking = missing_settings(config, path)
    if lacking:
        log.info("no unattended run: %s not set", ", ".join(lacking))
        return False
    tell("started", 0, None)
    try:
        result = process(path, config)
    except Exception:  # told, logged, and left to whoever listens
        log.exception("unattended run of %s failed", path)
        tell("error", 0, None)
        return False
    tell("done", PROGRESS["done"], result)
    return True
