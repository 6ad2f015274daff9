"""Seams for models and external tools. Each is a plain function that a worker calls with one batch; stubs are deterministic."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import subprocess
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from weftline.functions.text import PROMPT_INPUT, PROMPT_OUTPUT

#: Fixed value: new tokens that recognition gives for a slice.
ANSWER_TOKENS = 512
TOKEN = r"\w+|[^\w\s]"
_UPPER = {c: c - 32 for c in range(97, 123)}

#: Texts of audio slices (None: not recognised); the factory runs once a worker, where a model is loaded.
Recognizer = Callable[[list[np.ndarray], int], list[str | None]]
#: The answer to one batch's JSON.
Translator = Callable[[str], str]


def extract_audio(videos: DataFrame, tool: str) -> DataFrame:
    """media_id, video (a path) to media_id, content (16 kHz mono WAV bytes), error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                done = subprocess.run([tool, "-y", "-i", r.video, "-vn", "-acodec", "pcm_s16le", "-ar", "16000", "-ac", "1", "-f", "wav", "pipe:1"], capture_output=True)
                rows.append((r.media_id, done.stdout if not done.returncode else None, None if not done.returncode else done.stderr[-500:].decode(errors="replace")))
            yield pd.DataFrame(rows, columns=["media_id", "content", "error"])

    return videos.select("media_id", "video").mapInPandas(run, "media_id string, content binary, error string")


def detect_silence(samples: DataFrame, threshold_db: float = -40.0, least: float = 0.5, rate: int = 16_000) -> DataFrame:
    """A detector without external tools: media_id, samples to (media_id, line_no, line) in the log's format. Silence is a
    stretch of `least` seconds whose amplitude stays below the threshold."""
    limit = 10 ** (threshold_db / 20)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                x = np.abs(np.asarray(r.samples, float)) < limit
                edge = np.flatnonzero(np.diff(np.concatenate(([0], x.view(np.int8), [0]))))
                n = 0
                for a, b in zip(edge[::2], edge[1::2]):
                    if b - a >= least * rate:
                        rows.append((r.media_id, n, f"silence_start: {a / rate:g}"))
                        if b < len(x):
                            rows.append((r.media_id, n + 1, f"silence_end: {b / rate:g} | silence_duration: {(b - a) / rate:g}"))
                        n += 2
            yield pd.DataFrame(rows, columns=["media_id", "line_no", "line"])

    return samples.select("media_id", "samples").mapInPandas(run, "media_id string, line_no int, line string")


def tone_recognizer() -> Recognizer:
    """Stub: names a slice by its length and loudness."""
    return lambda slices, rate: [f"tone {len(x) / rate:.2f}s {np.abs(x).max() if len(x) else 0:.2f}" if len(x) and np.abs(x).max() > 0 else None for x in slices]


def cut_tokens(text: str, most: int) -> str:
    """The text up to the end of its token number `most`."""
    ends = (m.end() for m in re.finditer(TOKEN, text))
    last = next(itertools.islice(ends, most, None), None)
    return text if last is None else text[: next(itertools.islice((m.end() for m in re.finditer(TOKEN, text)), most - 1, None))] if most else ""


def count_tokens(text: str) -> int:
    """A stand-in for a model's own tokenizer: words and signs."""
    return sum(1 for _ in re.finditer(TOKEN, text))


@dataclass(frozen=True)
class Limits:
    """Tokens of the longest prompt that is sent and of the longest answer that is read; how they are counted and cut."""

    prompt: int = 14_000
    answer: int = 4_096
    count: Callable[[str], int] = count_tokens
    cut: Callable[[str, int], str] = cut_tokens


def once(factory: Callable[[], object]) -> Callable[[], object]:
    """A factory that makes its model once a worker process, whatever the number of tasks; an error is remembered, and raised
    again without another try."""
    key = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()
    return lambda: _made(key, factory)


_MODELS: dict[str, tuple[object, Exception | None]] = {}


def _made(key: str, factory: Callable[[], object]) -> object:
    if key not in _MODELS:
        try:
            _MODELS[key] = factory(), None
        except Exception as e:
            _MODELS[key] = None, e
    model, error = _MODELS[key]
    if error is not None:
        raise error
    return model


def recognize(slices: DataFrame, factory: Callable[[], Recognizer], rate: int = 16_000, most_tokens: int = ANSWER_TOKENS) -> DataFrame:
    """media_id, seg_idx, start_sec, end_sec, slice to chunks with text; slices without result go. A batch is one call; a text
    longer than most_tokens is cut there."""
    make = once(factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            texts = model([np.asarray(x, np.float32) for x in pdf["slice"]], rate)
            out = pdf[["media_id", "seg_idx", "start_sec", "end_sec"]].assign(text=[None if t is None else cut_tokens(t, most_tokens) for t in texts])
            yield out[out["text"].notna()]

    return slices.select("media_id", "seg_idx", "start_sec", "end_sec", "slice").mapInPandas(run, "media_id string, seg_idx int, start_sec double, end_sec double, text string")


def batch_of(prompt: str) -> str:
    """The records inside a translation prompt, or all of a text that is none."""
    _, _, inside = prompt.rpartition(PROMPT_INPUT)
    return inside.removesuffix(PROMPT_OUTPUT)


def upper_translator() -> Translator:
    """Stub: the batch's own records with a-z of their texts in upper case."""
    return lambda prompt: json.dumps([r | {"text": r["text"].translate(_UPPER)} for r in json.loads(batch_of(prompt))], ensure_ascii=False)


def careless_translator() -> Translator:
    """Stub: as upper_translator, but the records whose id is divisible by three are left out, the others come in reverse, the
    first of these twice, and one of no row is added."""

    def run(prompt: str) -> str:
        out = [r | {"text": r["text"].translate(_UPPER)} for r in json.loads(batch_of(prompt)) if r["id"] % 3]
        again = [out[0] | {"text": "again"}] if out else []
        stray = {"id": -1, "start_sec": 0.0, "end_sec": 1.0, "text": "stray"}
        return json.dumps([*out[::-1], stray, *again], ensure_ascii=False)

    return run


def ask(batches: DataFrame, factory: Callable[[], Translator], prompt: str = "json", limits: Limits = Limits()) -> DataFrame:
    """Rows of batches, without the column `prompt`, with raw, the translator's answer: one call a row, none for a prompt beyond
    the limit. raw is empty where there is no answer. All other columns pass through as they are."""
    fields = [f for f in batches.schema.fields if f.name != prompt]
    make = once(factory)

    def answer(model: Translator, text: str) -> str:
        try:
            return limits.cut(model(text), limits.answer) if limits.count(text) <= limits.prompt else ""
        except Exception:  # a failed batch falls back to its originals
            return ""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in parts:
            raw = [answer(model, text) for text in b.column(b.schema.get_field_index(prompt)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(f.name)) for f in fields), pa.array(raw, pa.string())], [*(f.name for f in fields), "raw"])

    return batches.mapInArrow(run, StructType([*fields, StructField("raw", StringType())]))
