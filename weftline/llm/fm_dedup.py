"""Substring deduplication by words: all but the first of equal runs of `length` words go.

Segments with equal anchors (see repeats) form shards. A shard's distinct segments, each once and parted by separators,
get a compressed FM-index; the segments stream through it, and backward search gives each window's interval. The
windows of an interval are the places of one word sequence: the first, by document and position, stays, and the others
are covered, as are all further copies of a segment.

Defined cases: null text has no words; fewer words than `length` keep all; a null doc_id comes last; rows that repeat a
doc_id count one after the other, by their text, so of equal rows one stays; an empty table gives no rows; texts of any
length are judged whole; other columns pass through `deduplicate_words`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import U64, ragged, slices, word_hashes, words
from weftline.llm.common import pick
from weftline.llm.fm_index import FMIndex
from weftline.llm.repeats import Kind, Segment, take_out_repeats

LENGTH = 20
#: Windows searched at once.
SEARCHED = 1 << 19


def later_windows(part: Segment, window: int) -> np.ndarray:
    """Starts of windows of which an equal one stands at an earlier place of the index."""
    count = len(part.start)
    used, ids = np.unique(part.symbols, return_inverse=True)
    s = np.ones(len(part.symbols) + count + 1, np.int64)
    s[-1] = 0
    at = part.start + np.arange(count)
    s[ragged(at, part.length)] = ids + 2
    index = FMIndex(s, len(used) + 2, window)
    begins = ragged(at, part.length - window + 1)
    segment = np.repeat(np.arange(count), part.length - window + 1)
    # Equal windows have one interval, different ones have disjoint intervals; each window of the index is searched, so the first
    # place of a sequence is found among those with its interval, without locating suffixes.
    found = [(i + who, lo) for i in range(0, len(begins), SEARCHED) for who, lo, _ in [index.matches(s, begins[i : i + SEARCHED], window)]]
    who, lo = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    place = part.place[segment[who]] + begins[who] - at[segment[who]]
    order = np.lexsort((place, lo))
    first = np.ones(len(order), bool)
    first[1:] = lo[order][1:] != lo[order][:-1]
    late = np.sort(who[order][place[order] > np.repeat(place[order][first], np.diff(np.append(np.flatnonzero(first), len(order))))])
    return begins[late] - segment[late]


def _symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as 48-bit hashes."""
    starts, ends, first = words(data, off)
    return word_hashes(data, starts, ends) >> U64(16) if len(starts) else np.zeros(0, U64), first


def kept_words(rows: pa.Table, sym: np.ndarray, off: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows with n_words, n_removed and kept (the remaining words, one blank between)."""
    at = 0
    for part, data, o in slices(iter(rows.combine_chunks().to_batches())):
        starts, ends, first = words(data, o)
        out = gone[at : at + len(starts)]
        at += len(starts)
        total = np.concatenate(([0], np.cumsum(out)))
        stay = np.flatnonzero(~out)
        size = ends[stay] - starts[stay] + 1
        held = np.concatenate((data, np.array([32], np.uint8)))
        take = ragged(starts[stay], size)
        last = np.cumsum(size) - 1
        raw = held[np.minimum(take, len(data))]
        raw[last] = 32
        left = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(~out)))[first]]
        drop = left[1:][np.diff(left) > 0] - 1  # the blank after a text's last word
        keep = np.ones(len(raw), bool)
        keep[drop] = False
        left = left - np.concatenate(([0], np.cumsum(np.diff(left) > 0)))
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(o) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(raw[keep].tobytes())])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(first)), pa.array(np.diff(total[first])), kept.cast(pa.binary())], [*part.schema.names, "n_words", "n_removed", "kept"])


def deduplicate_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (unique column names, doc_id and text among them) with n_words, n_removed and kept."""
    gram = max(1, length // 2)  # half a window: only passages that long share an anchor, not every common phrase
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = Kind(length, gram, _symbols, lambda s: s, later_windows, True, kept_words, fields + ", n_words long, n_removed long, kept binary")
    return take_out_repeats(docs, kind)


def deduplicate_documents_by_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    found = deduplicate_words(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), length)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
