"""Suffix-array deduplication: every byte covered by a string of `length` bytes that also starts anywhere else goes.

Segments with equal anchors (see repeats) form shards. A shard's distinct segments, each once and parted by separators,
get a suffix array by induced sorting and the permuted common prefixes; a window is repeated if the suffix at its start
shares `length` symbols with a neighbour in the array, or if its segment has several copies.

Defined cases: null text is empty; texts shorter than `length` keep all; a null doc_id comes last where order matters;
rows that repeat a doc_id are documents of their own, so equal ones are repeats of each other; an empty table gives no
rows; texts of any length are judged whole; other columns pass through `deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import BYTE_VALUES, ragged
from weftline.llm.common import pick
from weftline.llm.repeats import Kind, Segment, take_out_repeats
from weftline.llm.suffix_array import permuted_lcp, suffix_array

LENGTH = 200


def _sorted_suffixes(part: Segment, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffix array of the segments with a separator after each, which positions share `window` symbols with their predecessor
    in it, starts of segments, starts of windows and the segment of each."""
    count = len(part.start)
    # Bytes of UTF-8 end at 0xF4: two more symbols fit into eight bits.
    s = np.ones(len(part.symbols) + count + 1, np.uint8 if not len(part.symbols) or part.symbols.max() < 254 else np.uint16)
    s[-1] = 0
    at = part.start + np.arange(count)
    s[ragged(at, part.length)] = part.symbols.astype(s.dtype) + 2
    sa = suffix_array(s)
    shared = permuted_lcp(s, sa, 2 * window)  # beyond a segment's length, so that runs are followed to their end
    return sa, shared >= window, at, ragged(at, part.length - window + 1), np.repeat(np.arange(count), part.length - window + 1)


def repeated_windows(part: Segment, window: int) -> np.ndarray:
    """Starts of windows that occur at another place of the index, or in a segment with copies."""
    sa, hit, _, begins, segment = _sorted_suffixes(part, window)
    hit[sa[:-1][hit[sa[1:]]]] = True
    keep = hit[begins] | (part.copies[segment] > 1)
    return (begins - segment)[keep]


def later_windows(part: Segment, window: int) -> np.ndarray:
    """Starts of windows of which an equal one stands at an earlier place of the index."""
    sa, hit, at, begins, segment = _sorted_suffixes(part, window)
    place = np.full(len(sa), np.iinfo(np.int64).max)
    place[begins] = part.place[segment] + begins - at[segment]
    first = np.flatnonzero(~hit[sa])  # equal windows are neighbours
    least = np.empty(len(sa), np.int64)
    least[sa] = np.repeat(np.minimum.reduceat(place[sa], first), np.diff(np.append(first, len(sa))))
    return (begins - segment)[place[begins] > least[begins]]


def _symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, off


def kept_bytes(rows: pa.Table, sym: np.ndarray, off: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows with n_bytes, n_removed, n_spans and kept (the remaining bytes)."""
    total = np.concatenate(([0], np.cumsum(gone)))
    begin = gone.copy()
    begin[1:] &= ~gone[:-1]
    edges = off[1:-1][off[1:-1] < len(gone)]
    begin[edges] = gone[edges]
    spans = np.concatenate(([0], np.cumsum(begin)))
    left = np.concatenate(([0], np.cumsum(~gone)))[off]
    kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(sym[~gone].tobytes())])
    batch = rows.combine_chunks().to_batches()
    if batch:
        columns = [pa.array(np.diff(x)) for x in (off, total[off], spans[off])]
        yield pa.RecordBatch.from_arrays([*batch[0].columns, *columns, kept.cast(pa.binary())], [*rows.schema.names, "n_bytes", "n_removed", "n_spans", "kept"])


def deduplicate(docs: DataFrame, length: int = LENGTH, first_stays: bool = False) -> DataFrame:
    """docs (unique column names, doc_id and text among them) with n_bytes, n_removed, n_spans and kept. first_stays: of equal
    strings, the first by doc_id (nulls last, then by text) and place is not counted as repeated."""
    gram = max(1, length // 2)  # half a window: only passages that long share an anchor, not every common phrase
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = Kind(length, gram, _symbols, lambda s: BYTE_VALUES[s], later_windows if first_stays else repeated_windows, first_stays, kept_bytes, fields + ", n_bytes long, n_removed long, n_spans long, kept binary")
    return take_out_repeats(docs, kind)


def deduplicate_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = deduplicate(pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text"), length)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated_texts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeats taken out of text, all but the first of each (n_chars, if there, follows); a text that nothing is left of
    goes with its row. Removal is by bytes; a character that it cuts in two goes whole."""
    fields = docs.schema.fields
    found = deduplicate(docs, length, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, gone = b.column(b.schema.get_field_index("kept")).to_pylist(), b.column(b.schema.get_field_index("n_removed")).to_numpy()
            before = b.column(b.schema.get_field_index("text"))
            texts = [t if not g else k.decode("utf-8", "ignore") for t, k, g in zip(before.to_pylist(), kept, gone)]
            stay = pa.array([not g or bool(t.strip()) for t, g in zip(texts, gone)])
            columns = []
            for f in fields:
                held = b.column(b.schema.get_field_index(f.name))
                if f.name == "text":
                    held = pa.array(texts, before.type)
                elif f.name == "n_chars":
                    sizes = pa.array([None if t is None else len(t) for t in texts], held.type)
                    held = pa.compute.if_else(pa.array(gone > 0), sizes, held)
                columns.append(held)
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields]).filter(stay)

    return found.mapInArrow(run, docs.schema)
