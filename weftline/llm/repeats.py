"""Repeated windows across a corpus: what both substring operators share.

A window is a fixed number of symbols (bytes or words) of one document. Two equal windows have the same anchor: the
least hash among the short grams inside. The windows of a document that share an anchor form a segment, and only
segments with equal anchors can hold equal windows, so segments are dealt into shards by anchor:

  1. blocks of documents are written once; for each distinct segment of a block its anchor's and its content's hash go
     to the anchor's shard;
  2. shards tell blocks which of their anchors occur anywhere else, and which block is to provide a segment's content;
  3. blocks send those segments; each content travels once, copies only as their place;
  4. a shard's index answers which windows are repeated (see Solver); equal segments, of which all windows are repeated,
     count as copies there;
  5. blocks mark what the answers cover and take it out.

An anchor whose segments are all equal needs no index: its windows differ from each other and from all others, so its
segments are copies and no more. Their content is not sent; what the index holds are anchors of unlike segments.

An anchor with so many distinct segments that they fill an index is hot: blocks cut its segments into their windows and
deal those by their own 64-bit hashes, so that only equal windows meet and no index holds more than two times INDEX_SYMBOLS.

A document that holds a third of the corpus's passages sends one record a distinct segment and block; no task sees the
members of a hot passage but as one record a block, and rows never multiply by pairs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import SLICE_BYTES, U64, Lanes, mix64, powers, ragged, running, slices, stretch
from weftline.llm.common import partitions, release, shared_dir, stored
from weftline.llm.exchange import ROWS, deal, differences, from_bytes, groups, pack, packed_rows, range_bucket, runs, to_bytes, unpack

BLOCK_BYTES = 4 << 20
#: Symbols of one index; a shard's anchors are divided among as many indexes as that takes. An anchor that may have more is hot.
INDEX_SYMBOLS = 1 << 20
#: In answers: the whole segment is covered.
ALL = np.uint32(0xFFFFFFFF)
BLOCKS, PLACES, ASKED, WANTED, SENT, ANSWERS, ALONE = range(7)
#: In step 2, beside 0 and 1 for contents to be provided: the segment's windows are to be sent one by one; all segments of the
#: anchor are equal.
HOT, EQUAL = 2, 3

Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def find_segments(sums: np.ndarray, lanes: Lanes, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts given by their symbols' running sums and lanes: document, start, length, anchor's hash, content's hash."""
    n, span = len(sums) - 1, window - gram + 1
    sizes = np.diff(off)
    count = np.maximum(sizes - window + 1, 0)
    if not count.sum():
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(U64), z.view(U64)
    head, places = n - gram + 1, n - window + 1
    # The least gram of each run of span grams, the last of equals: hash above, position below.
    key = sums[gram:] - sums[:head]
    key *= powers(n + 1)[1][:head]
    key = mix64(key)
    key &= U64(0xFFFFFFFF00000000)
    key |= np.arange(0xFFFFFFFF, 0xFFFFFFFF - head, -1).view(U64)
    table = np.concatenate((key, np.full(-head % span, ~U64(0)))).reshape(-1, span)
    before = np.minimum.accumulate(table, axis=1).reshape(-1)
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(after[:places], before[span - 1 : span - 1 + places])
    # Runs of one anchor, cut where windows of a text begin and where they would leave it.
    new = np.ones(places, bool)
    np.not_equal(low[1:], low[:-1], out=new[1:])
    edges = np.concatenate((off[:-1], off[:-1] + count))
    new[edges[edges < places]] = True
    at = np.flatnonzero(new)
    last = np.append(at[1:], places) - 1
    doc = np.searchsorted(off, at, "right") - 1
    inside = at < off[doc] + count[doc]
    doc, begin, last = doc[inside], at[inside], last[inside]
    a = (U64(0xFFFFFFFF) - (low[begin] & U64(0xFFFFFFFF))).astype(np.int64)
    size = last + window - begin
    return doc, begin, size, *_segment_keys(sums, lanes, begin, size, a, gram)


def _segment_keys(sums: np.ndarray, lanes: Lanes, begin: np.ndarray, size: np.ndarray, at: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """48 bits each of segments' anchors and contents. Anchors are least hashes, so they are hashed anew to spread over the
    shards' ranges, and unlike ones of one hash only meet; contents are content hashes, compared under equal anchors."""
    anchor = mix64(stretch(sums, at, at + gram) ^ U64(0x8EBC6AF09C88C6E3)) >> U64(16)
    content = mix64(lanes.of(begin, begin + size) ^ mix64((at - begin).astype(U64) + size.astype(U64) * U64(1 << 32))) >> U64(16)
    return anchor, content


@dataclass
class Segment:
    """Distinct segments of a shard's index, content provided: symbols from start[i] on, length[i] of them."""

    symbols: np.ndarray
    start: np.ndarray
    length: np.ndarray
    copies: np.ndarray
    place: np.ndarray


#: Given distinct segments, the starts of windows (as symbol positions) to be covered in the segment's first place.
Solver = Callable[[Segment, int], np.ndarray]


@dataclass
class Kind:
    """What the two operators differ in.

    symbols: bytes and offsets to symbols (as stored) and offsets; values: their mixed hashes. first_stays: only copies
    after the first place, by document, are covered; else all are.
    """

    window: int
    gram: int
    symbols: Symbols
    values: Callable[[np.ndarray], np.ndarray]
    solve: Solver
    first_stays: bool
    result: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch]
    fields: str


def _names(rows: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    """What orders documents first: ids, and which are null (those come last)."""
    column = rows.column(rows.schema.get_field_index(key))
    return column.fill_null(0).to_numpy(), column.is_null().to_numpy(zero_copy_only=False)


def _ties(sums: np.ndarray, off: np.ndarray) -> np.ndarray:
    """What orders documents of one id: a hash of the text."""
    return (stretch(sums, off[:-1], off[1:]) >> U64(32)).astype(np.uint32)


def _write_blocks(docs: DataFrame, kind: Kind, n: int, key: str, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = symbols = docs_so_far = 0

        def flush() -> pa.RecordBatch:
            block = uuid.uuid4().int >> 65
            batch = pa.Table.from_batches([h[0] for h in held]).combine_chunks().to_batches()
            doc, start, length, anchor, content, ids, null, tie = (np.concatenate([h[i] for h in held]) for i in range(1, 9))
            out = [(BLOCKS, block % n, block, to_bytes(batch[0]))] if batch else []
            if len(doc):
                order = np.lexsort((start, tie[doc], ids[doc], null[doc], content, anchor))
                a, c = anchor[order], content[order]
                at = groups(a, c)
                which = np.empty(len(order), np.int64)
                times = np.diff(np.append(at, len(order)))
                which[order] = np.repeat(np.arange(len(at)), times)
                first = np.zeros(len(order), np.uint8)
                first[order[at]] = 1
                out.append((PLACES, block % n, block, pack(np.diff(start, prepend=0).astype(np.int32), length.astype(np.uint32), which.astype(np.uint32), first, doc.astype(np.uint32))))
                a, c = a[at], c[at]
                out += [(ASKED, k, block, pack(np.array([i]), differences(a[i:j]), c[i:j], (times[i:j] > 1).astype(np.uint8))) for k, i, j in runs(range_bucket(a, n))]
            return packed_rows(out)

        for rows, data, off in slices(batches, text):
            sym, at = kind.symbols(data, off)
            sums = running(kind.values(sym))
            doc, start, length, anchor, content = find_segments(sums, Lanes(sym), at, kind.window, kind.gram)
            held.append((rows, doc + docs_so_far, start + symbols, length, anchor, content, *_names(rows, key), _ties(sums, at)))
            size, symbols, docs_so_far = size + len(data), symbols + int(at[-1]), docs_so_far + rows.num_rows
            if size >= BLOCK_BYTES:
                yield flush()
                held, size, symbols, docs_so_far = [], 0, 0, 0
        if held:
            yield flush()

    return docs.mapInArrow(run, ROWS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Buffer]]:
    for b in batches:
        for kind, block, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
            yield kind, block, raw.as_buffer()


def _want(n: int, most: int):  # noqa: ANN202
    """Step 2: of a shard's anchors, those that occur more than once; the first block that has a content provides it, unless all of
    the anchor's are equal. Anchors of more than `most` distinct segments are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(block, unpack(raw)) for _, block, raw in _read(batches)]
        if not got:
            return
        blocks = np.array([b for b, _ in got])
        sizes = [len(x[1]) for _, x in got]
        source = np.repeat(np.arange(len(got)), sizes)
        index = np.concatenate([x[0][0] + np.arange(s) for (_, x), s in zip(got, sizes)])
        anchor = np.concatenate([np.cumsum(x[1], dtype=U64) for _, x in got])
        content, many = (np.concatenate([x[i] for _, x in got]) for i in (2, 3))
        order = np.lexsort((blocks[source], content, anchor))
        source, index, anchor, content, many = source[order], index[order], anchor[order], content[order], many[order]
        at = groups(anchor)
        times = np.add.reduceat(1 + many.astype(np.int64), at)
        size = np.diff(np.append(at, len(anchor)))
        keep = np.repeat(times > 1, size)
        provide = np.zeros(len(anchor), np.uint8)
        provide[groups(anchor, content)] = 1
        distinct = np.add.reduceat(provide, at, dtype=np.int64)
        provide[np.repeat(distinct == 1, size)] = EQUAL
        provide[np.repeat(distinct > most, size)] = HOT
        source, index, provide = source[keep], index[keep], provide[keep]
        order = np.lexsort((index, source))
        source, index, provide = source[order], index[order], provide[order]
        cut = np.searchsorted(source, np.arange(len(got) + 1))
        yield packed_rows([(WANTED, int(blocks[k] % n), int(blocks[k]), pack(index[i:j], provide[i:j])) for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if j > i])

    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    held: dict[int, dict[int, list]] = {}
    for kind, block, raw in _read(batches):
        held.setdefault(block, {}).setdefault(kind, []).append(raw)
    while held:
        yield held.popitem()


def _block_symbols(rows: pa.Table, kind: Kind, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of a block, and offsets of its documents."""
    sym, off, base = [], [np.zeros(1, np.int64)], 0
    for _, data, o in slices(iter(rows.combine_chunks().to_batches()), text):
        s, at = kind.symbols(data, o)
        sym.append(s), off.append(at[1:] + base)
        base += int(at[-1])
    return np.concatenate(sym) if sym else np.zeros(0, np.uint8), np.concatenate(off)


def _send(kind: Kind, n: int, key: str, text: str):  # noqa: ANN202
    """Step 3: wanted segments with their first place in the block, and the contents this block provides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _by_block(batches):
            if WANTED not in held:
                continue
            wanted = [unpack(raw) for raw in held[WANTED]]
            index, provide = (np.concatenate([w[i] for w in wanted]) for i in (0, 1))
            order = np.argsort(index)
            index, provide = index[order], provide[order]
            out = []
            if not kind.first_stays:  # else the first place is still to be found
                equal = index[provide == EQUAL]
                if len(equal):
                    none = np.zeros(0, np.uint32)
                    out.append((ANSWERS, block % n, block, pack(equal, np.full(len(equal), ALL), none, none)))
                index, provide = index[provide != EQUAL], provide[provide != EQUAL]
                if not len(index):
                    yield packed_rows(out)
                    continue
            step, length, which, first, doc = unpack(held[PLACES][0])
            start = np.cumsum(step, dtype=np.int64)
            rows = from_bytes(held[BLOCKS][0])
            sym, off = _block_symbols(rows, kind, text)
            times = np.bincount(which)
            one = np.flatnonzero(first)
            place = np.empty(len(times), np.int64)
            place[which[one]] = one
            place = place[index]
            s, size, d = start[place], length[place].astype(np.int64), doc[place].astype(np.int64)
            # The hashes again, of these segments only, some documents at a time.
            tie = np.zeros(len(off) - 1, np.uint32)
            anchor, content = np.zeros(len(s), U64), np.zeros(len(s), U64)
            is_hot = provide == HOT
            alone: list[tuple[np.ndarray, ...]] = []
            for lo, hi in _lots(off):
                first_at, part = off[lo], sym[off[lo] : off[hi]]
                mine = np.flatnonzero((s >= first_at) & (s < off[hi]))
                sums = running(kind.values(part))
                tie[lo:hi] = _ties(sums, off[lo : hi + 1] - first_at)
                lanes = Lanes(part)
                hot, cold = mine[is_hot[mine]], mine[~is_hot[mine]]
                anchor[cold], content[cold] = _again(sums, lanes, s[cold] - first_at, size[cold], kind)
                alone.append(_windows(kind, lanes, hot, s[hot] - first_at, size[hot]))
                del sums, lanes
            ids, null = _names(rows.combine_chunks().to_batches()[0], key)
            out += _send_windows(kind, n, block, alone, index, s, np.minimum(times[index], 2), ids[d], null[d], tie[d], off[d])
            cold = ~is_hot
            index, provide, s, size, d, anchor, content = (x[cold] for x in (index, provide, s, size, d, anchor, content))
            provide = provide == 1
            where = range_bucket(anchor, n)
            order = np.argsort(where, kind="stable")
            for k, i, j in runs(where[order]):
                mine = order[i:j]
                give = mine[provide[mine]]
                out.append((SENT, k, block, pack(index[mine], anchor[mine], content[mine], np.minimum(times[index[mine]], 2).astype(np.uint8), provide[mine].astype(np.uint8), ids[d[mine]], null[d[mine]].astype(np.uint8), tie[d[mine]], s[mine] - off[d[mine]], size[give].astype(np.uint32), *_coded(sym[ragged(s[give], size[give])]))))
            yield packed_rows(out)

    return run


def _lots(off: np.ndarray) -> list[tuple[int, int]]:
    """Runs of documents of about SLICE_BYTES symbols, a longer document alone."""
    out, at = [], 0
    while at < len(off) - 1:
        to = max(int(np.searchsorted(off, off[at] + SLICE_BYTES, "right")) - 1, at + 1)
        out.append((at, to))
        at = to
    return out


def _windows(kind: Kind, lanes: Lanes, which: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows of segments of hot anchors: the segment, the window's place in it and its own hash."""
    count = size - kind.window + 1
    of = np.repeat(np.arange(len(which)), count)
    shift = ragged(np.zeros(len(which), np.int64), count)
    at = start[of] + shift
    return which[of], shift, mix64(lanes.of(at, at + kind.window) ^ U64(0xD6E8FEB86659FD93))


def _send_windows(kind: Kind, n: int, block: int, alone: list[tuple[np.ndarray, ...]], index: np.ndarray, start: np.ndarray, times: np.ndarray, ids: np.ndarray, null: np.ndarray, tie: np.ndarray, begin: np.ndarray) -> list[tuple]:
    """Step 3 for segments of hot anchors: each window goes to the shard that its own hash names. The windows of a segment differ."""
    of, shift, key = (np.concatenate([a[i] for a in alone]) for i in range(3))
    where = range_bucket(key >> U64(16), n)
    order = np.argsort(where, kind="stable")
    out = []
    for k, i, j in runs(where[order]):
        w = order[i:j]
        x = of[w]
        place = (ids[x], null[x].astype(np.uint8), tie[x], start[x] + shift[w] - begin[x]) if kind.first_stays else ()
        out.append((ALONE, k, block, pack(index[x], shift[w].astype(np.uint32), key[w], times[x].astype(np.uint8), *place)))
    return out


def _repeated_windows(got: list[tuple[int, list[np.ndarray]]], kind: Kind, n: int) -> list[tuple]:
    """Step 4 for windows dealt by their hashes: all of several equal ones are covered, or all but the first by place."""
    blocks = np.array([b for b, _ in got])
    source = np.repeat(np.arange(len(got)), [len(x[0]) for _, x in got])
    index, shift, key, times, *place = (np.concatenate([x[i] for _, x in got]) for i in range(len(got[0][1])))
    if kind.first_stays:
        ids, null, tie, at_doc = place
        order = np.lexsort((at_doc, blocks[source], tie, ids, null, key))
    else:
        order = np.argsort(key, kind="stable")
    at = groups(key[order])
    covered = np.repeat(np.add.reduceat(times[order], at, dtype=np.int64) > 1, np.diff(np.append(at, len(order))))
    if kind.first_stays:
        covered[at] = False
    tell = order[covered]
    tell = tell[np.lexsort((shift[tell], index[tell], source[tell]))]
    cut = np.searchsorted(source[tell], np.arange(len(got) + 1))
    out = []
    for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
        if j > i:
            s = shift[tell[i:j]]
            out.append((ANSWERS, int(blocks[k] % n), int(blocks[k]), pack(index[tell[i:j]], np.ones(j - i, np.uint32), s, s + np.uint32(kind.window))))
    return out


def _coded(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wide symbols as a dictionary (differences) and places in it; bytes as they are."""
    if symbols.dtype == np.uint8:
        return np.zeros(0, U64), symbols
    kinds, at = np.unique(symbols, return_inverse=True)
    return differences(kinds), at.astype(np.uint16 if len(kinds) <= 1 << 16 else np.uint32)


def _again(sums: np.ndarray, lanes: Lanes, start: np.ndarray, size: np.ndarray, kind: Kind) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and content hashes of known segments: the anchor is the least gram that all windows of a segment hold."""
    count = size - kind.window + 1  # windows
    lo, hi = start + count - 1, start + kind.window - kind.gram + 1  # grams that every window has
    many = hi - lo
    at = ragged(lo, many)
    key = mix64((sums[at + kind.gram] - sums[at]) * powers(len(sums))[1][at])
    key = (key & U64(0xFFFFFFFF00000000)) | (U64(0xFFFFFFFF) - at.astype(U64))
    low = np.minimum.reduceat(key, np.cumsum(many) - many) if len(at) else key
    a = (U64(0xFFFFFFFF) - (low & U64(0xFFFFFFFF))).astype(np.int64)
    return _segment_keys(sums, lanes, start, size, a, kind.gram)


def _answer(kind: Kind, n: int):  # noqa: ANN202
    """Step 4: indexes over a shard's distinct segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, alone = [], []
        for what, block, raw in _read(batches):
            if what == ANSWERS:
                yield packed_rows([(ANSWERS, block % n, block, raw.to_pybytes())])
            else:
                (alone if what == ALONE else got).append((block, unpack(raw)))
        if alone:
            yield packed_rows(_repeated_windows(alone, kind, n))
            alone.clear()
        if not got:
            return
        blocks = np.array([b for b, _ in got])
        source = np.repeat(np.arange(len(got)), [len(x[0]) for _, x in got])
        index, anchor, content, times, provide, ids, null, tie, at_doc = (np.concatenate([x[i] for _, x in got]) for i in range(9))
        sizes = np.concatenate([x[9] for _, x in got])
        symbols = [np.cumsum(x[10], dtype=U64)[x[11]] if len(x[10]) else x[11] for _, x in got if len(x[11])]
        symbols = np.concatenate(symbols) if symbols else np.zeros(0, np.uint8)
        given = np.flatnonzero(provide)
        upto = np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
        text_of = np.full(len(index), -1)
        text_of[given] = np.arange(len(given))
        # Distinct segments, members in the order of their places.
        order = np.lexsort((at_doc, blocks[source], tie, ids, null, content, anchor))
        at = groups(anchor[order], content[order])
        members = np.diff(np.append(at, len(order)))
        copies = np.add.reduceat(times[order].astype(np.int64), at)
        distinct = np.repeat(np.arange(len(at)), members)
        leader = order[at]
        text = np.maximum.reduceat(text_of[order], at)
        rank = np.empty(len(at), np.int64)  # places of the first members, as numbers; windows of a document stay in its order
        by_place = np.lexsort((at_doc[leader], blocks[source[leader]], tie[leader], ids[leader], null[leader]))
        same = (source[leader][by_place][1:] == source[leader][by_place][:-1]) & (ids[leader][by_place][1:] == ids[leader][by_place][:-1]) & (tie[leader][by_place][1:] == tie[leader][by_place][:-1]) & (null[leader][by_place][1:] == null[leader][by_place][:-1])
        longest = int(at_doc.max()) + int(sizes.max(initial=0)) + 2
        # Another document's number lies beyond every start of the one before.
        base = np.cumsum(np.concatenate(([0], ~same))) * longest if len(at) else np.zeros(0, np.int64)
        rank[by_place] = base + at_doc[leader][by_place]
        # Indexes of bounded size; an anchor's segments stay together (hot anchors have none here, those of equal segments no content).
        unlike = np.flatnonzero(text >= 0)
        size = sizes.astype(np.int64)[text[unlike]]
        new_anchor = np.ones(len(unlike), bool)
        new_anchor[1:] = anchor[leader[unlike]][1:] != anchor[leader[unlike]][:-1]
        total = np.cumsum(size)
        lot = np.maximum.accumulate(np.where(new_anchor, (total - size) // INDEX_SYMBOLS, 0))
        covered_s, covered_e, covered_of = [], [], []
        for lot_at, lot_to in zip(*(lambda c: (c, np.append(c[1:], len(unlike))))(groups(lot))):
            pick, length = unlike[lot_at:lot_to], size[lot_at:lot_to]
            begin = np.cumsum(length) - length
            part = Segment(symbols[ragged(upto[text[pick]], length)], begin, length, copies[pick], rank[pick])
            hit = kind.solve(part, kind.window)
            if len(hit):
                of = np.searchsorted(begin, hit, "right") - 1
                run_at = groups(hit - np.arange(len(hit)), of)
                run_to = np.append(run_at[1:], len(hit)) - 1
                covered_s.append(hit[run_at] - begin[of[run_at]])
                covered_e.append(hit[run_to] + kind.window - begin[of[run_at]])
                covered_of.append(pick[of[run_at]])
        cs, ce, co = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (covered_s, covered_e, covered_of))
        first_range = np.searchsorted(co, np.arange(len(at) + 1))
        # Whole segments: all copies of a repeated one, but for the first place where that one stays.
        is_leader = np.zeros(len(order), bool)
        is_leader[at] = True
        whole = copies[distinct] > 1
        if kind.first_stays:
            whole &= ~is_leader
        ranges = np.where(whole, 0, np.diff(first_range)[distinct])
        tell = np.flatnonzero(whole | (ranges > 0))
        tell = tell[np.argsort(source[order[tell]], kind="stable")]
        src = source[order[tell]]
        cut = np.searchsorted(src, np.arange(len(got) + 1))
        out = []
        for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if j > i:
                mine = tell[i:j]
                r = ranges[mine]
                take = ragged(first_range[distinct[mine]], r)
                out.append((ANSWERS, int(blocks[k] % n), int(blocks[k]), pack(index[order[mine]], np.where(whole[mine], ALL, r).astype(np.uint32), cs[take].astype(np.uint32), ce[take].astype(np.uint32))))
        yield packed_rows(out)

    return run


def _take_out(kind: Kind, text: str):  # noqa: ANN202
    """Step 5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_block(batches):
            rows = from_bytes(held[BLOCKS][0])
            sym, off = _block_symbols(rows, kind, text)
            edge = np.zeros(len(sym) + 1, np.int32)
            if PLACES in held:
                step, length, which, first, _ = unpack(held[PLACES][0])
                start, length = np.cumsum(step, dtype=np.int64), length.astype(np.int64)
                times = np.bincount(which)
                whole = times > 1  # copies inside the block: all, or all but the first
                said = np.zeros((2, len(times)), np.int64)
                ranges = []
                for raw in held.get(ANSWERS, ()):
                    index, what, s, e = unpack(raw)
                    full = what == ALL
                    whole[index[full]] = True
                    if kind.first_stays:
                        said[0, index[full]] = 1
                    part = index[~full]
                    said[1, part] = what[~full]
                    ranges.append((np.repeat(part, what[~full]), s.astype(np.int64), e.astype(np.int64)))
                cover = whole[which]
                if kind.first_stays:
                    cover = (whole[which] & (first == 0)) | (said[0][which] == 1)
                np.add.at(edge, start[cover], 1)
                np.add.at(edge, (start + length)[cover], -1)
                if ranges:
                    place = np.empty(len(times), np.int64)
                    one = np.flatnonzero(first)
                    place[which[one]] = one
                    of, s, e = (np.concatenate([r[i] for r in ranges]) for i in range(3))
                    np.add.at(edge, start[place[of]] + s, 1)
                    np.add.at(edge, start[place[of]] + e, -1)
            yield from kind.result(rows, sym, off, np.cumsum(edge[:-1]) > 0)

    return run


def take_out_repeats(docs: DataFrame, kind: Kind, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs as kind.result makes them. docs has unique column names."""
    spark, n = docs.sparkSession, partitions(docs)
    path = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
    _write_blocks(docs, kind, n, key, text).write.partitionBy("kind").option("compression", "none").parquet(path)
    rows = spark.read.schema("bucket int, block long, payload binary, kind int").parquet(path).select("kind", "bucket", "block", "payload")
    of = lambda *kinds: rows.filter(F.col("kind").isin(*kinds))
    wanted = deal(of(ASKED), n).mapInArrow(_want(n, INDEX_SYMBOLS // (2 * kind.window - kind.gram)), ROWS)
    sent = deal(of(BLOCKS, PLACES).unionByName(wanted), n).mapInArrow(_send(kind, n, key, text), ROWS)
    answers = stored(deal(sent, n).mapInArrow(_answer(kind, n), ROWS), "answers")
    release(spark)
    return deal(of(BLOCKS, PLACES).unionByName(answers), n).mapInArrow(_take_out(kind, text), kind.fields)
