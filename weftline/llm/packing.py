"""Best-fit packing of token sequences with swap-based local search.

Documents become token ids and pieces of at most `capacity` tokens. The histogram of piece lengths (at most `capacity`
entries, whatever the size of the corpus) is packed on the driver: bins with the same contents are one class with a
multiplicity, best fit places the longest pieces first, and the local search moves, swaps one for one or exchanges two
for one between underfull classes while that increases the sum of squared fills, until the bins are as few as a lower
bound says or no pair of classes improves: every class is tried with every other, and again with classes made since. It
also ends after EFFORT pairs of classes, which bounds the driver's time; every piece has its place whenever it ends.
Pieces are then ranked among those of their length in bounded groups and look their place up in the plan.

Token ids are those of the tokenizer file, its special tokens included: a text that holds one's string gets its id there.
Between them the text is cut where the byte-level BPE's own pattern cuts it, on whole slices in NumPy; each distinct
piece of a worker's slices is encoded once, found again by its hash, compared by its bytes, and its ids are gathered.

Defined cases: null or empty text is the end token alone; repeated rows are packed each; rows with a null doc_id are
packed and keep it; texts of any length are cut, none is dropped; an empty table gives no rows.
"""

from __future__ import annotations

import json
import sys
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.arrays import U64, place_hashes, ragged, slices
from weftline.llm.common import pick, stored

CAPACITY, END_ID = 2048, 0
#: Entries after which a worker's table of encoded pieces starts anew: it bounds the memory.
KNOWN_LIMIT = 1 << 18
#: Text bytes that are encoded at once.
ENCODED_BYTES = 1 << 19
#: Pairs of classes of bins that the local search looks at before it ends, about a minute of work.
EFFORT = 1_500_000
#: Rows that share a length are ranked in groups of about so many; groups are at most the distinct lengths plus MOST_LANES.
LANE_ROWS, MOST_LANES = 256, 4096


# -- token ids -------------------------------------------------------------------------------------------------------

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: White_Space, general category L*, N*, any other."""
    kinds = np.full(sys.maxunicode + 1, _OTHER, np.uint8)
    for cp in range(sys.maxunicode + 1):
        head = unicodedata.category(chr(cp))[0]
        if head == "L":
            kinds[cp] = _LETTER
        elif head == "N":
            kinds[cp] = _NUMBER
        elif chr(cp).isspace() and not 0x1C <= cp <= 0x1F:
            kinds[cp] = _SPACE
    return kinds


def cut_points(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the pieces that the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces not before a non-space|spaces
    finds in texts laid end to end; first marks the code points at which texts begin."""
    n = len(cps)
    kind = _classes()[cps]
    run = np.ones(n, bool)
    run[1:] = (kind[1:] != kind[:-1]) | first[1:]
    cut = run.copy()
    # A run of spaces gives its last one up to what follows: a blank joins the next piece, another space stands alone.
    after = np.flatnonzero(run & (kind != _SPACE) & ~first)
    after = after[after > 0]
    after = after[kind[after - 1] == _SPACE]
    cut[after - 1] = True
    cut[after[cps[after - 1] == 32]] = False
    # Contractions: a lone apostrophe that begins a piece, with letters behind it.
    at = np.flatnonzero((cps[:-1] == 39) & cut[:-1] & run[:-1]) if n > 1 else np.zeros(0, np.int64)
    at = at[(kind[at + 1] == _LETTER) & ~first[at + 1]]
    if len(at):
        one = cps[at + 1]
        two_ok = (at + 2 < n) & ~first[np.minimum(at + 2, n - 1)]
        two = np.where(two_ok, cps[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(long, 2, 0))
        at, size = at[size > 0], size[size > 0]
        cut[at + 1] = False
        rest = at + 1 + size
        rest = rest[rest < n]
        cut[rest[(kind[rest] == _LETTER) & ~first[rest]]] = True
    return np.flatnonzero(cut)


@lru_cache(1)
def _byte_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies: printable ones for themselves, the others from
    U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


#: Fixed value: how byte-level vocabularies cut text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of texts under a byte-level BPE given as a tokenizers file; equal to that tokenizer's own ids without further
    special tokens added."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        vocabulary, byte_of = held["model"]["vocab"], _byte_of()
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in held["model"]["merges"]]
        before = held["pre_tokenizer"]
        if held["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or merged != sorted(merged):
            raise ValueError(f"{path} is not a plain byte-level BPE with ids in the order of merges")
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"]):
            raise ValueError("special tokens that take their surroundings are not supported")
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.forget()

    def forget(self) -> None:
        """Of each known piece, by hash: where its bytes and its ids begin, and how many there are."""
        self.hashes, self.known = np.zeros(0, U64), np.zeros((4, 0), np.int32)
        self.raw, self.raw_used = np.zeros(1 << 16, np.uint8), 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def _ids(self, piece: bytes) -> list[int]:
        name = self.special.get(piece.decode("utf-8", "replace"))
        return self.core.encode_single_piece(piece) if name is None else [name]

    def _keep_ids(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        return starts, sizes

    def learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Add pieces; hashes are sorted and new."""
        starts, sizes = self._keep_ids([self._ids(p) for p in pieces])
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        if self.raw_used + len(raw) > len(self.raw):
            self.raw = np.concatenate([self.raw, np.zeros(max(len(self.raw), len(raw)), np.uint8)])
        self.raw[self.raw_used : self.raw_used + len(raw)] = raw
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begin = self.raw_used + np.cumsum(length) - length
        self.raw_used += len(raw)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.known = np.insert(self.known, at, np.stack((begin, length, starts, sizes)).astype(np.int32), axis=1)

    def special_spans(self, whole: str, begin: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens' strings stand in the texts that begin at begin: the leftmost first, the longest of equal ones."""
        spans = []
        texts = set()
        for s in self.special:
            at = whole.find(s)
            while at >= 0:
                texts.add(int(np.searchsorted(begin, at, "right")) - 1)
                at = whole.find(s, at + 1)
        for t in sorted(texts):
            at, end = int(begin[t]), int(begin[t + 1])
            while True:
                found = [(k, -len(s)) for s in self.special if (k := whole.find(s, at, end)) >= 0]
                if not found:
                    break
                k, size = min(found)
                spans.append((k, k - size))
                at = k - size
        return spans

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, laid end to end, and n + 1 offsets."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        if len(self.hashes) > KNOWN_LIMIT:
            self.forget()
        raw = data.tobytes()
        whole = raw.decode("utf-8", "replace")
        cps = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        chars = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
        begin = chars[off]
        first = np.zeros(len(cps), bool)
        first[begin[:-1][begin[:-1] < len(cps)]] = True
        spans = self.special_spans(whole, begin)
        for a, b in spans:
            first[a] = True
            if b < len(cps):
                first[b] = True
        starts = cut_points(cps, first)
        for a, b in spans:  # a special token is one piece
            starts = np.concatenate((starts[: np.searchsorted(starts, a, "right")], starts[np.searchsorted(starts, b) :]))
        place = np.flatnonzero((data & 0xC0) != 0x80)[starts]
        ends = np.append(place[1:], len(data))
        hashes = place_hashes(data, place, ends)
        distinct, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.ones(len(distinct), bool)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)
            new = self.hashes[at] != distinct
        if new.any():
            self.learn(distinct[new], [raw[a:b] for a, b in zip(place[where[new]].tolist(), ends[where[new]].tolist())])
        text, length, ids_at, sizes = self.known[:, np.searchsorted(self.hashes, distinct)][:, back].astype(np.int64)
        differ = length != ends - place
        if not differ.any():
            unequal = np.flatnonzero(self.raw[ragged(text, length)] != data)
            differ[np.searchsorted(place, unequal, "right") - 1] = True
        else:
            differ[:] = [self.raw[t : t + n].tobytes() != raw[a:b] for t, n, a, b in zip(text, length, place, ends)]
        if differ.any():  # other bytes under a known hash
            ids_at[differ], sizes[differ] = self._keep_ids([self._ids(raw[a:b]) for a, b in zip(place[differ], ends[differ])])
        upto = np.concatenate(([0], np.cumsum(sizes)))
        return self.ids[ragged(ids_at, sizes)], upto[np.searchsorted(starts, begin)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_vocabulary() -> str:
    """The installed byte-level tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECE_SCHEMA = "doc_id long, piece int, start long, length int, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece. A document longer than capacity is cut into full pieces; its first piece holds what is over."""
    held = vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(held or default_vocabulary())
        for rows, data, off in slices(batches, limit=ENCODED_BYTES):
            ids, upto = coder.encode(data, off)
            n = np.diff(upto) + 1
            count = (n + capacity - 1) // capacity
            piece = ragged(np.zeros(len(n), np.int64), count)
            doc = np.repeat(np.arange(len(n)), count)
            over = n - (count - 1) * capacity
            start = np.where(piece == 0, 0, over[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, over[doc], capacity)
            full = np.insert(ids, upto[1:], END_ID)
            base = (upto[:-1] + np.arange(len(n)))[doc] + start
            raw = memoryview(full.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(base.tolist(), (base + length).tolist())]
            out = [rows.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(np.append(base, len(full)), pa.int32()), pa.array(full.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in (PIECE_SCHEMA + ", ids array<int>" * with_ids).split(", ")])

    return pick(docs, "doc_id", "text").mapInArrow(cut, PIECE_SCHEMA + ", ids array<int>" * with_ids)


# -- the plan --------------------------------------------------------------------------------------------------------

Bins = dict[tuple[int, ...], int]


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first, on classes of equal bins: lengths (descending) to the number of such bins."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    rooms: list[int] = []

    def put(bin_: tuple[int, ...], n: int) -> None:
        room = capacity - sum(bin_)
        if room not in by_room or not by_room[room]:
            if room not in by_room:
                insort(rooms, room)
            by_room[room] = by_room.get(room) or {}
        by_room[room][bin_] = by_room[room].get(bin_, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            while i < len(rooms) and not by_room[rooms[i]]:
                del by_room[rooms[i]], rooms[i]
            if i < len(rooms):
                room = rooms[i]
                bin_, n = next(iter(by_room[room].items()))
                fits = room // length
                if left >= n * fits:
                    each, k = fits, n
                else:
                    each, k = (fits, left // fits) if left >= fits else (left, 1)
                by_room[room].pop(bin_)
                if n > k:
                    by_room[room][bin_] = n - k
                put(bin_ + (length,) * each, k)
                left -= each * k
            else:
                fits = capacity // length
                if left >= fits:
                    put((length,) * fits, left // fits)
                    left %= fits
                else:
                    put((length,) * left, 1)
                    left = 0
    out: Bins = defaultdict(int)
    for held in by_room.values():
        for bin_, n in held.items():
            out[bin_] += n
    return dict(out)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: by total length, by how many pieces beyond a part of the capacity a bin can hold, and by what the
    pieces of more than half a bin leave to smaller ones."""
    size = np.array(sorted(counts), np.int64)
    n = np.array([counts[k] for k in size.tolist()], np.int64)
    total = lambda ok: int((size * n)[ok].sum())
    best = -(-total(size > 0) // capacity)
    for m in range(1, capacity):
        best = max(best, -(-int(n[size * (m + 1) > capacity].sum()) // m))
    for a in size[2 * size <= capacity].tolist():
        large, middle, small = size > capacity - a, (2 * size > capacity) & (size <= capacity - a), (2 * size <= capacity) & (size >= a)
        held = int(n[middle].sum())
        best = max(best, int(n[large].sum()) + held + max(0, -(-(total(small) - held * capacity + total(middle)) // capacity)))
    return best


@lru_cache(1 << 14)
def _sums(bin_: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lengths, distinct sums of two pieces, and the lesser piece of each sum."""
    one, n = np.unique(bin_, return_counts=True)
    i, j = np.triu_indices(len(one))
    ok = (i != j) | (n[i] > 1)
    two, at = np.unique((one[i] + one[j])[ok], return_index=True)
    return one, two, one[i[ok][at]]


def _exchange(give: tuple[int, ...], take: tuple[int, ...], a: int, b: int, room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The best move, swap (one for one) or exchange (two for one, either way) between bins of fills a and b that makes `take`
    fuller: gain in squared fill, which grows with what goes over."""
    g1, g2, g2a = _sums(give)
    t1, t2, t2a = _sums(take)
    best, move = 0, ((), ())
    k = int(np.searchsorted(g1, room, "right")) - 1
    if k >= 0:
        best, move = int(g1[k]), ((int(g1[k]),), ())
    for g, t, ga, ta in ((g1, t1, None, None), (g1, t2, None, t2a), (g2, t1, g2a, None)):
        if best == room or not len(g) or not len(t):
            continue
        at = np.searchsorted(t, g - room)  # the least that must come back
        over = g - t[np.minimum(at, len(t) - 1)]
        over[at == len(t)] = 0
        k = int(over.argmax())
        if over[k] > best:
            parts = lambda x, lesser, j: (int(x[j]),) if lesser is None else (int(lesser[j]), int(x[j] - lesser[j]))
            best, move = int(over[k]), (parts(g, ga, k), parts(t, ta, int(at[k])))
    gain = 2 * best * (b - a + best)
    return (gain, *move) if gain > 0 else (0, (), ())


def local_search(bins: Bins, capacity: int, effort: int = EFFORT) -> Bins:
    """Empty the least filled bins: exchange with the fuller ones that still have room, while the sum of squared fills grows."""
    bins, looked = dict(bins), 0
    counts: dict[int, int] = defaultdict(int)
    for bin_, n in bins.items():
        for length in bin_:
            counts[length] += n
    count, least = sum(bins.values()), least_bins(counts, capacity)
    clock = 0  # changes so far
    born = dict.fromkeys(bins, 0)  # when a class came up, or came to have a second bin to pair with
    tried: dict[tuple[int, ...], int] = {}  # when a class last found no partner
    under = sorted((sum(b), b) for b in bins if sum(b) < capacity)

    def add(bin_: tuple[int, ...], n: int) -> None:
        if not bin_:
            return
        bin_ = tuple(sorted(bin_, reverse=True))
        before = bins.get(bin_, 0)
        entry = (sum(bin_), bin_)
        if before + n:
            bins[bin_] = before + n
            if before < 2 <= before + n or not before:
                born[bin_] = clock
            if not before and entry[0] < capacity:
                insort(under, entry)
        else:
            del bins[bin_], born[bin_]
            tried.pop(bin_, None)
            if entry[0] < capacity:
                del under[bisect_left(under, entry)]

    moved = True
    while moved and count > least and looked < effort:
        moved = False
        for a, give in list(under):  # a sweep: each class against those that came up since it was last tried
            while give in bins and tried.get(give, -1) < clock and count > least and looked < effort:
                since, best, found = tried.get(give, -1), (0, (), ()), None
                for b, take in under:
                    if 2 * (capacity - b) * (capacity - a) <= best[0]:
                        break  # nor can any fuller one gain more
                    if born[take] <= since or (take == give and bins[take] < 2):
                        continue
                    looked += 1
                    if (got := _exchange(give, take, a, b, capacity - b))[0] > best[0]:
                        best, found = got, take
                if found is None:
                    tried[give] = clock
                    break
                clock, moved = clock + 1, True
                k = min(bins[give], bins[found]) if found != give else bins[give] // 2
                left, right = list(give), list(found)
                for x in best[1]:
                    left.remove(x)
                    right.append(x)
                for x in best[2]:
                    right.remove(x)
                    left.append(x)
                add(give, -k)
                add(found, -k)
                add(tuple(left), k)
                add(tuple(right), k)
                count -= k * (not left)
    return bins


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    return local_search(best_fit(counts, capacity), capacity)


def layout(bins: Bins) -> dict[str, np.ndarray]:
    """Ranges of ranks by length: ranks rank0 up to rank0 + n of a length go to sequences sequence0, ... at one offset."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for bin_, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in bin_:
            rows.append((length, used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    x = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": x[:, 0], "rank0": x[:, 1], "sequence0": x[:, 2], "offset": x[:, 3]}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column length) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = layout(plan_bins(counts, capacity))
    total = sum(counts.values())
    lane_rows = max(LANE_ROWS, total // MOST_LANES)
    lanes = {k: -(-n // lane_rows) for k, n in counts.items()}
    lane_of = spark.createDataFrame([(k, n) for k, n in lanes.items()], "len int, lanes int")  # at most capacity rows
    columns = pieces.columns
    placed = pieces.join(F.broadcast(lane_of), F.col("length") == F.col("len")).drop("len")
    placed = placed.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("lanes")).cast("int")).drop("lanes")
    sizes = placed.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity + MOST_LANES rows
    first: dict[tuple[int, int], int] = {}
    upto: dict[int, int] = defaultdict(int)
    for r in sorted(sizes):
        first[r["length"], r["lane"]] = upto[r["length"]]
        upto[r["length"]] += r["n"]
    keys = np.array([(a << 32) + b for a, b in sorted(first)], np.int64)
    firsts = np.array([first[k] for k in sorted(first)], np.int64)
    order = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    ranges = (plan["length"] << 44) + plan["rank0"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy().astype(np.int64)
            lane = b.column(b.schema.get_field_index("lane")).to_numpy().astype(np.int64)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy() + firsts[np.searchsorted(keys, (length << 32) + lane)]
            at = np.searchsorted(ranges, (length << 44) + rank, "right") - 1
            seq = plan["sequence0"][at] + rank - plan["rank0"][at]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in columns] + [pa.array(seq), pa.array(plan["offset"][at])], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = stored(token_pieces(docs, capacity, vocabulary), "pieces")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The packed token ids themselves: sequence_id, ids. A sequence has at most capacity ids, so its group is bounded."""
    packed = pack_pieces(stored(token_pieces(docs, capacity, vocabulary, with_ids=True), "pieces"), capacity)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
