"""Document fingerprints: Merkle trees over paragraphs, sections, and sections of sections.

A paragraph ends at a line's end, and in a line after a word whose hash says so (one in PARAGRAPH_WORDS); a section ends
after a child whose digest says so (one in CHILDREN), up to the root. So an edit moves no boundary far from it. A node's digest
is the SHA-256 of its children's; the root covers the whole text: equal texts, and no others, have equal roots.

A fingerprint is the root and the tree's nodes from the finest level on that has no more than NODES of them, each with
the bytes it covers, so its size is bounded. Likeness is read off two fingerprints from the top down: equal roots end it,
equal nodes count with their bytes and are not opened, differing ones are. What is shared is 2 * shared / (both sizes).

Defined cases: a null text is an empty one; a null doc_id comes last in the order; rows with the same doc_id follow one
another by their text's hash, then text; in a table of one row a document's next is itself; an empty table gives no
rows; texts of any length are fingerprinted whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import BYTE_VALUES, U64, ragged, running, stretch, words
from weftline.llm.common import partitions, pick
from weftline.llm.exchange import deal

#: Words in a paragraph cut from a line and children of a section, on average; nodes of a fingerprint's finest level.
PARAGRAPH_WORDS, CHILDREN, NODES = 4, 4, 64
#: Bytes beyond which a word is cut inside.
LONG_WORD = 32
#: Rows a range of documents that are sampled for the ranges' bounds, and in all; documents and bytes handled at once.
SAMPLED, MOST_SAMPLED, CHUNK_ROWS, CHUNK_BYTES = 64, 4_000_000, 256, 1 << 20
#: Ranges whose keys (about 40 bytes each) are broadcast.
MOST_BROADCAST = 1 << 20


def paragraphs(texts: list[bytes]) -> list[list[int]]:
    """Where the paragraphs of each text end. Every byte belongs to one; an empty text has none."""
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, _ = words(data, off)
    sums = running(BYTE_VALUES[data])
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if len(long):  # scripts without spaces and encoded data: cut inside, where four bytes say so
        at = ragged(starts[long], ends[long] - starts[long] - 4)
        at = at[stretch(sums, at, at + 4) % U64(16) == 0] + 4
        starts, ends = np.sort(np.concatenate((starts, at))), np.sort(np.concatenate((ends, at)))
    chosen = (stretch(sums, starts, ends) % U64(PARAGRAPH_WORDS) == 0)[:-1]
    chosen &= np.searchsorted(off, starts[1:], "right") == np.searchsorted(off, starts[:-1], "right")  # words of one text
    cuts = np.zeros(len(data) + 1, bool)
    cuts[starts[1:][chosen]] = True  # the next word begins a paragraph
    cuts[np.flatnonzero(data == 10) + 1] = True
    cuts[off] = True
    at = np.flatnonzero(cuts)
    cut = np.searchsorted(at, off)
    return [(at[i + 1 : j + 1] - o).tolist() for i, j, o in zip(cut[:-1], cut[1:], off[:-1])]


@dataclass
class Tree:
    """Levels from the paragraphs to the root's children: digests, bytes and number of children of each node."""

    root: bytes
    levels: list[tuple[list[bytes], list[int], list[int]]]


def _tree(text: bytes, ends: list[int]) -> Tree:
    sha = hashlib.sha256
    begins = [0, *ends[:-1]]
    level = [sha(text[a:b]).digest()[:16] for a, b in zip(begins, ends)], [b - a for a, b in zip(begins, ends)], [0] * len(ends)
    levels = []
    while len(level[0]) > 1:
        levels.append(level)
        digests, sizes, counts, at = [], [], [], 0
        for i, child in enumerate(level[0], 1):
            if child[0] % CHILDREN == 0 or i == len(level[0]) or len(levels) > 60:
                digests.append(sha(b"section" + b"".join(level[0][at:i])).digest()[:16])
                sizes.append(sum(level[1][at:i]))
                counts.append(i - at)
                at = i
        level = digests, sizes, counts
    return Tree(sha(b"root" + b"".join(level[0])).digest()[:16], levels + [level] * bool(level[0] and not levels))


def merkle_trees(texts: list[bytes]) -> list[Tree]:
    return [_tree(t, e) for t, e in zip(texts, paragraphs(texts))]


Nodes = list[tuple[list[str], list[int], list[int]]]


@dataclass
class Fingerprint:
    """root, the number of the finest level held, and levels from it upwards: digests, bytes, children."""

    root: str
    finest: int
    levels: Nodes

    def __str__(self) -> str:
        return f"{self.root}:{self.finest}:" + "/".join(".".join(f"{d}{n:x}" if not k else f"{d}{c:x}" for d, n, c in zip(*x)) for k, x in enumerate(self.levels))

    @classmethod
    def of(cls, tree: Tree) -> Fingerprint:
        finest = next((k for k, x in enumerate(tree.levels) if len(x[0]) <= NODES), 0)
        return cls(tree.root.hex(), finest, [([d[:4].hex() for d in x[0]], x[1], x[2]) for x in tree.levels[finest:]])

    @classmethod
    def parse(cls, text: str) -> Fingerprint:
        root, finest, rest = text.split(":")
        levels: Nodes = []
        for part in rest.split("/") if rest else []:
            digests = [x[:8] for x in part.split(".")]
            numbers = [int(x[8:], 16) for x in part.split(".")]
            if not levels:
                levels.append((digests, numbers, [0] * len(numbers)))
                continue
            sizes, at = [], 0
            for c in numbers:
                sizes.append(sum(levels[-1][1][at : at + c]))
                at += c
            levels.append((digests, sizes, numbers))
        return cls(root, int(finest), levels)


def _shared(a: Fingerprint, b: Fingerprint) -> int:
    """Bytes of the nodes that both have: levels from the top down, under differing nodes only."""
    finest = max(a.finest, b.finest)
    top = max(a.finest + len(a.levels), b.finest + len(b.levels)) - 1
    open_, total = [None, None], 0  # of each, the numbers of the nodes to look at on this level; None: all
    for k in range(top, finest - 1, -1):
        held: list[dict[str, list[int]]] = []
        for which, f in enumerate((a, b)):
            by: dict[str, list[int]] = {}
            if k - f.finest < len(f.levels):
                digests = f.levels[k - f.finest][0]
                for i in open_[which] if open_[which] is not None else range(len(digests)):
                    by.setdefault(digests[i], []).append(i)
            held.append(by)
        closed = (set(), set())
        for d, mine in held[0].items():
            for i, j in zip(mine, held[1].get(d, ())):
                closed[0].add(i), closed[1].add(j)
                total += a.levels[k - a.finest][1][i]
        for which, f in enumerate((a, b)):
            if k - f.finest >= len(f.levels) or k == finest:
                continue
            children, at = [], 0
            opened = {i for by in held[which].values() for i in by} - closed[which]
            for i, c in enumerate(f.levels[k - f.finest][2]):
                if i in opened:
                    children.extend(range(at, at + c))
                at += c
            open_[which] = children
    return total


def likeness(a: Fingerprint | str, b: Fingerprint | str) -> float:
    """How alike two fingerprints are, 0 to 1: bytes under shared nodes, twice, over both texts' bytes."""
    a, b = (Fingerprint.parse(x) if isinstance(x, str) else x for x in (a, b))
    if a.root == b.root:
        return 1.0
    size = sum(sum(f.levels[0][1]) for f in (a, b) if f.levels)
    return min(2 * _shared(a, b) / size, 1 - 2**-20) if size else 0.0  # roots differ, so the texts do


def fingerprints(texts: list[bytes]) -> list[Fingerprint]:
    return [Fingerprint.of(t) for t in merkle_trees(texts)]


def locate_edits(a: bytes, b: bytes) -> list[tuple[int, int]]:
    """Byte ranges of a's paragraphs that b does not have: equal roots end it, equal sections are passed over."""
    x, y = merkle_trees([a, b])
    if x.root == y.root:
        return []
    there = [set(level[0]) for level in y.levels]
    found: list[tuple[int, int]] = []

    def descend(level: int, first: int, last: int, at: int) -> None:
        digests, sizes, counts = x.levels[level]
        child = sum(counts[:first])
        for i in range(first, last):
            if level >= len(there) or digests[i] not in there[level]:
                if level:
                    descend(level - 1, child, child + counts[i], at)
                else:
                    found.append((at, at + sizes[i]))
            child, at = child + counts[i], at + sizes[i]

    if x.levels:
        descend(len(x.levels) - 1, 0, len(x.levels[-1][0]), 0)
    return found


def merkle_nodes(docs: DataFrame) -> DataFrame:
    """doc_id, level (0: paragraphs; the highest: the root), index, parent (index on the next level), digest, start, end."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            raws = [(t or "").encode() for t in b.column(1).to_pylist()]
            for i, raw, tree in zip(b.column(0).to_pylist(), raws, merkle_trees(raws)):
                for k, (digests, sizes, _) in enumerate(tree.levels):
                    above = tree.levels[k + 1][2] if k + 1 < len(tree.levels) else [len(digests)]
                    parent = [p for p, c in enumerate(above) for _ in range(c)]
                    at = 0
                    for j, (d, n) in enumerate(zip(digests, sizes)):
                        rows.append((i, k, j, parent[j], d.hex(), at, at + n))
                        at += n
                rows.append((i, len(tree.levels), 0, None, tree.root.hex(), 0, len(raw)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], ["doc_id", "level", "index", "parent", "digest", "start", "end"])

    return pick(docs, "doc_id", "text").mapInArrow(nodes, "doc_id long, level long, index long, parent long, digest string, start long, end long")


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KEY = ["unnamed", "turned", "hash", "salt"]


def _print(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, the last of them the first document of the next range: fingerprints of all but that one."""
    held: list[tuple[int | None, str]] = []
    size = 0

    def flush(last: bool) -> pa.RecordBatch:
        nonlocal held, size
        part, (_, follow) = held[:-1], held[-1]
        texts = [t for _, t in part]
        follows = [*texts[1:], follow]
        edited = [(s[: len(s) - len(s) // 2] + f[: len(s) // 2]).encode() for s, f in zip(texts, follows)]
        prints = fingerprints([t.encode() for t in [*texts, follow]])
        e_prints = fingerprints(edited)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in part], pa.int64()), pa.array([len(s) for s in texts], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([str(p) for p in prints[:-1]], pa.string()), pa.array([str(p) for p in e_prints], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(prints, e_prints)], pa.float64()), pa.array([likeness(a, b) for a, b in zip(prints, prints[1:])], pa.float64()),
            ],
            [c.split()[0] for c in _OUT.split(", ")],
        )
        held, size = [] if last else held[-1:], 0
        return out

    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            held.append((i, t.as_py() or ""))
            size += len(held[-1][1])
            if len(held) > 1 and (len(held) > CHUNK_ROWS or size > CHUNK_BYTES):
                yield flush(False)
    if len(held) > 1:
        yield flush(True)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness (see _OUT).

    The next document in descending doc_id is at hand because texts are dealt out by ranges of the order: the first
    document of each range also goes to the range before it, and the very first to the last range. A range is sorted by
    Spark and read as a stream. Rows equal in all have a salt in the order, so ranges cut them too. The driver holds one
    key a range and a bounded sample.
    """
    spark = docs.sparkSession
    slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    keyed = slim.select(
        "doc_id", "text", F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0).cast("long")).alias("turned"),
        F.xxhash64("text").alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    n, total = partitions(docs), slim.count()
    share = min(1.0, max(1000, min(SAMPLED * n, MOST_SAMPLED)) / max(total, 1))
    sample = keyed.select(*_KEY).sample(share, 1).toPandas() if n > 1 else pd.DataFrame(columns=_KEY)
    order = np.lexsort([sample[c].to_numpy(np.int64) for c in reversed(_KEY)])
    bounds = sample.iloc[order[[len(order) * k // n for k in range(1, n)]]] if len(order) else sample

    @F.pandas_udf("int")
    def range_of(unnamed: pd.Series, turned: pd.Series, hashes: pd.Series, salt: pd.Series) -> pd.Series:
        """The number of bounds up to each key."""
        columns = [np.concatenate((bounds[c].to_numpy(np.int64), x.to_numpy(np.int64))) for c, x in zip(_KEY, (unnamed, turned, hashes, salt))]
        at = np.lexsort(columns[::-1])
        out = np.empty(len(at), np.int32)
        out[at] = np.cumsum(at < len(bounds))
        return pd.Series(out[len(bounds) :])

    dealt = keyed.withColumn("bucket", range_of(*_KEY))
    tops = dealt.groupBy("bucket").agg(F.min(F.struct("unnamed", "turned", "hash")).alias("top")).orderBy("bucket").collect()  # one row a range
    if not tops:
        return spark.createDataFrame([], _OUT)
    before = [(tops[k - 1]["bucket"], *t["top"]) for k, t in enumerate(tops)]
    wanted = spark.createDataFrame(before, "to int, unnamed boolean, turned long, hash long")
    if len(before) <= MOST_BROADCAST:  # else the planner decides
        wanted = F.broadcast(wanted)
    # Equal keys may be many, and may begin many ranges: one text of each key first, then one row a range.
    same = _KEY[:3]
    firsts = keyed.join(wanted.select(*same), same, "left_semi").groupBy(*same).agg(F.min(F.struct("doc_id", "text")).alias("r"))
    extra = firsts.join(wanted, same).select(F.col("to").alias("bucket"), F.lit(True).alias("extra"), "r.doc_id", "r.text", *(F.lit(0).cast("long").alias(c) for c in ("rank", *same[1:])))
    own = dealt.select("bucket", F.lit(False).alias("extra"), "doc_id", "text", F.col("unnamed").cast("long").alias("rank"), *same[1:])
    placed = deal(own.unionByName(extra), max(n, len(bounds) + 1)).sortWithinPartitions("bucket", "extra", "rank", "turned", "hash", "text")
    return placed.select("doc_id", "text").mapInArrow(_print, _OUT)
