"""MinHash near-duplicate detection with odd sketches.

Documents with equal shingle sets are one class from the start. Each class has MinHash samples, cut into bands; classes
that share a band are candidates. The samples are also folded into an odd sketch, a bitmap in which each sample flips a
bit: the population count of two sketches' XOR estimates the similarity, and candidates that are clearly too far apart
go. The others are confirmed on their full sets. Linked classes form components.

A band's group is never expanded into all its pairs. In the first rounds each member outside its group's largest
component meets one pivot of it, another one each round: as many pairs as members. What then still lies outside a
group's largest component is compared with the group in blocks of bounded size; there sketches choose, full sets decide,
and a task gives no more links than join its components. So large groups of copies cost about their size, and no link
that matters for a component is dropped.

With BANDS bands of ROWS samples a pair at similarity 0.8 is missed with chance (1 - 0.8**ROWS)**BANDS, about 5e-8; the
sketch limit lies six standard deviations from a pair at 0.8.

Defined cases: null or blank text has an empty set, is linked with nothing and is its own component; fewer words than a
shingle has count as one shingle; a null doc_id never names a component unless all its members are null; rows that
repeat a doc_id are each returned; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import U64, lower_ascii, mix64, slices, word_hashes, words
from weftline.llm.common import discard, pick, stored
from weftline.llm.components import components

BANDS, ROWS, SKETCH_BITS = 32, 4, 1024
SAMPLES = BANDS * ROWS
#: Pivot rounds before the rest is compared in blocks, members a block, members of a band's group that one task joins, and
#: parts into which every band or component is cut where the size of its group is not known.
ROUNDS, BLOCK, LANE_ROWS, LANES = 3, 512, 1024, 16

_SEED = mix64(np.arange(2 * SAMPLES, dtype=U64) + U64(0xA0761D6478BD642F))
_FACTOR = _SEED[:SAMPLES] | U64(1)
_SALT = _SEED[SAMPLES:]


def shingles(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of every text, ascending within the text, and n + 1 offsets."""
    low = lower_ascii(data)
    starts, ends, first = words(low, off)
    count = np.diff(first)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    h = word_hashes(low, starts, ends)
    fold = h.copy()
    found_h, found_d = [], []
    for c in range(1, k + 1):
        if c > 1:
            fold = mix64(fold[:-1] * U64(0x9E3779B97F4A7C15) + h[c - 1 :])
        if c < k:  # a text of c words only: its whole sequence
            d = np.flatnonzero(count == c)
            found_h.append(fold[first[d]] ^ U64(0x1B873593 * c))
        else:
            d = np.repeat(np.arange(len(count)), np.maximum(count - k + 1, 0))
            at = np.arange(len(fold))
            ok = np.ones(len(starts), bool)
            ends_at = first[1:][count > 0]
            for j in range(1, k):
                ok[np.maximum(ends_at - j, 0)] = False
            found_h.append(fold[ok[: len(fold)] & (at < len(fold))])
        found_d.append(d)
    hs, ds = np.concatenate(found_h), np.concatenate(found_d)
    order = np.lexsort((hs, ds))
    hs, ds = hs[order], ds[order]
    keep = np.ones(len(hs), bool)
    keep[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    hs, ds = hs[keep], ds[keep]
    return hs, np.searchsorted(ds, np.arange(len(off)))


def set_ids(hs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One number for each set: equal sets, equal numbers."""
    total = np.concatenate(([U64(0)], np.cumsum(mix64(hs ^ U64(0x5DEECE66D)))))
    n = np.diff(at).astype(U64)
    return mix64((total[at[1:]] - total[at[:-1]]) ^ mix64(n)).view(np.int64)


def signatures(hs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (sets x BANDS) and odd sketches (sets x SKETCH_BITS / 64) of non-empty sets."""
    n = len(at) - 1
    band = np.zeros((n, BANDS), U64)
    sketch = np.zeros((n, SKETCH_BITS // 64), U64)
    row = np.arange(n)
    for j in range(SAMPLES):
        low = np.minimum.reduceat(hs * _FACTOR[j] ^ _SALT[j], at[:-1])
        b = j // ROWS
        band[:, b] = mix64(band[:, b] * U64(0x9E3779B97F4A7C15) + low + U64(b))
        bit = mix64(low + U64(j)) % U64(SKETCH_BITS)
        sketch[row, (bit >> U64(6)).astype(np.int64)] ^= U64(1) << (bit & U64(63))
    return band.view(np.int64), sketch.view(np.int64)


def sketch_limit(percent: int) -> int:
    """The largest XOR count of two sketches that is looked at: six standard deviations from a pair just similar enough."""
    p = 1 - percent / 100
    return int(2 * (SAMPLES * p + 6 * (SAMPLES * p * (1 - p)) ** 0.5)) + 1


def _signed(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches):
            hs, at = shingles(data, off, k)
            n = np.diff(at)
            full = np.flatnonzero(n)
            band, sketch = np.zeros((len(n), BANDS), np.int64), np.zeros((len(n), SKETCH_BITS // 64), np.int64)
            if len(full):
                band[full], sketch[full] = signatures(hs, np.append(at[:-1][full], len(hs)))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1))) for x in (band, sketch)]
            own = [rows.column(rows.schema.get_field_index(c)) for c in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array(set_ids(hs, at)), pa.array(n.astype(np.int64)), *lists], [*keys, "set_id", "n_shingles", "bands", "sketch"])

    keys = [c for c in docs.columns if c != "text"]
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", set_id long, n_shingles long, bands array<long>, sketch array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, off in slices(batches):
            hs, at = shingles(data, off, k)
            yield pa.RecordBatch.from_arrays([pa.array(set_ids(hs, at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hs.view(np.int64)))], ["set_id", "members"])

    return docs.mapInArrow(run, "set_id long, members array<long>")


def _far(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _same_set(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _block_links(members: DataFrame, limit: int, percent: int) -> DataFrame:
    """members: key, i, j (numbers of two blocks of the key), left (whether the row is in the first), comp, set_id, sketch,
    members. Links a, b between different components, as many as it takes to join them: sketches choose, full sets
    decide, and pairs that are joined by then are passed over."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids, comp = table.column("set_id").to_numpy(), table.column("comp").to_numpy()
        sk = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(ids), -1).view(U64)
        sets = table.column("members")
        is_left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        kinds, comp = np.unique(comp, return_inverse=True)
        root = np.arange(len(kinds))  # of each component, kept flat
        a, b = [], []
        for x in left:
            other = right[root[comp[right]] != root[comp[x]]]
            far = np.bitwise_count(sk[other] ^ sk[x]).sum(axis=1)
            near = np.flatnonzero(far <= limit)
            mine = sets[x].values.to_numpy() if len(near) else None
            for y in other[near[np.argsort(far[near], kind="stable")]]:
                if root[comp[x]] != root[comp[y]] and _same_set(mine, sets[y].values.to_numpy(), percent):
                    a.append(ids[x]), b.append(ids[y])
                    root[root == root[comp[y]]] = root[comp[x]]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return members.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _beside(members: DataFrame, by_key: DataFrame) -> DataFrame:
    """members (key, n, set_id, ...) joined with rows of their key (key, n, ...; n is the group's size in both). A large group is cut
    into lanes, to each of which its key's row goes, so no task gets the whole of it."""
    lanes = F.ceil(F.col("n") / LANE_ROWS).cast("int")
    each = by_key.withColumn("lane", F.explode(F.sequence(F.lit(0), lanes - 1))).drop("n")
    return members.withColumn("lane", F.pmod(F.xxhash64("set_id"), lanes).cast("int")).join(each, ["key", "lane"]).drop("lane")


def _by_component(members: DataFrame, by_comp: DataFrame, how: str) -> DataFrame:
    """members (set_id, comp, ...) joined with rows of their component (comp, ...): every component is cut into lanes, since one may
    have most of the members."""
    each = by_comp.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    return members.withColumn("lane", F.pmod(F.xxhash64("set_id"), F.lit(LANES)).cast("int")).join(each, ["comp", "lane"], how).drop("lane")


def link_classes(signed: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """set_id, comp of every class that shares a band with another; None if there is none."""
    made: list[DataFrame] = []
    labels = _linked(signed, docs, k, percent, made)
    if hasattr(labels, "stored_path"):  # nothing else is read again
        discard(*(x for x in made if x is not labels))
    return labels


def _linked(signed: DataFrame, docs: DataFrame, k: int, percent: int, made: list[DataFrame]) -> DataFrame | None:
    """link_classes; made gets the tables stored on the way."""

    def keep(x: DataFrame, name: str) -> DataFrame:
        made.append(stored(x, name))
        return made[-1]

    classes = signed.filter(F.col("n_shingles") > 0).groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    keyed = classes.select("set_id", F.explode("bands").alias("key"))
    # Bands with the same members say the same: one of them is kept.
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("who")).filter(F.col("n") > 1)
    shared = shared.groupBy("n", "who").agg(F.min("key").alias("key")).select("key", "n")
    lane = F.pmod(F.xxhash64("set_id"), F.lit(LANES)).cast("int")
    each = shared.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    groups = keep(keyed.withColumn("lane", lane).join(each, ["key", "lane"]).select("key", "n", "set_id"), "groups")
    if groups.isEmpty():
        return None
    needed = keep(groups.select("set_id").distinct().join(classes.select("set_id", "doc_id", "sketch"), "set_id"), "needed")
    wanted = needed.select(F.col("doc_id").alias("rep")).distinct()
    sets = _sets(docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("doc_id", "text"), k)
    sets = keep(sets.join(needed.select("set_id", "sketch"), "set_id").dropDuplicates(["set_id"]), "sets")
    limit = sketch_limit(percent)
    labels = needed.select("set_id", F.col("set_id").alias("comp"))

    def merge(found: DataFrame) -> DataFrame:
        """Labels after further links (a, b): only what they join is looked at again, components in place of their members."""
        links = stored(found, "links")
        of = lambda c: labels.select(F.col("set_id").alias(c), F.col("comp").alias(f"{c}_comp"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
        edges = keep(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
        discard(links)
        if edges.isEmpty():
            return labels
        ends = edges.select(F.col("a").alias("set_id")).union(edges.select("b")).distinct()
        roots = components(edges, ends).select(F.col("set_id").alias("comp"), F.col("comp").alias("root"))
        return keep(_by_component(labels, roots, "left").select("set_id", F.coalesce("root", "comp").alias("comp")), "labels")

    def spanning() -> DataFrame:
        """Groups that span components, with each row's component and the group's largest one."""
        g = groups.join(labels, "set_id")
        by = g.groupBy("key", "n", "comp").agg(F.count(F.lit(1)).alias("c"))
        most = by.groupBy("key", "n").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count(F.lit(1)).alias("comps")).filter(F.col("comps") > 1).drop("comps")
        return keep(_beside(g, most), "spanning")

    minor = F.col("comp") != F.col("main")
    for r in range(ROUNDS):
        # A pivot a group, a candidate a member: of its groups' pivots the first in an order of this round, so that members
        # of one family mostly meet the same pivot.
        g = spanning()
        if g.isEmpty():
            return labels
        turn = F.xxhash64("set_id", F.lit(r))
        pivot = g.filter(~minor).groupBy("key", "n").agg(F.min(F.struct(turn.alias("turn"), "set_id")).alias("p"))
        pairs = _beside(g.filter(minor), pivot).groupBy("set_id").agg(F.min("p").alias("p"))
        x = pairs.select(F.col("set_id").alias("a"), F.col("p.set_id").alias("b"))
        x = x.join(sets.select(F.col("set_id").alias("a"), F.col("members").alias("x"), F.col("sketch").alias("sx")), "a")
        x = x.join(sets.select(F.col("set_id").alias("b"), F.col("members").alias("y"), F.col("sketch").alias("sy")), "b").filter(_far(F.col("sx"), F.col("sy")) <= limit)
        both = F.size(F.array_intersect("x", "y")).cast("long")
        labels = merge(x.filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))
    # The rest: in each group that still spans components, the members outside its largest one against all, in blocks.
    g = spanning()
    if g.isEmpty():
        return labels
    sizes = g.groupBy("key", "n").agg(F.ceil(F.count_if(minor) / BLOCK).cast("int").alias("minors"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("alls"))
    g = _beside(g, sizes).select("key", "set_id", "comp", minor.alias("minor"), "minors", "alls", F.pmod(F.xxhash64("set_id"), F.col("minors")).cast("int").alias("mine"), F.pmod(F.xxhash64("set_id"), F.col("alls")).cast("int").alias("all"))
    outer = g.filter("minor").select("key", "set_id", "comp", F.lit(True).alias("left"), F.col("mine").alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"))
    inner = g.select("key", "set_id", "comp", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("minors") - 1)).alias("i"), F.col("all").alias("j"))
    return merge(_block_links(outer.unionByName(inner).join(sets, "set_id"), limit, percent))


def _labelled(slim: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """slim's rows (all columns but text, which are longs) with set_id and n_shingles, and the component of each linked class."""
    signed = stored(_signed(slim, k), "signed")
    labels = link_classes(signed, slim.select("doc_id", "text"), k, percent)
    rows = signed.drop("bands", "sketch")
    if labels is None:
        labels = rows.select("set_id", F.col("set_id").alias("comp")).limit(0)
    return rows, labels


def survivors(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_hash (xxhash64) of the row that stays of each component: least doc_id, nulls last, then least text_hash.
    Rows of an empty set all stay. A doc_id, null or not, that several rows have says nothing about which of them stays."""
    slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    rows, labels = _labelled(slim, words_per_shingle, percent)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    least = rows.filter(F.col("n_shingles") > 0).groupBy("set_id").agg(F.min(place).alias("first"))
    first = least.join(labels, "set_id", "left").groupBy(F.coalesce("comp", "set_id").alias("comp")).agg(F.min("first").alias("first"))
    empty = rows.filter(F.col("n_shingles") == 0).select("doc_id", "text_hash").distinct()
    return first.select("first.doc_id", "first.text_hash").unionByName(empty)


def near_duplicates(docs: DataFrame, words_per_shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows, labels = _labelled(slim, words_per_shingle, percent)
    # A class outside every group is its own component; component ids are taken from classes, not from all rows.
    reps = rows.filter(F.col("n_shingles") > 0).groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    named = reps.join(labels, "set_id", "left")
    linked = named.filter(F.col("comp").isNotNull())
    least = linked.groupBy("comp").agg(F.min("rep").alias("component_id"))
    alone = named.filter(F.col("comp").isNull()).select("set_id", F.col("rep").alias("component_id"))
    named = _by_component(linked, least, "inner").select("set_id", "component_id").unionByName(alone)
    out = rows.join(named, "set_id", "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
