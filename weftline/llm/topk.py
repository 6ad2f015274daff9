"""Exact top-k search by aggregation without random access (NRA), in blocks.

Vectors are dealt into blocks; each block holds, for each dimension, its values as a sorted list. For a query the lists are
read from the end that its sign asks for, all to the same depth. An entry that has been read is exact; one that has not
lies between the list's far end and the value at which reading stands. So every vector has a lower and an upper bound,
and both are sums over dimensions of query component times a clipped value: for all queries and vectors of a block two
matrix products each. Vectors whose upper bound lies below a query's k-th lower bound are no candidates of it any more. A
query is read deeper, pause by pause, until its candidates are k or all is read; then more than k are ties. Scores that
are answered are those candidates' entries added up. Blocks answer on their own; the k best of a query over all blocks are
merged.

Integers are exact in float32 (float64) as long as dimensions * max|x|**2 stays below 2**24 (2**53), which is checked.

Defined cases: a vector that is null, empty, or holds null or non-finite components takes no part, as query or candidate; so
does a null vec_id; vectors of unequal length have no score with each other; of rows that repeat a vec_id, each asks, and is
a candidate of all rows but itself; ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table
gives none; further columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import pick, stored
from weftline.llm.exchange import deal, pack, unpack

#: Rows a block, queries handled against a block at once, parts of the lists' length at which reading pauses.
BLOCK_ROWS, QUERY_ROWS, DEPTHS = 8192, 256, (0.6, 0.75, 0.85, 0.92, 0.96, 0.98, 1.0)


def quantise(v: Column, scale: int = 256) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def block_lists(x: np.ndarray) -> np.ndarray:
    """Each dimension's values in ascending order: the block's sorted lists."""
    return np.sort(x, axis=0)


def candidates(x: np.ndarray, names: np.ndarray, lists: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are left to each query when it stops reading (queries x rows), and the pauses it has read up to.

    x: rows x dimensions, lists: block_lists(x), q: queries x dimensions, names of the rows, own: those of the queries' own rows.
    """
    n = len(x)
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    alive = names[None, :] != own[:, None]
    pauses = np.zeros(len(q), int)
    for part in DEPTHS:
        reads = np.flatnonzero(alive.sum(axis=1) > k)  # the stop test
        if not len(reads):
            break
        pauses[reads] += 1
        depth = min(max(int(n * part), 1), n)
        rows = np.flatnonzero(alive[reads].any(axis=0))
        y, mine = x[rows], alive[np.ix_(reads, rows)]
        top, bottom = lists[n - depth], lists[depth - 1]  # where reading stands, from either end
        high = up[reads] @ np.maximum(y, top).T + down[reads] @ np.minimum(y, bottom).T
        low = up[reads] @ np.where(y >= top, y, lists[0]).T + down[reads] @ np.where(y <= bottom, y, lists[-1]).T
        low[~mine] = -np.inf
        kth = np.partition(low, len(rows) - k, axis=1)[:, len(rows) - k]
        alive[np.ix_(reads, rows)] = mine & (high >= kth[:, None])
    return alive, pauses


def nra(x: np.ndarray, ids: np.ndarray, names: np.ndarray, lists: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each query row: the block's k best by (score descending, id), its own row left out."""
    alive, _ = candidates(x, names, lists, q, own, k)
    for i in range(len(q)):
        left = np.flatnonzero(alive[i])
        score = x[left] @ q[i]  # k rows, or ties
        best = np.lexsort((ids[left], -score))[:k]
        yield i, np.stack((ids[left[best]], score[best].astype(np.int64)))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score. Both frames: vec_id long, row long (a row's own name, the same in both), v array<long>
    (quantised, usable).

    Both sides are packed in blocks of one length of vectors; each block of queries goes to every block of vectors, by the
    block's number, so what is sent is the queries times the number of blocks and never a row a pair.
    """
    spark = vectors.sparkSession
    size = F.size("v").alias("d")
    span = F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("span")
    asks = queries.groupBy(size).agg(F.count(F.lit(1)).alias("asks"))
    lengths = vectors.groupBy(size).agg(F.count(F.lit(1)).alias("n"), span).join(asks, "d").orderBy("d").collect()  # one row a length of vectors
    schema = "query_id long, rank int, vec_id long, score long"
    if not lengths:
        return spark.createDataFrame([], schema)
    kinds: dict[int, type] = {}
    plan, blocks = [], 0
    for r in lengths:
        most = r["d"] * int(r["span"]) ** 2
        if most >= 1 << 53:
            raise ValueError("components too large for exact sums in float64")
        kinds[r["d"]] = np.float32 if most < 1 << 24 else np.float64
        own = max(1, -(-r["n"] // BLOCK_ROWS))
        plan.append((r["d"], blocks, own, max(1, -(-r["asks"] // QUERY_ROWS))))
        blocks += own
    plan_rows = F.broadcast(spark.createDataFrame(plan, "d int, base int, blocks int, lots int"))  # one row a length of vectors

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lot, length = b.column(0).to_numpy(), b.column(1).to_numpy()
            ids, names = b.column(2).to_numpy(), b.column(3).to_numpy()
            out = []
            for d in np.unique(length).tolist():
                of_d = np.flatnonzero(length == d)
                x = b.column(4).take(pa.array(of_d)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)
                for j in np.unique(lot[of_d]).tolist():
                    mine = lot[of_d] == j
                    out.append((j, d, pack(ids[of_d[mine]], names[of_d[mine]], x[mine].reshape(-1))))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())], ["lot", "d", "payload"])

    def dealt(df: DataFrame, parts: str) -> DataFrame:
        x = df.select(size, "vec_id", "row", "v").join(plan_rows, "d")
        lot = F.pmod(F.xxhash64("vec_id", "row"), F.col(parts)).cast("int")
        return x.select(lot.alias("lot"), "d", "vec_id", "row", "v").mapInArrow(packed, "lot int, d int, payload binary").join(plan_rows, "d")

    # Queries: one row a (lot of queries, slice of input), sent to each block. Vectors: to their block.
    block_of = F.explode(F.sequence(F.col("base"), F.col("base") + F.col("blocks") - 1)).alias("block")
    asked = dealt(queries, "lots").select(block_of, F.lit(True).alias("asks"), "d", "payload")
    held = dealt(vectors, "blocks").select((F.col("base") + F.col("lot")).alias("block"), F.lit(False).alias("asks"), "d", "payload")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[tuple[int, int], tuple[list, list]] = {}
        for b in batches:
            for block, asks, d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                mine.setdefault((block, d), ([], []))[asks].append(unpack(raw.as_buffer()))
        for (_, d), (vs, qs) in mine.items():
            if not vs or not qs:
                continue
            (ids, names, x), (asked_ids, own, q) = ([np.concatenate([part[i] for part in side]) for i in range(3)] for side in (vs, qs))
            x, q = x.reshape(-1, d).astype(kinds[d]), q.reshape(-1, d).astype(kinds[d])
            lists = block_lists(x)
            for at in range(0, len(own), QUERY_ROWS):
                part = slice(at, at + QUERY_ROWS)
                found = list(nra(x, ids, names, lists, q[part], own[part], k))
                who = np.repeat(at + np.array([i for i, _ in found], np.int64), [f.shape[1] for _, f in found])
                both = np.concatenate([f for _, f in found], axis=1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (asked_ids[who], own[who], both[0], both[1])], ["query_id", "row", "vec_id", "score"])

    near = deal(asked.unionByName(held), blocks, "block").mapInArrow(search, "query_id long, row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best for each usable row whose vec_id is divisible by `every`, against all other usable rows."""
    slim = pick(embeddings, "vec_id", "embedding").filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = stored(slim.select(F.col("vec_id").cast("long"), F.monotonically_increasing_id().alias("row"), quantise(F.col("embedding")).alias("v")), "vectors")
    return top_k(vectors.filter(F.col("vec_id") % every == 0), vectors, k)
