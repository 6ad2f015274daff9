"""Katz backoff language model: Good-Turing discounted bigram counts with exactly normalised backoff weights.

  p(w | h) = d(c(h,w)) c(h,w) / (c(h) + RESERVE)    if the bigram was seen in training,
           = a(h) p(w)                              otherwise, a(h) = 1 if h was not seen;
  p(w)     = d(c(w)) c(w) / (N + RESERVE)           if the word was seen, else the mass that is left, for one unknown word;
  a(h)     = (1 - sum of p(w|h) over the words seen after h) / (1 - sum of their p(w)).

d are Katz's discounts for counts up to TOP, 1 above; RESERVE is a fraction of a count set aside in each context, so that
a context all of whose counts are large still leaves some mass. A text is led by a begin mark and closed by an end token.

Nothing is broadcast but figures of the whole and the hot words, of which there are at most 4 a partition:

  1. unigram counts, by ranges of the words' hashes: N, distinct words, counts of counts, hot words;
  2. bigrams, sent to their word's partition (those of a hot word spread by their history) with the documents they occur
     in. There counts meet, and each document's terms are summed as far as they are known; bigrams that were not seen go
     on to their history, and so do the sums that a history's backoff weight needs;
  3. histories: backoff weights, and with them the terms of the bigrams not seen;
  4. sums by document.

The model is written as tables partitioned by kind, a payload a bucket: counts of words, counts of bigrams, totals and backoff
weights of histories. KatzModel reads them back, and scores any texts from them alone. What a task keeps grows with the
records that reach it, not with the corpus's documents. Records travel packed (see exchange). Words are 48-bit hashes; log
terms travel as fixed point, 2**-32 apart.

Defined cases: null text is empty and has the end token alone; a null doc_id counts as an empty identifier and is returned;
repeated rows each count and are each returned; without training rows every token is the unknown word; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.arrays import U64, lower_ascii, mix64, slices, word_hashes, words
from weftline.llm.common import delete, partitions, pick, release, shared_dir
from weftline.llm.exchange import ROWS, at_keys, deal, differences, groups, pack, packed_rows, range_bucket, runs, unpack

BEGIN, END, FIRST_WORD = 0, 1, 2
#: Kinds of rows: documents, bigrams; then sums by document, histories' sums, bigrams not seen, sums of hot histories, counts of
#: counts, the tables of bigrams, of unigrams and of backoff weights.
DOCS, BIGRAMS, SUMS, HISTORIES, UNSEEN, HOT, COUNTS, TABLE, UNIGRAMS, WEIGHTS = range(10)
TOP, RESERVE = 5, 0.05
#: Text bytes whose n-grams are merged before they are sent.
BLOCK_BYTES = 12 << 20
_POINT, _SHARE = float(1 << 32), float(1 << 50)


@dataclass
class Block:
    """Tokens of some documents: word, history and document of each."""

    ids: pa.Array
    held: np.ndarray
    word: np.ndarray
    history: np.ndarray
    doc: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    held: list[tuple] = []
    size = docs = 0

    def flush() -> Block:
        ids, out, w, h, d = zip(*held)
        return Block(pa.concat_arrays(ids), np.concatenate(out), np.concatenate(w), np.concatenate(h), np.concatenate(d))

    for rows, data, off in slices(batches):
        low = lower_ascii(data)
        starts, ends, first = words(low, off)
        w = np.maximum(word_hashes(low, starts, ends) >> U64(16), U64(FIRST_WORD)) if len(starts) else np.zeros(0, U64)
        w = np.insert(w, first[1:], U64(END))
        n = np.diff(first) + 1
        h = np.empty_like(w)
        h[1:] = w[:-1]
        h[np.cumsum(n) - n] = BEGIN
        held.append((rows.column(0), rows.column(1).to_numpy(zero_copy_only=False), w, h, np.repeat(np.arange(docs, docs + len(n), dtype=np.int32), n)))
        size, docs = size + len(data), docs + len(n)
        if size >= limit:
            yield flush()
            held, size, docs = [], 0, 0
    if held:
        yield flush()


def home(block: int, n: int) -> int:
    """The partition at which a block's sums meet."""
    return int(mix64(np.array([block]))[0] % U64(n))


def discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d for counts 0 .. TOP from the numbers of types with count 0 .. TOP + 1: Katz's formula, or absolute discounting where
    the counts of counts are too irregular for it to give values in (0, 1]."""
    n = counts_of_counts.astype(float)
    d = np.ones(TOP + 1)
    if n[1]:
        common = (TOP + 1) * n[TOP + 1] / n[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            for r in range(1, TOP + 1):
                d[r] = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    for r in range(1, TOP + 1):
        if not (0 < d[r] <= 1):
            d[r] = (r - min(absolute, 0.9)) / r
    return d


@dataclass
class Figures:
    """Of the whole training corpus."""

    tokens: int
    types: int
    texts: int
    unigram: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    unknown: float = 1.0

    def share(self, count: np.ndarray) -> np.ndarray:
        """p(w) of words with these counts (0: the unknown word)."""
        p = self.unigram[np.minimum(count, TOP)] * count / (self.tokens + RESERVE)
        p = np.where(count > TOP, count / (self.tokens + RESERVE), p)
        return np.where(count > 0, p, self.unknown)


def _count_words(docs: DataFrame, n: int, path: str) -> Figures:
    """The table of unigrams, a row a bucket, and from it the figures: sums are made by Spark, the driver gets one row of them and
    the hot words, fewer than 4 n by what hot means."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            word, count = np.unique(b.word[~b.held[b.doc]], return_counts=True)
            yield packed_rows([(UNIGRAMS, k, 0, pack(differences(word[i:j]), count[i:j].astype(np.uint32))) for k, i, j in runs(range_bucket(word, n))])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(bucket, unpack(raw)) for b in batches for bucket, raw in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
        for bucket in sorted({k for k, _ in got}):
            word = np.concatenate([np.cumsum(x[0], dtype=U64) for k, x in got if k == bucket])
            count = np.concatenate([x[1] for k, x in got if k == bucket]).astype(np.int64)
            order = np.argsort(word)
            word, count = word[order], count[order]
            at = groups(word)
            yield packed_rows([(UNIGRAMS, bucket, 0, pack(differences(word[at]), np.add.reduceat(count, at)))])

    spark = docs.sparkSession
    deal(docs.mapInArrow(send, ROWS), n).mapInArrow(merge, ROWS).write.option("compression", "none").parquet(path)
    table = spark.read.schema(ROWS).parquet(path)
    sums = ["tokens", "types", *(f"n{r}" for r in range(TOP + 2))]

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(3).to_pylist():
                count = unpack(raw)[1]
                of = np.bincount(np.minimum(count, TOP + 2), minlength=TOP + 3)
                yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in (count.sum(), len(count), *of[: TOP + 2])], sums)

    got = table.mapInArrow(totals, ", ".join(f"{c} long" for c in sums)).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums)).first()
    tokens, types, of = got["tokens"], got["types"], np.array([got[f"n{r}"] for r in range(TOP + 2)], np.int64)

    def hottest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(3).to_pylist():
                steps, count = unpack(raw)
                keep = count * 4 * n > tokens
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(steps, dtype=U64)[keep].view(np.int64)), pa.array(count[keep])], ["word", "count"])

    hot = table.mapInArrow(hottest, "word long, count long").toArrow().sort_by("word")
    texts = docs.filter(~F.col("held_out")).count()
    figures = Figures(tokens, types, texts, discounts(of), hot.column(0).to_numpy().view(U64), hot.column(1).to_numpy())
    low = np.arange(1, TOP + 1)
    seen = float((of[1 : TOP + 1] * low * figures.unigram[1:]).sum()) + float(tokens - (of[1 : TOP + 1] * low).sum())
    figures.unknown = 1 - seen / (tokens + RESERVE)
    return figures


def _send_bigrams(docs: DataFrame, n: int, figures: Figures) -> DataFrame:
    hot = figures.hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task run again, after its executor is lost, names its blocks as before.
        part = TaskContext.get().partitionId()
        for i, b in enumerate(_blocks(batches)):
            block = (part << 32) + i
            tokens = np.bincount(b.doc, minlength=len(b.ids)).astype(np.int64)
            null = b.ids.is_null().to_numpy(zero_copy_only=False)
            out = [(DOCS, home(block, n), block, pack(b.ids.fill_null(0).to_numpy(), null.astype(np.uint8), b.held.astype(np.uint8), tokens))]
            order = np.lexsort((b.history, b.word))
            word, history, doc = b.word[order], b.history[order], b.doc[order]
            b.word = b.history = b.doc = order = None
            at = groups(word, history, doc)
            times = np.diff(np.append(at, len(word))).astype(np.uint32)
            word, history, doc = word[at], history[at], doc[at]
            pair = groups(word, history)
            where = range_bucket(word[pair], n)
            _, is_hot = at_keys(hot, word[pair])
            where[is_hot] = range_bucket(mix64(history[pair][is_hot] ^ (word[pair][is_hot] << U64(7))) >> U64(16), n)
            lists = np.diff(np.append(pair, len(word)))
            order = np.argsort(where, kind="stable")
            train = ~b.held
            for k, i, j in runs(where[order]):
                mine = order[i:j]
                take = np.repeat(pair[mine] - np.cumsum(lists[mine]) + lists[mine], lists[mine]) + np.arange(int(lists[mine].sum()))
                w = word[pair[mine]]
                run_at = groups(w)
                h = history[pair[mine]]
                out.append((BIGRAMS, k, block, pack(differences(w[run_at]), np.diff(np.append(run_at, len(w))).astype(np.uint32), (h >> U64(32)).astype(np.uint16), h.astype(np.uint32), lists[mine].astype(np.uint32), doc[take].astype(np.uint32), times[take], np.packbits(train[doc[take]]))))
            yield packed_rows(out)

    return docs.mapInArrow(run, ROWS)


def _meet(n: int, f: Figures):  # noqa: ANN202
    """Step 2 at a word's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, blocks = [], []
        for b in batches:
            through = b.filter(pa.compute.equal(b.column(0), DOCS))
            if through.num_rows:
                yield through
            for kind, block, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                if kind == BIGRAMS:
                    x = unpack(raw.as_buffer())
                    train = np.unpackbits(x[7], count=len(x[5])).astype(bool)
                    parts.append((np.repeat(np.cumsum(x[0], dtype=U64), x[1]), (x[2].astype(U64) << U64(32)) | x[3], x[4], x[6], train, np.repeat(np.int32(len(blocks)), len(x[5])), x[5]))
                    blocks.append(block)
        if not parts:
            return
        word, history, lists, times, train, block_of, doc_of = (np.concatenate([p[i] for p in parts]) for i in range(7))
        parts.clear()
        # Documents that are met here, by number: what is kept of them grows with the records, not with the corpus.
        met, doc = np.unique((block_of.astype(np.int64) << 32) | doc_of, return_inverse=True)
        doc = doc.astype(np.int32)
        first = np.searchsorted(met >> 32, np.arange(len(blocks) + 1))
        name = (met & 0xFFFFFFFF).astype(np.uint32)
        order = np.lexsort((history, word))
        kind = np.empty(len(order), np.int32)  # the type (distinct bigram) of each record
        at = groups(word[order], history[order])
        kind[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        word, history = word[order][at], history[order][at]
        of = np.repeat(kind, lists)
        del order, kind, lists
        count = np.bincount(of, np.where(train, times, 0), len(word)).astype(np.int64)
        w_at = groups(word)
        w_type = np.repeat(np.arange(len(w_at)), np.diff(np.append(w_at, len(word))))
        w_count = np.add.reduceat(count, w_at)
        k, is_hot = at_keys(f.hot, word[w_at])
        if len(f.hot):
            w_count = np.where(is_hot, f.hot_counts[k], w_count)
        own = w_count[w_type]
        # What each occurrence adds, as far as known here.
        with np.errstate(divide="ignore"):
            value = np.where(count > 0, np.log10(np.maximum(count, 1)), np.log10(np.maximum(f.share(own), 1e-300)))
        value -= np.where((own > 0) & (word != END), np.log10(own + RESERVE), 0)  # this word as the next token's history
        terms = [np.bincount(doc, x[of] * times, len(met)) for x in (value, np.log10(own + 1.0), (own > 0).astype(float))]
        small = [np.bincount(doc, np.where(count[of] == r, times, 0), len(met)) for r in range(1, TOP + 1)]
        out = []
        for i, block in enumerate(blocks):
            s = slice(first[i], first[i + 1])
            out.append((SUMS, home(block, n), block, pack(name[s], *(np.rint(x[s] * _POINT).astype(np.int64) for x in terms[:2]), terms[2][s].astype(np.uint32), *(x[s].astype(np.uint32) for x in small))))
        yield packed_rows(out)
        # Histories: what their backoff weights need of the types met here.
        seen = np.flatnonzero(count)
        share = np.rint(f.share(own[seen]) * _SHARE).astype(np.int64)
        order = np.argsort(history[seen], kind="stable")
        h, c, share = history[seen][order], count[seen][order], share[order]
        at = groups(h)
        if len(at):
            sums = [np.add.reduceat(x, at) for x in (c, share, *((c == r).astype(np.int64) for r in range(1, TOP + 1)))]
            h = h[at]
            _, is_hot = at_keys(f.hot, h)
            is_hot |= h == BEGIN
            for kind, mine in ((HOT, np.flatnonzero(is_hot)), (HISTORIES, np.flatnonzero(~is_hot))):
                yield packed_rows([(kind, k, 0, pack(differences(h[mine[i:j]]), *(x[mine[i:j]] for x in sums))) for k, i, j in runs(range_bucket(h[mine], n))])
        # Bigrams not seen: their histories, by block.
        unseen = np.flatnonzero(count[of] == 0)
        h, d, t = history[of[unseen]], doc[unseen], times[unseen]
        where = range_bucket(h, n)
        _, is_hot = at_keys(f.hot, h)
        is_hot |= h == BEGIN
        where[is_hot] = (mix64(met[d[is_hot]].view(U64)) % U64(n)).astype(np.int64)  # their weights are known everywhere
        order = np.lexsort((block_of[unseen], h, where))
        h, d, t, where, b_of = h[order], name[d[order]], t[order], where[order], block_of[unseen][order]
        named = np.array(blocks, np.int64)
        rows = []
        for k, i, j in runs(where):
            mine, b_at = np.unique(b_of[i:j], return_inverse=True)
            rows.append((UNSEEN, k, 0, pack(named[mine], differences(h[i:j]), b_at.astype(np.uint32), d[i:j], t[i:j].astype(np.uint32))))
        yield packed_rows(rows)
        yield packed_rows([(COUNTS, 0, 0, pack(np.bincount(np.minimum(count, TOP + 2), minlength=TOP + 3)))])  # one small row a partition
        w, run_at = word[seen], groups(word[seen])
        yield packed_rows([(TABLE, 0, 0, pack(differences(w[run_at]), np.diff(np.append(run_at, len(w))).astype(np.uint32), (history[seen] >> U64(32)).astype(np.uint16), history[seen].astype(np.uint32), count[seen].astype(np.uint32)))])

    return run


def _weights(sums: list[np.ndarray], d: np.ndarray) -> np.ndarray:
    """log10 of a(h) (c(h) + RESERVE): the second factor takes back what step 2 took off for a history."""
    total, share, small = sums[0], sums[1] / _SHARE, sums[2:]
    kept = total - sum((r * (1 - d[r])) * x for r, x in enumerate(small, 1))
    left = (1 - kept / (total + RESERVE)) / np.maximum(1 - share, 1e-12)
    return np.log10(left) + np.log10(total + RESERVE)


def _back_off(n: int, f: Figures, hot: np.ndarray, hot_weights: np.ndarray, d: np.ndarray):  # noqa: ANN202
    """Step 3 at a history's partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asked = [], []
        for b in batches:
            for kind, raw in zip(b.column(0).to_pylist(), b.column(3)):
                x = unpack(raw.as_buffer())
                if kind == HISTORIES:
                    known.append((np.cumsum(x[0], dtype=U64), x[1:]))
                else:
                    asked.append((x[0], np.cumsum(x[1], dtype=U64), *x[2:]))
        h, weight = np.zeros(0, U64), np.zeros(0)
        if known:
            h = np.concatenate([k[0] for k in known])
            order = np.argsort(h, kind="stable")
            h = h[order]
            at = groups(h)
            weight = _weights([np.add.reduceat(np.concatenate([k[1][i] for k in known])[order], at) for i in range(TOP + 2)], d)
            h = h[at]
            yield packed_rows([(WEIGHTS, 0, 0, pack(differences(h), weight, np.add.reduceat(np.concatenate([k[1][0] for k in known])[order], at)))])
        out: dict[int, list] = {}
        for named, keys, of, doc, times in asked:
            value = np.zeros(len(keys))
            for table, w in ((h, weight), (hot, hot_weights)):
                at, there = at_keys(table, keys)
                if len(table):
                    value += np.where(there, w[at], 0)
            order = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[order], np.arange(len(named) + 1))
            for block, i, j in zip(named.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
                if j > i:
                    out.setdefault(block, []).append((doc[order[i:j]], (value * times)[order[i:j]]))
        rows = []
        for block, got in out.items():
            doc, value = (np.concatenate([g[i] for g in got]) for i in (0, 1))
            has, at = np.unique(doc, return_inverse=True)
            nothing = np.zeros(len(has), np.int64)
            rows.append((SUMS, home(block, n), block, pack(has.astype(np.uint32), np.rint(np.bincount(at, value) * _POINT).astype(np.int64), nothing, *[nothing.astype(np.uint32)] * (TOP + 1))))
        yield packed_rows(rows)

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _finish(f: Figures, d: np.ndarray):  # noqa: ANN202
    small = np.log10(d[1:])
    begin = np.log10(f.texts + RESERVE) if f.texts else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[int, list] = {}
        sums: dict[int, list] = {}
        for b in batches:
            for kind, block, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                x = unpack(raw.as_buffer())
                if kind == DOCS:
                    docs[block] = x
                    continue
                if block not in sums:
                    sums[block] = []
                sums[block].append(x)
        for block, (ids, null, held, tokens) in docs.items():
            value, base, known = (np.zeros(len(ids), np.int64) for _ in range(3))
            score = np.full(len(ids), -begin)
            for x in sums.get(block, ()):
                value[x[0]] += x[1]
                base[x[0]] += x[2]
                known[x[0]] += x[3]
                for r in range(TOP):
                    score[x[0]] += small[r] * x[4 + r]
            score += value / _POINT
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(held.astype(bool)), pa.array(tokens), pa.array(known), pa.array(np.full(len(ids), f.tokens)), pa.array(base / _POINT - tokens * np.log10(f.tokens + f.types + 1.0)), pa.array(score)],
                [c.split()[0] for c in _OUT.split(", ")],
            )

    return run


@dataclass
class KatzModel:
    """A trained model: tables in folders by kind below path, a row a bucket (see unpack), and the figures of the whole."""

    path: str
    figures: Figures
    bigram: np.ndarray
    #: Histories whose weights are known everywhere: keys, log10 of a(h) (c(h) + RESERVE), c(h).
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]

    def _rows(self, spark: SparkSession, kind: int) -> DataFrame:
        return spark.read.schema(ROWS).parquet(f"{self.path}/kind={kind}")

    def unigrams(self, spark: SparkSession) -> DataFrame:
        """word (its hash), log_p."""
        f = self.figures

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw in (r for b in batches for r in b.column(3).to_pylist()):
                steps, count = unpack(raw)
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(steps, dtype=U64).view(np.int64)), pa.array(np.log10(f.share(count)))], ["word", "log_p"])

        return self._rows(spark, UNIGRAMS).mapInArrow(run, "word long, log_p double")

    def histories(self, spark: SparkSession) -> DataFrame:
        """history, log_total (of c(h) + RESERVE), log_a (its backoff weight)."""
        keys, weight, total = self.hot

        def arrays(h: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            log_total = np.log10(c + RESERVE)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(log_total), pa.array(w - log_total)], ["history", "log_total", "log_a"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw in (r for b in batches for r in b.column(3).to_pylist()):
                steps, w, c = unpack(raw)
                yield arrays(np.cumsum(steps, dtype=U64), w, c)

        known = spark.createDataFrame(pa.Table.from_batches([arrays(keys, weight, total)]))
        return self._rows(spark, WEIGHTS).mapInArrow(run, "history long, log_total double, log_a double").unionByName(known)

    def bigrams(self, spark: SparkSession) -> DataFrame:
        """word, history, log_c: log10 of the discounted count."""
        d = self.bigram

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for raw in (r for b in batches for r in b.column(3).to_pylist()):
                steps, lengths, high, low, count = unpack(raw)
                word, history = np.repeat(np.cumsum(steps, dtype=U64), lengths), (high.astype(U64) << U64(32)) | low
                c = count.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(history.view(np.int64)), pa.array(np.log10(c * np.where(c > TOP, 1.0, d[np.minimum(c, TOP)])))], ["word", "history", "log_c"])

        return self._rows(spark, TABLE).mapInArrow(run, "word long, history long, log_c double")

    def score(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_tokens, score of docs (doc_id long, text), from the tables alone: each token's bigram if it is there, else its
        history's weight and the word's own probability, else the unknown word's. Equal bigrams of a row are one record."""
        spark = docs.sparkSession

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            for i, b in enumerate(_blocks(batches)):
                order = np.lexsort((b.word, b.history, b.doc))
                doc, history, word = b.doc[order], b.history[order], b.word[order]
                at = groups(doc, history, word)
                times = np.diff(np.append(at, len(doc)))
                row = (np.int64(part) << 40) + (np.int64(i) << 24) + doc[at]
                yield pa.RecordBatch.from_arrays([pa.array(row), b.ids.take(pa.array(doc[at])), pa.array(history[at].view(np.int64)), pa.array(word[at].view(np.int64)), pa.array(times.astype(np.int64))], ["row", "doc_id", "history", "word", "times"])

        slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.lit(True).alias("held_out"), "text")
        x = slim.mapInArrow(tokens, "row long, doc_id long, history long, word long, times long")
        x = x.join(self.bigrams(spark), ["word", "history"], "left").join(self.unigrams(spark), "word", "left").join(self.histories(spark), "history", "left")
        own = F.coalesce("log_p", F.lit(float(np.log10(self.figures.unknown))))
        log = F.when(F.col("log_c").isNotNull(), F.col("log_c") - F.col("log_total")).otherwise(F.coalesce("log_a", F.lit(0.0)) + own)
        return x.groupBy("row", "doc_id").agg(F.sum("times").alias("n_tokens"), F.sum(log * F.col("times")).alias("score")).drop("row")


def train_and_score(docs: DataFrame) -> tuple[DataFrame, KatzModel]:
    """docs: doc_id long, held_out boolean, text. Learns from the rows that are not held out, scores all (see _OUT)."""
    spark, n = docs.sparkSession, partitions(docs)
    path = f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    figures = _count_words(docs, n, f"{path}/kind={UNIGRAMS}")
    release(spark)
    met = deal(_send_bigrams(docs, n, figures), n).mapInArrow(_meet(n, figures), ROWS)
    met.write.partitionBy("kind").mode("append").option("compression", "none").parquet(path)
    release(spark)
    rows = lambda *kinds: [spark.read.schema(ROWS).parquet(f"{path}/kind={k}").withColumn("kind", F.lit(k)) for k in kinds if _exists(spark, f"{path}/kind={k}")]
    union = lambda parts: reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ROWS)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = np.zeros(TOP + 3, np.int64)
        for b in batches:
            for raw in b.column(3).to_pylist():
                of += unpack(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in of], [f"n{r}" for r in range(TOP + 3)])

    names = [f"n{r}" for r in range(TOP + 3)]
    of = union(rows(COUNTS)).mapInArrow(counts, ", ".join(f"{c} long" for c in names)).agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in names)).first()
    d = discounts(np.array(of, np.int64)[: TOP + 2])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [unpack(raw) for b in batches for raw in b.column(3).to_pylist()]
        if got:
            h = np.concatenate([np.cumsum(x[0], dtype=U64) for x in got])
            order = np.argsort(h, kind="stable")
            at = groups(h[order])
            sums = [np.add.reduceat(np.concatenate([x[i] for x in got])[order], at) for i in range(1, TOP + 3)]
            yield pa.RecordBatch.from_arrays([pa.array(h[order][at].view(np.int64)), *map(pa.array, sums)], ["history", *(f"s{i}" for i in range(TOP + 2))])

    # At most 4 n + 1 histories, each added up where its hash sends it.
    held = deal(union(rows(HOT)), n).mapInArrow(together, "history long, " + ", ".join(f"s{i} long" for i in range(TOP + 2))).toArrow().sort_by("history")
    keys = held.column(0).to_numpy().view(U64)
    sums = [held.column(i + 1).to_numpy() for i in range(TOP + 2)]
    weights = _weights(sums, d) if len(keys) else np.zeros(0)
    late = deal(union(rows(HISTORIES, UNSEEN)), n).mapInArrow(_back_off(n, figures, keys, weights, d), ROWS)
    late.write.partitionBy("kind").mode("append").option("compression", "none").parquet(path)
    for kind in (HISTORIES, UNSEEN, HOT, COUNTS):  # what they say is in the weights, the sums and the figures now
        delete(spark, f"{path}/kind={kind}")
    scores = deal(union(rows(DOCS, SUMS)), n).mapInArrow(_finish(figures, d), _OUT)
    return scores, KatzModel(path, figures, d, (keys, weights, sums[0]))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def score_documents(docs: DataFrame) -> DataFrame:
    """The scores alone."""
    return train_and_score(docs)[0]


def score_corpus(docs: DataFrame, modulus: int = 7, rest: int = 2) -> DataFrame:
    """Scores of all rows; those whose crc32(doc_id as text) leaves `rest` are held out of training."""
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    slim = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), (crc % modulus == rest).alias("held_out"), "text")
    return score_documents(slim)
