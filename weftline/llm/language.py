"""Language identification by interpolated Kneser-Ney character models, one a language.

A model keeps, for each order, sorted arrays of n-gram keys with discounted shares and of context keys with the weight left
to the next lower order; keys are the symbols' ids in mixed radix, a hash without collisions. A text goes to the language
of lowest cross-entropy a symbol. Shares of languages are scaled by a temperature, and a text is rejected whose
cross-entropy lies beyond what its language's own calibration texts reach; both are fitted on texts apart from those
that the models count.

The models are fitted on a bounded sample of labelled rows: of each language its distinct texts of least hash, SAMPLE_CHARS
characters in all and LONGEST_SAMPLE of a text, and TOTAL_CHARS over all languages together; the identifier goes to every task
and is halved until it takes no more than MODEL_BYTES. Each language has a text in the sample, so each can be predicted.
Everything else runs over all rows and whole texts.

Defined cases: null text, or one without a letter, is `und` with score 0 and rejected; null languages teach nothing;
a null doc_id counts as an empty identifier; repeated rows are rows of their own and teach once; without any labelled text
that has a letter all texts are `und` with score 0 and none is rejected, since nothing was learned to judge by; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.arrays import slices
from weftline.llm.common import pick

#: Characters of the sample a language, and of all; characters taken of one text; bytes of an identifier.
SAMPLE_CHARS, TOTAL_CHARS, LONGEST_SAMPLE, MODEL_BYTES = 1_200_000, 48_000_000, 60_000, 64 << 20
ORDER, MOST_SYMBOLS = 4, 4000
#: Languages whose shares (a name and two numbers each) are broadcast.
MOST_BROADCAST = 1 << 16
UNDETERMINED = "und"
#: Largest product of symbols for which n-grams index a table directly, and n-grams after which a worker's table starts anew.
DIRECT, MOST_KNOWN = 1 << 24, 1 << 20


@lru_cache(1)
def _folded() -> np.ndarray:
    """Lower-case letter (or mark) of each code point, 0 for what is neither."""
    out = np.zeros(sys.maxunicode + 1, np.int32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.category(c)[0] in "LM":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of all texts, every run of others as one 0, each text led by one 0; n + 1 offsets."""
    whole = data.tobytes().decode("utf-8", "replace")
    cps = _folded()[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[off] if len(data) else np.zeros(len(off), np.int64)
    cps = np.insert(cps, chars[:-1], 0)
    begin = chars + np.arange(len(chars))
    keep = np.ones(len(cps), bool)
    keep[1:] = (cps[1:] != 0) | (cps[:-1] != 0)
    keep[begin[:-1]] = True
    upto = np.concatenate(([0], np.cumsum(keep)))
    return cps[keep], upto[begin]


@dataclass
class LanguageModel:
    """Interpolated Kneser-Ney over symbol ids 0 .. base - 1."""

    base: int
    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def fit(cls, keys: np.ndarray, base: int) -> LanguageModel:
        """keys: all n-grams of the highest order, as numbers in mixed radix."""
        model = cls(base)
        found = [np.unique(keys, return_counts=True)]
        for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct symbols to their left
            found.insert(0, np.unique(found[0][0] % base**k, return_counts=True))
        for gram, count in found:
            n1, n2 = int((count == 1).sum()), int((count == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            held, where, kinds = np.unique(gram // base, return_index=True, return_counts=True)
            total = np.add.reduceat(count, where) if len(count) else count
            model.grams.append((gram, (count - discount) / np.repeat(total, kinds)))
            model.contexts.append((held, discount * kinds / total))
        return model

    def log_shares(self, keys: np.ndarray) -> np.ndarray:
        """Natural log of the share of each key's last symbol after those before it."""
        p = np.full(len(keys), 1 / self.base)
        for k, ((gram, share), (held, weight)) in enumerate(zip(self.grams, self.contexts), 1):
            if not len(gram):
                continue
            own = keys % self.base**k
            at = np.minimum(np.searchsorted(held, own // self.base), len(held) - 1)
            known = held[at] == own // self.base
            p = np.where(known, weight[at] * p, p)
            at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
            p += np.where(known & (gram[at] == own), share[at], 0.0)
        return np.log(p)


@dataclass
class Identifier:
    languages: list[str]
    alphabet: np.ndarray
    models: list[LanguageModel]
    temperature: float = 8.0
    limits: np.ndarray | None = None

    @property
    def base(self) -> int:
        return len(self.alphabet) + 2  # none of the letters, the letters, any other letter

    def keys(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Highest-order n-grams of every text from its second symbol on, n + 1 offsets, letters a text."""
        sym, at = symbols(data, off)
        if len(self.alphabet):
            k = np.minimum(np.searchsorted(self.alphabet, sym), len(self.alphabet) - 1)
            ids = np.where(sym == 0, 0, np.where(self.alphabet[k] == sym, k + 1, self.base - 1)).astype(np.int64)
        else:
            ids = np.where(sym == 0, 0, self.base - 1).astype(np.int64)
        # Each text gets ORDER - 2 more leading zeros, so that no n-gram reaches into the text before.
        pad = ORDER - 2
        ids = np.insert(ids, np.repeat(at[:-1], pad), 0)
        at = at + pad * np.arange(len(at))
        key = np.zeros(max(len(ids) - ORDER + 1, 0), np.int64)
        for j in range(ORDER):
            key = key * self.base + ids[j : j + len(key)]
        keep = np.ones(len(key), bool)
        for j in range(ORDER - 1):  # those that end among a text's leading zeros
            x = at[1:-1] - 1 - j
            keep[x[(x >= 0) & (x < len(key))]] = False
        upto = np.concatenate(([0], np.cumsum(keep)))
        letters = np.concatenate(([0], np.cumsum(ids != 0)))[at]
        return key[keep], upto[np.minimum(np.maximum(at - np.where(np.arange(len(at)) > 0, ORDER - 1, 0), 0), len(key))], np.diff(letters)

    def entropies(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a symbol (texts x languages) and the letters of each text."""
        key, upto, letters = self.keys(data, off)
        n = np.diff(upto)
        if not len(self.models) or not len(key):
            return np.zeros((len(letters), len(self.models))), letters
        slot = self._slots(key)
        text = np.repeat(np.arange(len(n)), n)
        out = np.empty((len(n), len(self.models)))
        for j in range(len(self.models)):
            out[:, j] = -np.bincount(text, self.__dict__["_table"][j][slot], len(n)) / np.maximum(n, 1)
        return out, letters

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Places of keys in the table of log shares, which grows by the keys not met before (all, where keys are too many to index)."""
        own = self.__dict__
        if self.base**ORDER > DIRECT:
            distinct, back = np.unique(key, return_inverse=True)
            own["_table"] = [m.log_shares(distinct) for m in self.models]
            return back
        if "_slot" not in own or len(own["_table"][0]) > MOST_KNOWN:
            own["_slot"], own["_table"] = np.full(self.base**ORDER, -1, np.int32), [np.zeros(0)] * len(self.models)
        slot = own["_slot"][key]
        if (slot < 0).any():
            new = np.unique(key[slot < 0])
            own["_slot"][new] = len(own["_table"][0]) + np.arange(len(new), dtype=np.int32)
            own["_table"] = [np.concatenate((t, m.log_shares(new))) for t, m in zip(own["_table"], self.models)]
            slot = own["_slot"][key]
        return slot

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def shares(self, entropies: np.ndarray) -> np.ndarray:
        x = -self.temperature * entropies
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def rejected(self, best: np.ndarray, entropy: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Beyond the limit of its language; short texts get room in proportion to their spread."""
        return (letters == 0) | (entropy > self.limits[best] + 6 / np.sqrt(np.maximum(letters, 1)))


def _bytes(who: Identifier) -> int:
    return sum(x.nbytes for m in who.models for pair in (*m.grams, *m.contexts) for x in pair)


def _buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def fit_identifier(texts: list[str], languages: list[str]) -> Identifier:
    """Models on four of five texts of each language, calibration on the fifth."""
    who = [bool(symbols(*_buffers([t]))[0].any()) for t in texts]
    texts, languages = [t for t, ok in zip(texts, who) if ok], [x for x, ok in zip(languages, who) if ok]
    names = sorted(set(languages))
    fit: dict[str, list[str]] = {x: [] for x in names}
    tune: list[tuple[str, str]] = []
    seen = dict.fromkeys(names, 0)
    for t, x in zip(texts, languages):
        seen[x] += 1
        if seen[x] % 5 == 0:
            tune.append((t, x))
        else:
            fit[x].append(t)
    found = [symbols(*_buffers(fit[x]))[0] for x in names]
    kinds, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, int))
    kinds, count = kinds[kinds > 0], count[kinds > 0]
    alphabet = np.sort(kinds[np.argsort(-count, kind="stable")[:MOST_SYMBOLS]])
    who = Identifier(names, alphabet, [])
    who.models = [LanguageModel.fit(who.keys(*_buffers(fit[x]))[0], who.base) for x in names]
    who.limits = np.full(len(names), np.inf)
    if tune and names:
        e, letters = who.entropies(*_buffers([t for t, _ in tune]))
        y = np.array([names.index(x) for _, x in tune])
        ok = letters > 0
        e, y = e[ok], y[ok]
        if len(y):
            losses = []
            for t in (1, 2, 4, 8, 16, 32):
                who.temperature = float(t)
                losses.append((-np.log(who.shares(e)[np.arange(len(y)), y] + 1e-9).mean(), t))
            who.temperature = float(min(losses)[1])
            for k in range(len(names)):
                own = e[y == k, k]
                if len(own):  # the worst of the calibration texts, and a margin
                    who.limits[k] = own.max() + 0.5
    return who


def held_out(doc_id: Column, modulus: int = 3, rest: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == rest


def _sample(labelled: DataFrame) -> list[tuple[str, str]]:
    """(lang, text) of the bounded sample that the module names: within a language, distinct texts in the order of their hash."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.substring("text", 1, LONGEST_SAMPLE).alias("text"))
    rows = rows.withColumn("order", F.xxhash64("text"))
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.min("order").alias("first")).collect()  # one row a language
    most = min(SAMPLE_CHARS, TOTAL_CHARS // max(len(sizes), 1))
    # The draw goes by the text's hash, so copies are drawn together and merged: four times what is wanted, then cut exactly. A
    # language's text of least hash is in the sample whatever the draw gives.
    share = [(r["lang"], min(1.0, 4 * most / max(r["chars"], 1)) * (1 << 20), r["first"]) for r in sizes]
    shares = rows.sparkSession.createDataFrame(share, "name string, share double, first long")
    if len(share) <= MOST_BROADCAST:  # else the planner decides
        shares = F.broadcast(shares)
    drawn = rows.join(shares, F.col("lang") == F.col("name"))
    drawn = drawn.filter((F.pmod("order", F.lit(1 << 20)) < F.col("share")) | (F.col("order") == F.col("first"))).groupBy("lang", "order", "first", "text").agg(F.count(F.lit(1)).alias("copies"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("order", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = drawn.withColumn("upto", upto).filter((F.col("upto") <= most) | (F.col("order") == F.col("first"))).select("lang", "order", "text").collect()
    return [(r["lang"], r["text"]) for r in sorted(chosen)]


def train_identifier(labelled: DataFrame) -> Identifier:
    """labelled: doc_id, text, lang. Collects the bounded sample that the module names."""
    sample = _sample(labelled) if not labelled.isEmpty() else []
    while True:
        who = fit_identifier([t for _, t in sample], [x for x, _ in sample])
        if _bytes(who) <= MODEL_BYTES:
            return who
        place, half = 0, []
        for i, (lang, text) in enumerate(sample):  # every other text of each language, the first always
            place = 0 if not i or sample[i - 1][0] != lang else place + 1
            if place % 2 == 0:
                half.append((lang, text))
        if len(half) == len(sample):
            raise ValueError(f"{len(who.languages)} languages make an identifier of {_bytes(who)} bytes")
        sample = half


def identify(docs: DataFrame, who: Identifier, text: str = "text") -> DataFrame:
    """docs with lang_pred, score, rejected appended; every other column passes through."""
    names = np.array([*who.languages, UNDETERMINED], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in slices(batches, text):
            e, letters = who.entropies(data, off)
            none = letters == 0
            if len(who.languages):
                best = e.argmin(axis=1)
                score = who.shares(e).max(axis=1)
                out = who.rejected(best, e[np.arange(len(e)), best], letters)
                best = np.where(none, len(who.languages), best)
            else:
                best, score, out = np.zeros(len(e), int), np.zeros(len(e)), np.zeros(len(e), bool)
            score = np.where(none, 0.0, score)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(out)], [*rows.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema + ", lang_pred string, score double, rejected boolean")


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learns from the labelled rows that are not held out."""
    slim = pick(docs, "doc_id", "text", "lang")
    who = train_identifier(slim.filter(~held_out(F.col("doc_id"))))
    found = identify(slim.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), who)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
