"""Plain versions of what the operators compute, and a table with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, Key string, TEXT int"
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def rows(seed=3, n=60):
    """Ids, texts, languages, sources: copies, near copies, shared passages, nulls, empties, a very long text, repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(90)] + ["The", "THE", "the", ".", "it's"]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = " ".join(words(60))
    texts = [" ".join(words(rng.randint(1, 120))) for _ in range(n - 24)]
    texts += [texts[0]] * 4 + [texts[1].upper()]
    near = words(80)
    texts += [" ".join(near[:i] + ["x"] + near[i + 1 :]) for i in range(0, 50, 10)]
    texts += [f"{' '.join(words(9))}\n\n{passage}\n{' '.join(words(5))}" for _ in range(4)]
    texts += [None, "", " \t\n ", "one", "ONE two", "日本語 テキスト 😀", "a" * 700, "ab " * 300, " ".join(words(3000)), "12 34 !!"]
    out = [(i * 3 % 179, t, rng.choice(["en", "fr", None]), rng.choice(["b", "a", "hot", "hot", None]), 0) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, "a row without a name", "en", "a", None), (None, None, None, None, None)]
    return [(*r, "s", "k", 1) for r in out]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(doc_id):
    return zlib.crc32((str(doc_id) if doc_id is not None else "").encode())


def order(r):
    """Documents by id, null last, then by what is in them (repeated ids have equal texts here)."""
    return (r[0] is None, r[0] or 0, r[1] or "")


def shingle_set(text, k):
    w = words((text or "").translate(ASCII_LOWER))
    return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else ({tuple(w)} if w else set())


def near_components(data, k, percent=80):
    """(doc_id, set size, component) of each row, by all pairs."""
    sets = [shingle_set(r[1], k) for r in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return [(r[0], len(sets[i]), (min(least[find(i)]) if least[find(i)] else None) if sets[i] else r[0]) for i, r in enumerate(data)]


def byte_repeats(data, length, digest=lambda b: hashlib.sha256(b).hexdigest()):
    """(doc_id, bytes, removed, spans, sha256 or another digest) of each row."""
    raw = [(r[1] or "").encode() for r in data]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(data, raw):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(t), sum(gone), spans, digest(bytes(b for b, g in zip(t, gone) if not g))))
    return out


def later_byte_repeats(data, length):
    """(text without all but the first of equal strings, bytes removed) of each row, in the order of data."""
    seen, out = set(), {}
    for k in sorted(range(len(data)), key=lambda k: order(data[k])):
        t = (data[k][1] or "").encode()
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if t[i : i + length] in seen:
                gone[i : i + length] = [True] * length
            seen.add(t[i : i + length])
        out[k] = (bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore"), sum(gone))
    return [out[k] for k in range(len(data))]


def word_repeats(data, length):
    """(doc_id, words, removed, sha256) of each row."""
    seen, out = set(), []
    for r in sorted(data, key=order):
        w = words(r[1])
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if key in seen:
                gone[i : i + length] = [True] * length
            seen.add(key)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def katz_model(data, discounts, top, reserve, modulus=7, rest=2):
    """(tokens of each row, training counts, p(word, history)); None is the end, 0 the begin mark."""
    docs = [(r[0], crc(r[0]) % modulus == rest, [*words((r[1] or "").translate(ASCII_LOWER)), None]) for r in data]
    one, two = Counter(), Counter()
    for _, held, w in docs:
        if not held:
            one.update(w)
            two.update(zip([0, *w[:-1]], w))
    n = sum(one.values())
    of = lambda c: [sum(x == r for x in c.values()) for r in range(top + 2)]
    d1, d2 = discounts(of(one)), discounts(of(two))
    cut = lambda c, d: c * (d[c] if c <= top else 1)
    p = {w: cut(c, d1) / (n + reserve) for w, c in one.items()}
    unknown = 1 - sum(p.values())
    total, after = Counter(), defaultdict(list)
    for (h, w), c in two.items():
        total[h] += c
        after[h].append((w, c))
    back = {h: (1 - sum(cut(c, d2) for _, c in f) / (total[h] + reserve)) / (1 - sum(p[w] for w, _ in f)) for h, f in after.items()}

    def share(w, h):
        c = two.get((h, w), 0)
        return cut(c, d2) / (total[h] + reserve) if c else back.get(h, 1.0) * p.get(w, unknown)

    return docs, one, share


def katz(data, discounts, top, reserve):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) of each row."""
    docs, one, share = katz_model(data, discounts, top, reserve)
    n, v = sum(one.values()), len(one)
    out = []
    for i, held, w in docs:
        score = sum(math.log10(share(x, h)) for h, x in zip([0, *w[:-1]], w))
        base = sum(math.log10((one.get(x, 0) + 1) / (n + v + 1)) for x in w)
        out.append((i, held, len(w), sum(x in one for x in w), n, base, score))
    return out


class KneserNey:
    """Interpolated Kneser-Ney over tuples of symbols, by dictionaries and recursion. sequences: symbols of the training texts,
    each led by as many zeros as the order has symbols, less one."""

    def __init__(self, sequences, order, symbols):
        self.order, self.symbols = order, symbols
        self.counts = {order: Counter(tuple(s[i : i + order]) for s in sequences for i in range(len(s) - order + 1))}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])

    def share(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.symbols
        counts = self.counts[k]
        ones, twos = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = [c for g, c in counts.items() if g[:-1] == gram[:-1]]
        if not after:
            return self.share(gram[1:])
        own = max(counts[gram] - discount, 0) / sum(after) if gram in counts else 0.0
        return own + discount * len(after) / sum(after) * self.share(gram[1:])


def jump(key_hash, shards):
    """The shard after jumps from bucket to bucket; key_hash(step) is a 64-bit number."""
    held, following, step = 0, 0, 0
    while following < shards:
        held, step = following, step + 1
        following = math.floor(min((held + 1) / (((key_hash(step) % 2**64 >> 11) + 1) / 2**53), 2.0**62))
    return held
