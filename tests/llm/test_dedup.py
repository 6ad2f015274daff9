import hashlib
import random

import brute
import numpy as np
import pytest

from weftline.llm.components import components
from weftline.llm.fingerprints import Fingerprint, fingerprint_documents, fingerprints, likeness, locate_edits, merkle_nodes, merkle_trees, paragraphs
from weftline.llm.fm_dedup import deduplicate_documents_by_words
from weftline.llm.fm_index import FMIndex
from weftline.llm.near_dedup import near_duplicates, shingles, signatures, sketch_limit
from weftline.llm.suffix_array import permuted_lcp, suffix_array
from weftline.llm.suffix_dedup import deduplicate_documents, deduplicated_texts


def key(r):
    return repr(tuple(r))


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=key)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    got = near_duplicates(brute.table(spark), k, 80).collect()
    want = brute.near_components(brute.rows(), k)
    assert sorted_rows(r[:3] for r in got) == sorted_rows(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_without_links_or_rows(spark):
    assert near_duplicates(brute.table(spark, []), 2).count() == 0
    data = [(1, "a b c", "en", "s", 5, "", "", 0), (2, "d e f", "en", "s", 5, "", "", 0)]
    assert sorted_rows(near_duplicates(brute.table(spark, data), 2).collect()) == [(1, 2, 1, True), (2, 2, 2, True)]


def test_near_chain_over_blocks(spark):
    """Each text is near the next only: one component, whatever the pivots."""
    w = [f"w{i}" for i in range(160)]
    data = [(i, " ".join(w[i : i + 60]), None, None, 0, "", "", 0) for i in range(0, 100, 4)]
    assert {r.component_id for r in near_duplicates(brute.table(spark, data), 2).collect()} == {0}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    other = base.copy()
    other[:44] = rng.integers(0, 1 << 63, 44).astype(np.uint64)  # similarity 0.8
    far = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    hs = np.concatenate([np.sort(x) for x in (base, other, far)])
    _, sk = signatures(hs, np.array([0, 400, 800, 1200]))
    count = lambda a, b: int(np.bitwise_count(sk[a].view(np.uint64) ^ sk[b].view(np.uint64)).sum())
    assert count(0, 1) <= sketch_limit(80) < count(0, 2)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), (5, 4), (6, 5)], "a long, b long")
    got = {r.set_id: r.comp for r in components(edges, spark.range(1, 11).withColumnRenamed("id", "set_id")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7, 8: 8, 9: 8, 10: 10}


@pytest.mark.parametrize("length", [20, 200])
def test_byte_repeats(spark, length):
    got = deduplicate_documents(brute.table(spark), length).collect()
    assert sorted_rows(got) == sorted_rows(brute.byte_repeats(brute.rows(), length))


def test_byte_repeats_without_rows(spark):
    assert deduplicate_documents(brute.table(spark, [])).count() == 0


def test_deduplicated_texts(spark):
    docs = spark.createDataFrame([r[:5] for r in brute.rows()], "doc_id long, text string, lang string, source string, n_chars long")
    held = brute.later_byte_repeats(brute.rows(), 200)
    want = [(r[0], r[1] if not gone else left) for r, (left, gone) in zip(brute.rows(), held) if not gone or left.strip()]
    got = deduplicated_texts(docs, 200).collect()
    assert sorted_rows((r.doc_id, r.text) for r in got) == sorted_rows(want)
    assert all(r.n_chars == len(r.text) for r in got if r.n_chars)


@pytest.mark.parametrize("length", [3, 20])
def test_word_repeats(spark, length):
    got = deduplicate_documents_by_words(brute.table(spark), length).collect()
    assert sorted_rows(got) == sorted_rows(brute.word_repeats(brute.rows(), length))


def test_word_repeats_without_rows(spark):
    assert deduplicate_documents_by_words(brute.table(spark, [])).count() == 0


def test_suffix_array_and_common_prefixes(monkeypatch):
    from weftline.llm import suffix_array as module

    rng = random.Random(5)
    for k in range(200):
        # Large alphabets in small: names written as digits, and doubling for short strings only.
        monkeypatch.setattr(module, "SCAN_SYMBOLS", (512, 2, 4)[k % 3])
        monkeypatch.setattr(module, "SHORT", (1 << 18, 4, 20)[k % 3])
        t = [rng.randint(1, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(0, 120))] * rng.choice([1, 1, 3])
        s = np.array([*t, 0])
        sa = suffix_array(s)
        want = sorted(range(len(s)), key=lambda i: list(s[i:]))
        assert sa.tolist() == want
        limit = rng.choice([3, 10, 1000])
        lcp = permuted_lcp(s.astype(rng.choice([np.uint8, np.uint16])), sa, limit)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < limit and max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert lcp[b] == n


def test_fm_index_counts():
    rng = np.random.default_rng(6)
    s = np.append(rng.integers(1, 5, 300), 0)
    index = FMIndex(s, 5, 6)
    starts = np.arange(len(s) - 6)
    who, lo, hi = index.matches(s, starts, 5, 1)
    windows = [tuple(s[i : i + 5]) for i in range(len(s) - 4)]
    assert len(who) == len(starts)
    assert [int(h - a) for a, h in zip(lo, hi)] == [windows.count(windows[i]) for i in who]


def plain_tree(text, ends):
    """{level: [(digest, start, end)]} of the Merkle tree over paragraphs, the root's children highest, and the root."""
    sha = lambda b: hashlib.sha256(b).digest()[:16]
    level = [(sha(text[a:b]), a, b) for a, b in zip([0, *ends], ends)]
    levels = {0: level} if level else {}
    for k in range(1000):
        if len(level) < 2:
            break
        levels[k] = level
        above, held = [], []
        for j, node in enumerate(level):
            held.append(node)
            if node[0][0] % 4 == 0 or j + 1 == len(level):
                above.append((sha(b"section" + b"".join(h[0] for h in held)), held[0][1], held[-1][2]))
                held = []
        level = above
    return levels, sha(b"root" + b"".join(h[0] for h in level)).hex()


def plain_likeness(a, b):
    """From whole trees: bytes of a's nodes that b has on the same level, parents before children, each of b's used once."""
    (x, root_x), (y, root_y) = (plain_tree(t, paragraphs([t])[0]) for t in (a, b))
    if root_x == root_y:
        return 1.0
    if not a and not b:
        return 0.0
    finest = max([next((k for k in sorted(t) if len(t[k]) <= 64), 0) for t in (x, y)])
    done_x, done_y, total = [], [], 0
    inside = lambda n, spans: any(s <= n[1] and n[2] <= e for s, e in spans)
    for k in range(max([*x, *y], default=-1), finest - 1, -1):
        left = {}
        for n in y.get(k, ()):
            if not inside(n, done_y):
                left.setdefault(n[0][:4], []).append(n)
        taken_x, taken_y = [], []
        for n in x.get(k, ()):
            if not inside(n, done_x) and left.get(n[0][:4]):
                m = left[n[0][:4]].pop(0)
                taken_x.append(n[1:]), taken_y.append(m[1:])
                total += n[2] - n[1]
        done_x, done_y = done_x + taken_x, done_y + taken_y
    return min(2 * total / (len(a) + len(b)), 1 - 2**-20)


def test_fingerprints(spark):
    data = sorted({r[:2] for r in brute.rows() if r[0] is not None}, key=lambda r: -r[0])
    got = {r.doc_id: r for r in fingerprint_documents(brute.table(spark, [(*r, None, None, 0, "", "", 0) for r in data])).collect()}
    prints = {}
    for i, (doc_id, text) in enumerate(data):
        text, nxt = text or "", data[(i + 1) % len(data)][1] or ""
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for name, t in ((r.fingerprint, text), (r.edited_fingerprint, edited)):
            assert name.split(":")[0] == plain_tree(t.encode(), paragraphs([t.encode()])[0])[1] and name == str(Fingerprint.parse(name))
        assert abs(r.near_edited - plain_likeness(text.encode(), edited.encode())) < 1e-12
        assert abs(r.near_next - plain_likeness(text.encode(), nxt.encode())) < 1e-12
        assert likeness(r.fingerprint, r.edited_fingerprint) == r.near_edited and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    long = [r for r in got.values() if r.n_chars > 300]
    assert sum(r.near_edited > r.near_next for r in long) > 0.6 * len(long)  # the table has copies and few words
    assert sum(abs(r.near_edited - 0.5) < 0.2 for r in long) > 0.6 * len(long)


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_of_rows_without_order(spark, monkeypatch, parts):
    """Null ids, repeated ids and equal rows over several ranges: each row once, next by the text's hash under one id."""
    from weftline.llm import fingerprints as module

    monkeypatch.setattr(module, "partitions", lambda df: parts)
    rows = brute.rows() + [(None, f"nameless {i % 5}", None, None, 0, "", "", 0) for i in range(40)] + [(7, f"x {i}", None, None, 0, "", "", 0) for i in range(9)]
    docs = brute.table(spark, rows)
    hashes = {r.text: r.h for r in docs.toDF(*"abcdefgh").selectExpr("b AS text", "xxhash64(b) AS h").collect()}
    data = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]]))
    want = []
    for i, r in enumerate(data):
        text, nxt = r[1] or "", data[(i + 1) % len(data)][1] or ""
        want.append((r[0], hashlib.sha256((text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]).encode()).hexdigest(), plain_likeness(text.encode(), nxt.encode())))
    assert sorted_rows((r.doc_id, r.edited_sha256, r.near_next) for r in fingerprint_documents(docs).collect()) == sorted_rows(want)


def test_fingerprints_are_bounded():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(20000))
    other = text[:60000] + " something else " + text[60000:]
    a, b = fingerprints([text.encode(), other.encode()])
    assert len(str(a)) < 1600 and 0.9 < likeness(a, b) < 1
    assert str(Fingerprint.parse(str(a))) == str(a) and [str(f)[32:] for f in fingerprints([b"", b" "])][0] == ":0:"


def test_fingerprints_of_awkward_tables(spark):
    assert fingerprint_documents(brute.table(spark, [])).count() == 0
    got = fingerprint_documents(brute.table(spark)).collect()
    assert len(got) == len(brute.rows())
    one = fingerprint_documents(brute.table(spark, [(1, "a b", None, None, 0, "", "", 0)])).first()
    assert one.near_next == 1.0


def test_trees_locate_edits(spark):
    lines = [f"paragraph {i} has the number {i}" for i in range(60)]
    a = "\n".join(lines).encode()
    lines[17] = lines[17].replace("17", "18 less 1")
    b = "\n".join(lines).encode()
    found = locate_edits(a, b)
    edited = a.index(b"paragraph 17"), a.index(b"paragraph 18")
    assert found and all(edited[0] <= at < to <= edited[1] for at, to in found) and locate_edits(a, a) == []
    nodes = merkle_nodes(spark.createDataFrame([(1, a.decode()), (2, None)], "doc_id long, text string")).collect()
    tree, = merkle_trees([a])
    root = next(r for r in nodes if r.doc_id == 1 and r.parent is None)
    assert (root.digest, root.start, root.end, root.level) == (tree.root.hex(), 0, len(a), len(tree.levels))
    leaves = [(r.start, r.end) for r in sorted(nodes, key=lambda r: r["index"]) if r.level == 0 and r.doc_id == 1]
    assert [e for _, e in leaves] == paragraphs([a])[0] and leaves[0][0] == 0
    for r in nodes:
        if r.parent is not None:
            assert any(p.doc_id == r.doc_id and p.level == r.level + 1 and p["index"] == r.parent and p.start <= r.start and r.end <= p.end for p in nodes)


def test_shingles_of_texts():
    texts = ["a b a b", "", "x", "a b"]
    raw = [t.encode() for t in texts]
    hs, at = shingles(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))), 2)
    assert np.diff(at).tolist() == [2, 0, 1, 1] and hs[at[3]] in hs[: at[1]]


@pytest.mark.parametrize("symbols", [1, 1200])
def test_repeats_under_hot_anchors(spark, monkeypatch, symbols):
    """Anchors of many distinct segments, whose windows are dealt by their own hashes: results as before."""
    from weftline.llm import repeats

    monkeypatch.setattr(repeats, "INDEX_SYMBOLS", symbols)
    docs = brute.table(spark)
    for length in (20, 200):
        assert sorted_rows(deduplicate_documents(docs, length).collect()) == sorted_rows(brute.byte_repeats(brute.rows(), length))
    for length in (3, 20):
        assert sorted_rows(deduplicate_documents_by_words(docs, length).collect()) == sorted_rows(brute.word_repeats(brute.rows(), length))


def test_a_common_line_fills_no_index(spark):
    """A line of half a window and more between ever other neighbours: its segments do not all meet in one index."""
    from weftline.llm.arrays import BYTE_VALUES
    from weftline.llm.repeats import INDEX_SYMBOLS, Kind, take_out_repeats
    from weftline.llm.suffix_dedup import _symbols, kept_bytes, repeated_windows

    def solve(part, window):
        if len(part.symbols) > 2 * INDEX_SYMBOLS:
            raise ValueError(f"{len(part.symbols)} symbols in an index")
        return repeated_windows(part, window)

    rng = random.Random(8)
    noise = lambda: "".join(rng.choices("abcdefgh ", k=150))
    line = "".join(rng.choices("ijklmnop ", k=150))
    data = [(i, noise() + line + noise()) for i in range(16000)]
    data += [(16000, data[0][1][:350]), (16001, data[1][1][100:])]  # windows across the line and its neighbours that do repeat
    kind = Kind(200, 100, _symbols, lambda s: BYTE_VALUES[s], solve, False, kept_bytes, "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept binary")
    got = {r.doc_id: r.n_removed for r in take_out_repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(4), kind).collect()}
    assert {i: n for i, n in got.items() if n} == {0: 350, 16000: 350, 1: 350, 16001: 350}


@pytest.mark.parametrize("first_stays", [False, True])
def test_copies_fill_no_index(spark, first_stays):
    """Anchors whose segments are all equal are answered without an index; beside an unlike one they go into it."""
    from weftline.llm.arrays import BYTE_VALUES
    from weftline.llm.repeats import Kind, take_out_repeats
    from weftline.llm.suffix_dedup import _symbols, kept_bytes, later_windows, repeated_windows

    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    texts = [noise(900) for _ in range(12)]
    kind = lambda solve: Kind(200, 100, _symbols, lambda s: BYTE_VALUES[s], solve, first_stays, kept_bytes, "doc_id long, text string, n_bytes long, n_removed long, n_spans long, kept binary")
    plain = lambda b: b.decode()

    def found(data, solve):
        docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
        return sorted((r.doc_id, bytes(r.kept).decode()) for r in take_out_repeats(docs, kind(solve)).collect())

    def expected(data):
        if first_stays:
            return sorted((r[0], left) for r, (left, _) in zip(data, brute.later_byte_repeats(data, 200)))
        return sorted((r[0], r[4]) for r in brute.byte_repeats(data, 200, plain))

    def refuse(part, window):
        raise ValueError(f"{len(part.start)} segments in an index")

    data = [(i, texts[i % 12]) for i in range(36)]
    assert found(data, refuse) == expected(data)
    data += [(50 + i, t[:450] + noise(300)) for i, t in enumerate(texts[:6])] + [(60, noise(900))]
    most = sum(len(t) - 200 + 1 for t in texts)

    def few(part, window):
        if sum(part.length - window + 1) > most // 2:
            raise ValueError(f"{len(part.start)} segments in an index")
        return (later_windows if first_stays else repeated_windows)(part, window)

    assert found(data, few) == expected(data)


def unlike_twins(size=4096):
    """Two Thue-Morse words, unlike at every letter: polynomial hashes modulo powers of two take them for equal."""
    bits = [bin(i).count("1") & 1 for i in range(size)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_hashes_tell_unlike_words_apart():
    from weftline.llm.arrays import BYTE_VALUES, Lanes, running, stretch, word_hashes

    a, b = (t.encode() for t in unlike_twins())
    data, starts = np.frombuffer(a + b + a, np.uint8), np.array([0, len(a), 2 * len(a)])
    choice = stretch(running(BYTE_VALUES[data]), starts, starts + len(a))
    assert choice[0] == choice[1]  # the case is real
    for x in (word_hashes(data, starts, starts + len(a)), Lanes(data).of(starts, starts + len(a)), Lanes(data.astype(np.uint64)).of(starts, starts + len(a))):
        assert x[0] == x[2] != x[1]


def test_lanes_are_polynomials():
    from weftline.llm.arrays import _LANE_BASES, Lanes

    data = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    for base, sums in zip(_LANE_BASES, Lanes(data).sums):
        assert int(sums[2500]) % (2**31 - 1) == sum((int(v) + 1) * pow(base, i, 2**31 - 1) for i, v in enumerate(data[:2500])) % (2**31 - 1)


def test_unlike_texts_of_one_polynomial_hash(spark):
    """Near duplicates, byte and word repeats and fingerprints tell the twins apart."""
    a, b = unlike_twins()
    data = [(1, a, None, None, 0, "", "", 0), (2, b, None, None, 0, "", "", 0), (3, f"{a} x {b}", None, None, 0, "", "", 0), (4, f"{b} x {a}", None, None, 0, "", "", 0)]
    docs = brute.table(spark, data)
    assert sorted_rows(r[:3] for r in near_duplicates(docs, 2, 80).collect()) == sorted_rows(brute.near_components(data, 2))
    for length in (200, 5000):
        assert sorted_rows(deduplicate_documents(docs, length).collect()) == sorted_rows(brute.byte_repeats(data, length))
    assert sorted_rows(deduplicate_documents_by_words(docs, 2).collect()) == sorted_rows(brute.word_repeats(data, 2))
    got = {r.doc_id: r for r in fingerprint_documents(docs).collect()}
    assert len({r.fingerprint for r in got.values()}) == 4 and got[2].near_next < 1
