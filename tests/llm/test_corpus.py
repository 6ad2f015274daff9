import hashlib
import math
import re
import zlib

import brute
import numpy as np
import pytest
from conftest import SF
from oracle import duck_rows
from oracle import rows as spark_rows

from weftline.llm.katz import RESERVE, TOP, discounts, score_corpus
from weftline.llm.language import ORDER, fit_identifier, identify_documents
from weftline.llm.mixing import mix_documents, mixed_rows, source_targets
from weftline.llm.packing import Encoder, best_fit, default_vocabulary, local_search, pack_documents, sequences, token_pieces
from weftline.llm.queries import ORACLES, QUERIES
from weftline.llm.sharding import shard_documents
from weftline.llm.topk import search_embeddings


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(SF, ORACLES[name])


def by_key(rows):
    return sorted(rows, key=lambda r: repr((r[0], r[2], round(r[-1], 4))))


def test_katz(spark):
    got = by_key([tuple(r) for r in score_corpus(brute.table(spark)).collect()])
    want = by_key(brute.katz(brute.rows(), lambda c: discounts(np.array(c)), TOP, RESERVE))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], atol=1e-6)


def test_katz_tables_score_texts(spark):
    """The stored tables alone give the same scores, also of texts that the model never saw, and of unlike words of one polynomial hash."""
    from test_dedup import unlike_twins
    from pyspark.sql import functions as F

    from weftline.llm.katz import train_and_score

    a, b = unlike_twins()
    data = brute.rows() + [(7001, f"{a} {a} x", None, None, 0, "", "", 0), (7002, f"{b} x", None, None, 0, "", "", 0), (7003, a, None, None, 0, "", "", 0)]
    docs = brute.table(spark, data).toDF("doc_id", "text", *"cdefgh").select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"), "text")
    scores, model = train_and_score(docs)
    want = sorted((repr(r.doc_id), r.n_tokens, round(r.score, 5)) for r in scores.collect())
    assert want == sorted((repr(r[0]), r[2], round(r[6], 5)) for r in brute.katz(data, lambda c: discounts(np.array(c)), TOP, RESERVE))
    assert sorted((repr(r.doc_id), r.n_tokens, round(r.score, 5)) for r in model.score(docs).collect()) == want
    _, one, share = brute.katz_model(data, lambda c: discounts(np.array(c)), TOP, RESERVE)
    new = [(1, "the cat the The"), (2, None), (3, f"{b} {a}"), (4, "ab ab ab x it's x never seen")]
    for r in model.score(spark.createDataFrame(new, "doc_id long, text string")).collect():
        w = [*brute.words((dict(new)[r.doc_id] or "").translate(brute.ASCII_LOWER)), None]
        assert math.isclose(r.score, sum(math.log10(share(x, h)) for h, x in zip([0, *w[:-1]], w)), abs_tol=1e-6) and r.n_tokens == len(w)


def test_katz_is_normalised():
    """All words after a history, the unknown one and the end included, have probability 1 together."""
    _, one, share = brute.katz_model(brute.rows(), lambda c: discounts(np.array(c)), TOP, RESERVE)
    for h in [0, "never", *list(one)[:40]]:
        assert math.isclose(sum(share(w, h) for w in [*one, "unseen"]), 1, rel_tol=1e-9)


def test_katz_without_training_or_rows(spark):
    assert score_corpus(brute.table(spark, [])).count() == 0
    held = next(i for i in range(1000) if brute.crc(i) % 7 == 2)
    r = score_corpus(brute.table(spark, [(held, "a b", None, None, 0, "", "", 0)])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and abs(r.score) < 1e-9


def test_discounts():
    assert (discounts(np.array([0, 0, 0, 0, 0, 0, 0])) == 1).all()  # no counts, nothing to discount
    assert np.allclose(discounts(np.array([0, 9, 0, 0, 0, 0, 9]))[1:], [0.1, 0.55, 0.7, 0.775, 0.82])  # too irregular: absolute
    d = discounts(np.array([0, 100, 40, 20, 12, 8, 5]))
    assert (d[1:] > 0).all() and (d[1:] <= 1).all()
    # Katz's condition: what the discounts free is what Good-Turing gives to unseen events.
    n = np.array([100, 40, 20, 12, 8])
    assert math.isclose(sum(n * np.arange(1, 6) * (1 - d[1:])), 100)


def test_mix_totals(spark):
    docs = brute.table(spark)
    got = mix_documents(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_documents(docs).collect()), key=repr)
    sizes, taken, targets, largest = {}, {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        targets[r.source], largest[r.source] = r.target, max(largest.get(r.source, 0), r.size)
        assert r.copies <= 3
    assert math.isclose(sum(targets.values()), sum(sizes.values()))
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 and targets[s] <= 3 * sizes[s] for s in sizes)


def test_mixed_rows(spark):
    data = [r[:5] for r in brute.rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    want = sum(r.copies for r in mix_documents(docs).collect())
    got = mixed_rows(docs).collect()
    assert len(got) == want and {tuple(r) for r in got} <= set(data)


def test_targets_share_the_excess_by_weight(spark):
    s = spark.createDataFrame([("a", 300), ("b", 10), ("c", 50), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in source_targets(s).collect()}
    assert got["b"] == 30 and got["c"] == 150 and got[None] == 0 and math.isclose(got["a"], 180)


def test_mix_without_rows(spark):
    assert mix_documents(brute.table(spark, [])).count() == 0


def test_search(spark, tmp_path):
    rng = np.random.default_rng(7)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    data += [(300, data[3][1]), (350, data[3][1]), (301, None), (400, [1.0] * 7 + [None]), (450, [float("nan")] * 8), (302, [float("inf")] * 8), (303, []), (None, data[0][1])]
    data += [(50, data[50][1]), (50, data[7][1]), (4, data[100][1]), (304, [1.0, 2.0]), (500, [1.0, 2.0]), (305, [1.0, 3.0]), (550, [9.0] * 3)]
    ok = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for at, (q, v) in enumerate(ok):
        if q % 50 == 0:
            near = sorted((-int(np.dot(v, x)), i) for k, (i, x) in enumerate(ok) if k != at and len(x) == len(v))[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(near)]
    # Further columns, one of them with a clashing name.
    docs = spark.createDataFrame([(*r, "x", 1) for r in data], "vec_id long, embedding array<double>, VEC_ID string, row int")
    assert sorted(map(tuple, search_embeddings(docs, 50, 5).collect())) == sorted(want)
    spark.createDataFrame(data, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    names, sql = duck_rows(str(tmp_path), ORACLES["op5_search_top_k"])
    assert sorted(tuple(r[names.index(c)] for c in ("query_id", "rank", "vec_id", "score")) for r in sql) == sorted(want)
    assert search_embeddings(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    assert [tuple(r) for r in search_embeddings(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")).collect()] == [(0, 1, 1, 256 * 512)]


def test_search_bounds_come_from_what_was_read():
    """Bounds after each pause against plain ones: read entries are exact, the others lie between the list's far end and where reading stands."""
    from weftline.llm import topk

    rng = np.random.default_rng(3)
    x = rng.integers(-9, 10, (60, 5)).astype(np.float64)
    q = rng.integers(-9, 10, (4, 5)).astype(np.float64)
    for part in topk.DEPTHS:
        depth = min(max(int(len(x) * part), 1), len(x))
        for w in q:
            low, high = [], []
            for row in x:
                lo = hi = 0.0
                for j, c in enumerate(w):
                    column = sorted(x[:, j], reverse=c > 0)  # read from the end that the query's sign asks for
                    stands, far = column[depth - 1], column[-1]
                    read = row[j] >= stands if c > 0 else row[j] <= stands
                    lo, hi = lo + c * (row[j] if read else far), hi + c * (row[j] if read else stands)
                low.append(lo), high.append(hi)
                assert lo <= row @ w <= hi
            own = np.array([-1])
            alive = np.ones(len(x), bool)
            kth = sorted(low)[-3]
            kept, _ = topk.candidates(x, np.arange(len(x)), topk.block_lists(x), w[None], own, 3)
            assert (np.array(high)[kept[0]] >= kth).all() and (kept[0] <= alive).all()


def test_language_models_are_normalised():
    who = fit_identifier(["the cat sat on the mat"] * 5 + ["der hund lag auf dem bett"] * 5, ["en"] * 5 + ["de"] * 5)
    for m in who.models:
        for context in (0, 5, 137):
            keys = context * who.base + np.arange(who.base)
            assert math.isclose(np.exp(m.log_shares(keys)).sum(), 1, rel_tol=1e-9)
    data = "Cat, mat".encode()
    key, upto, letters = who.keys(np.frombuffer(data + b"" + b"x", np.uint8), np.array([0, len(data), len(data), len(data) + 1]))
    assert letters.tolist() == [6, 0, 1] and np.diff(upto).tolist() == [7, 0, 1] and ORDER == 4


def test_language_models_against_dictionaries():
    """Shares, entropies and the language chosen, by a plain Kneser-Ney with its own symbols."""
    texts = ["the cat sat on the mat", "a cat and a hat", "that is the end of it", "the the the", "Cat! 7 on the"]
    others = ["der hund lag auf dem bett", "ein hund und ein hut", "das ist das ende", "der der", "Hund? 3 auf dem"]
    who = fit_identifier(texts + others, ["en"] * 5 + ["de"] * 5)
    fold = lambda t: re.sub(r"[^a-z]+", " ", "\0" + t.lower())
    ids = {c: i + 1 for i, c in enumerate(sorted(set("".join(map(fold, [*texts[:4], *others[:4]])) ) - {" "}))}
    number = lambda t: [0] * (ORDER - 1) + [ids.get(c, len(ids) + 1) if c != " " else 0 for c in fold(t)[1:]]
    assert who.base == len(ids) + 2 and who.languages == ["de", "en"]
    plain = [brute.KneserNey([number(t) for t in held[:4]], ORDER, who.base) for held in (others, texts)]
    for model, mine in zip(who.models, plain):
        for gram in [(0, 0, 0, 1), (1, 2, 3, 4), (0, 5, 5, 5), (0, 0, 1, 0), tuple(number(texts[0])[3:7]), tuple(number(others[0])[4:8])]:
            key = 0
            for c in gram:
                key = key * who.base + c
            assert math.isclose(math.exp(model.log_shares(np.array([key]))[0]), mine.share(gram), rel_tol=1e-9)
    asked = ["the hat", "das bett", "x y z", "Ende, der Hut"]
    raw = [t.encode() for t in asked]
    e, _ = who.entropies(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for row, t in zip(e, asked):
        s = number(t)
        want = [-sum(math.log(m.share(tuple(s[i : i + ORDER]))) for i in range(len(s) - ORDER + 1)) / (len(s) - ORDER + 1) for m in plain]
        assert np.allclose(row, want)


def test_foreign_texts_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    strange = [("qzxv kjwq zzxq vvkj qqxz " * 40, "noise"), ("日本語の文章です。これは試験のための文です。" * 20, "script"), ("0x7f 9b2c aa41 77de " * 60, "hex")]
    extra = spark.createDataFrame([(10**7 + 3 * i, t, None, "s", len(t)) for i, (t, _) in enumerate(strange)], docs.schema)
    got = {r.doc_id: r.rejected for r in identify_documents(docs.unionByName(extra)).collect()}
    assert [got[10**7 + 3 * i] for i in range(3)] == [True, True, True]
    assert sum(got[i] for i in got if i < 10**7) <= 0.005 * len(got)


def test_language_sample_is_bounded_and_whole(spark, monkeypatch):
    """A hot repeated text is learned once, no language is left out, and the bound is exact."""
    from weftline.llm import language

    monkeypatch.setattr(language, "SAMPLE_CHARS", 2000)
    monkeypatch.setattr(language, "LONGEST_SAMPLE", 900)
    data = [(i, "the same text again and again", "en") for i in range(3000)]
    data += [(4000 + i, f"another text of number {i} and some words more", "en") for i in range(200)]
    data += [(5000, "ein langer satz " * 4000, "de"), (5001, "un mot", "fr"), (5002, "un mot", "fr"), (5003, None, "es"), (5004, "no language", None)]
    sample = language._sample(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    held = {x: [t for y, t in sample if y == x] for x in {x for x, _ in sample}}
    assert set(held) == {"de", "en", "fr"} and held["fr"] == ["un mot"] and [len(t) for t in held["de"]] == [900]
    assert len(set(held["en"])) == len(held["en"]) > 1 and sum(map(len, held["en"])) <= 2000


def test_identifiers_are_bounded(spark, monkeypatch):
    from weftline.llm import language

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = language.train_identifier(docs)
    monkeypatch.setattr(language, "MODEL_BYTES", language._bytes(whole) // 3)
    less = language.train_identifier(docs)
    assert less.languages == whole.languages and language._bytes(less) <= language._bytes(whole) // 3


def test_language_tables_start_anew(monkeypatch):
    from weftline.llm import language

    who = fit_identifier(["the cat sat on the mat"] * 5 + ["der hund lag auf dem bett"] * 5, ["en"] * 5 + ["de"] * 5)
    texts = [t.encode() for t in ("the cat", "auf dem mat", "der cat")]
    ask = lambda t: who.entropies(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]
    want = [ask(t) for t in texts]
    monkeypatch.setattr(language, "MOST_KNOWN", 3)
    assert all(np.allclose(ask(t), w) for t, w in zip(texts * 2, want * 2))


def test_language_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in identify_documents(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum(got[i].lang_pred == truth[i] for i in held) > 0.97 * len(held)
    assert not any(r.rejected for r in got.values())


def test_language_of_awkward_rows(spark):
    got = identify_documents(brute.table(spark)).collect()
    assert len(got) == len(brute.rows())
    none = {r[0] for r in brute.rows() if not re.search(r"[^\W\d_]", r[1] or "")}
    for r in got:
        assert (r.lang_pred == "und") == (r.score == 0)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (r.doc_id in none)
    nothing = identify_documents(brute.table(spark, [(1, "a", None, None, 0, "", "", 0), (2, "1 2", "en", None, 0, "", "", 0), (3, None, "en", None, 0, "", "", 0)])).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in nothing} == {("und", 0.0, False)}
    assert identify_documents(brute.table(spark, [])).count() == 0


def test_jump_hash_against_a_plain_loop(spark):
    from pyspark.sql import functions as F

    from weftline.llm.sharding import jump_hash

    ids = [*range(200), -1, -(2**63), 2**63 - 1, None]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.array(*(F.xxhash64("doc_id", F.lit(k)) for k in range(1, 120))).alias("h")).collect()}
    for shards in (1, 2, 8, 9, 100):
        got = {r.doc_id: r.s for r in docs.select("doc_id", jump_hash(F.col("doc_id"), shards).alias("s")).collect()}
        assert got == {i: brute.jump(lambda step, h=hashes[i]: h[step - 1], shards) for i in ids}


def test_sharding(spark):
    data = brute.rows() + [(1000 + i, "t", None, None, 0, "", "", 0) for i in range(4000)]
    got = shard_documents(brute.table(spark, data), 8).collect()
    assert len(got) == len(data) and {r.law for r in got} == {"key"}
    shards, moved, size = {}, 0, {}
    for r in got:
        shards.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
        assert size.setdefault(r.doc_id, r.shard) == r.shard
        moved += r.grown_shard == 8
    assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) == set(range(8))
    assert 0.07 < moved / len(got) < 0.16 and max(map(len, shards.values())) < 1.3 * len(got) / 8
    texts = {r[0]: (r[1] or "").encode() for r in data if r[0] is not None}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id])) for r in got if r.doc_id is not None)
    assert shard_documents(brute.table(spark, []), 8).count() == 0


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def encoded(texts):
    raw = [t.encode() for t in texts]
    ids, at = Encoder(default_vocabulary()).encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


@pytest.mark.parametrize("hashes", ["own", "few"])
def test_token_ids_equal_the_tokenizers(monkeypatch, hashes):
    """Also with hashes that hold most pieces for equal: bytes decide."""
    import random

    from weftline.llm import packing

    if hashes == "few":
        monkeypatch.setattr(packing, "place_hashes", lambda data, starts, ends: data[starts].astype(np.uint64) % np.uint64(5))
    rng = random.Random(1)
    mark = "<|endoftext|>"
    parts = [mark, "<|", "endoftext", "'", "s", "t", "r", "e", "v", "l", " ", "  ", "\n", "\t", "1", "!", "é", "日", "😀", "'s", "'ll", ".", "\x1c", "\x85"]
    texts = ["", "don't you'll '' 's", "  lead  and  trail  ", mark, mark * 2, f"a{mark}b", f"{mark}'s", f"don{mark}'t", f"x  {mark}  y", mark[:7], mark[7:], mark[:-1], f"<|{mark}|>"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    assert encoded(texts) == [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_token_ids_of_unlike_words_of_one_polynomial_hash():
    from test_dedup import unlike_twins

    texts = list(unlike_twins())
    assert encoded(texts) == [x.ids for x in tokenizer().encode_batch(texts, add_special_tokens=False)]



def test_packing(spark):
    data = brute.rows() + [(900 + i, x, None, None, 0, "", "", 0) for i, x in enumerate(("<|endoftext|>", "a<|endoftext|>b " * 200, "<|endoftext|><|endoftext|> c"))]
    docs = brute.table(spark, data)
    t, capacity = tokenizer(), 256
    got = pack_documents(docs, capacity).collect()
    want = []
    for r in data:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        over = len(ids) - (len(ids) - 1) // capacity * capacity
        cuts = [0, *range(over, len(ids) + 1, capacity)]
        want += [(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.1 * sum(w[3] for w in want) / capacity + 1
    whole = {r.sequence_id: r.ids for r in sequences(docs, capacity).collect()}
    assert sum(map(len, whole.values())) == sum(w[3] for w in want)
    assert pack_documents(brute.table(spark, [])).count() == 0 and token_pieces(brute.table(spark, [])).count() == 0


def test_local_search_empties_bins():
    def check(counts, bins, capacity):
        assert all(sum(b) <= capacity for b in bins)
        assert all(sum(b.count(k) * n for b, n in bins.items()) == c for k, c in counts.items())

    for counts, bins, most in (
        ({6: 1, 5: 1, 4: 1, 1: 1}, {(6,): 1, (5, 4): 1, (1,): 1}, 2),  # a move
        ({6: 2, 5: 2, 4: 4}, {(6,): 2, (5, 4): 2, (4, 4): 1}, 4),
        ({7: 3, 3: 3}, {(7,): 3, (3, 3, 3): 1}, 3),
    ):
        found = local_search(bins, 10)
        check(counts, found, 10)
        assert sum(found.values()) <= most
        check(counts, best_fit(counts, 10), 10)


def test_pipeline(spark):
    import corpus_pipeline as c

    from weftline.llm.common import documents

    assert [n for n, _ in c.STAGES] == ["language", "near_dedup", "suffix_dedup", "mix", "pack"] and c.ORACLE_SQL is None
    docs = documents(spark, SF).limit(120).cache()
    extra = spark.createDataFrame([(10**6, "12345 %%%", "en", "src0", 9), (10**6 + 1, None, None, None, None)], docs.schema)
    near = docs.filter("n_chars > 300").limit(1).selectExpr("doc_id + 2000000 AS doc_id", "text || ' more' AS text", "lang", "source", "n_chars")
    held = docs.unionByName(extra).unionByName(near)
    all_rows = [tuple(r) for r in held.collect()]
    out = c.language(spark, held, SF)
    assert out.columns == documents(spark, SF).columns
    spoken = [tuple(r) for r in out.collect()]
    assert set(all_rows) - set(spoken) == {r for r in all_rows if r[0] in (10**6, 10**6 + 1)}
    out = c.near_dedup(spark, spark.createDataFrame(spoken, docs.schema), SF)
    want = sorted({i for i, _, comp in brute.near_components(spoken, 5) if i == comp})
    kept = [tuple(r) for r in out.collect()]
    assert sorted(r[0] for r in kept) == want and 2 * 10**6 > max(r[0] for r in kept)
    out = c.suffix_dedup(spark, spark.createDataFrame(kept, docs.schema), SF)
    cleared = [tuple(r) for r in out.collect()]
    assert sorted((r[0], r[1]) for r in cleared) == sorted((r[0], left) for r, (left, gone) in zip(kept, brute.later_byte_repeats(kept, 200)) if not gone or left.strip())
    mixed = c.mix(spark, spark.createDataFrame(cleared, docs.schema), SF)
    assert mixed.columns == docs.columns and {r[0] for r in mixed.collect()} <= {r[0] for r in cleared}
    packed = c.pack(spark, mixed, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()}
    assert c.run(spark, SF).count() > 0


def test_near_stage_keeps_one_row_a_component(spark):
    """Near-equal texts under null and repeated ids: one row of each component stays, whatever its id."""
    import corpus_pipeline as c

    text = lambda name, n=60, at=None: " ".join("x" if i == at else f"{name}{i}" for i in range(n))
    row = lambda i, t: (i, t, "en", "s", 0)
    data = [row(1, text("a")), row(None, text("a", at=3)), row(7, text("a", at=55)), row(7, text("b")), row(7, text("b", at=2))]
    data += [row(None, text("c")), row(None, text("c", at=1)), row(None, text("d")), row(None, text("d")), row(9, text("e")), row(9, text("f")), row(8, text("f", at=4))]
    data += [row(None, None), row(None, ""), row(1, " ")]
    got = [tuple(r) for r in c.near_dedup(spark, spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3), SF).collect()]
    groups = [d[:60].split("0")[0] if d else d for _, d, *_ in got]
    assert sorted(map(repr, groups)) == sorted(map(repr, ["a", "b", "c", "d", "e", "f", None, "", " "]))
    assert {g: r[0] for g, r in zip(groups, got) if g and g.strip()} == {"a": 1, "b": 7, "c": None, "d": None, "e": 9, "f": 8}
    assert set(got) <= set(data)


def test_local_search_ends_where_no_pair_improves():
    """Best fit stays above the bound here: the search goes on until no two bins can exchange, and saves sequences."""
    import random

    from weftline.llm.packing import least_bins

    rng, counts = random.Random(1), {}
    for _ in range(1000):
        k = rng.randint(350, 1200)
        counts[k] = counts.get(k, 0) + 1
    before = best_fit(counts, 2048)
    found = local_search(before, 2048)
    assert all(sum(b) <= 2048 for b in found) and all(sum(b.count(k) * n for b, n in found.items()) == c for k, c in counts.items())
    assert least_bins(counts, 2048) <= sum(found.values()) < sum(before.values())
    if sum(found.values()) > least_bins(counts, 2048):
        for give in found:
            for take in found:
                room = 2048 - sum(take)
                over = [x - y for x in give for y in (0, *take) if (give != take or found[give] > 1) and 0 < x - y <= room]
                assert all(2 * d * (sum(take) - sum(give) + d) <= 0 for d in over)
    cut = local_search(before, 2048, effort=2000)  # ended early: as many pieces, no more bins than before
    assert all(sum(b) <= 2048 for b in cut) and all(sum(b.count(k) * n for b, n in cut.items()) == c for k, c in counts.items())
    assert sum(cut.values()) <= sum(before.values())


def test_lower_bound_of_bins():
    from weftline.llm.packing import least_bins

    assert least_bins({}, 10) == 0 and least_bins({6: 3, 5: 1}, 10) == 4 and least_bins({4: 5}, 10) == 3 and least_bins({7: 2, 4: 3}, 10) == 4


def test_search_reads_until_no_outsider_can_qualify():
    from weftline.llm.topk import DEPTHS, block_lists, candidates

    rng = np.random.default_rng(2)
    x = rng.integers(-9, 10, (400, 12)).astype(np.float32)
    x[0] = 9 * np.sign(x[1])  # near to itself only: decided early
    q, own, ids = x[[0, 5, 9]], np.array([-1, 5, 9]), np.arange(400)
    alive, pauses = candidates(x, ids, block_lists(x), q, own, 1)
    score = np.where(ids[None, :] == own[:, None], -np.inf, q @ x.T)
    assert (alive == (score == score.max(axis=1, keepdims=True))).all()
    assert pauses[0] < pauses.max() <= len(DEPTHS) and DEPTHS[-1] == 1.0


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    """Rows of near_dedup, suffix_dedup, mix and pack, each against a plain version fed with the stage's own input."""
    import corpus_pipeline as c

    from weftline.llm.common import documents

    schema = documents(spark, SF).schema
    data = [tuple(r) for r in documents(spark, SF).limit(80).collect()]
    frame = lambda rows: spark.createDataFrame(rows, schema).repartition(3)
    plain = lambda df: sorted(map(tuple, df.collect()), key=repr)
    kept = plain(c.near_dedup(spark, frame(data), SF))
    want = {i for i, _, comp in brute.near_components(data, 5) if i == comp}
    assert kept == sorted((r for r in data if r[0] in want), key=repr)
    cleared = plain(c.suffix_dedup(spark, frame(kept), SF))
    held = brute.later_byte_repeats(kept, 200)
    want = [r if not gone else (r[0], left, r[2], r[3], len(left)) for r, (left, gone) in zip(kept, held) if not gone or left.strip()]
    assert cleared == sorted(want, key=repr)
    mixed = plain(c.mix(spark, frame(cleared), SF))
    spark.createDataFrame(cleared, schema).write.parquet(f"{tmp_path}/documents.parquet")
    names, taken = duck_rows(str(tmp_path), ORACLES["op4_mix_sources"])
    copies = {r[names.index("doc_id")]: r[names.index("taken")] // max(r[names.index("size")], 1) for r in taken}
    assert mixed == sorted((r for r in cleared for _ in range(copies[r[0]])), key=repr)
    t, want = tokenizer(), []
    for r in mixed:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        over = len(ids) - (len(ids) - 1) // 2048 * 2048
        cuts = [0, *range(over, len(ids) + 1, 2048)]
        want += [(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in c.pack(spark, frame(mixed), SF).collect()), key=repr) == sorted(want, key=repr)


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, size string, Key string, TEXT int, rank long, kept boolean, _hash long"


def test_stages_of_awkward_tables(spark):
    """Columns with clashing names, nulls anywhere, repeated rows and ids, empty and long texts, through all stages in a row."""
    import corpus_pipeline as c

    awkward = [(*r, 5, True, 9) for r in brute.rows()] + [(7, "w " * 30000, "en", None, None, "", "", 0, 0, False, 0)]
    docs = spark.createDataFrame(awkward, CLASHING).repartition(3)
    rows = [r[:5] for r in awkward]
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    spoken = c.language(spark, docs, SF)
    assert spoken.columns == list(c.COLUMNS) and set(plain(spoken)) <= set(rows)
    assert {r for r in rows if not re.search(r"[^\W\d_]", r[1] or "")}.isdisjoint(plain(spoken))
    near = plain(c.near_dedup(spark, docs, SF))
    sets = [brute.shingle_set(r[1], 5) for r in near]
    assert sum(map(bool, sets)) == len({comp for comp, s in zip(component_numbers(rows), map(lambda r: brute.shingle_set(r[1], 5), rows)) if s})
    cleared = c.suffix_dedup(spark, docs, SF)
    want = [(r[0], r[1] if not gone else left) for r, (left, gone) in zip(rows, brute.later_byte_repeats(rows, 200)) if not gone or left.strip()]
    assert cleared.columns == list(c.COLUMNS) and sorted(((r.doc_id, r.text) for r in cleared.collect()), key=repr) == sorted(want, key=repr)
    mixed = c.mix(spark, docs, SF)
    assert mixed.columns == list(c.COLUMNS) and set(plain(mixed)) <= set(rows)
    taken = mix_documents(docs).collect()
    assert mixed.count() == sum(r.copies for r in taken)
    packed = c.pack(spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)


def component_numbers(rows):
    """A number for each row's component at five words and 0.8, ids left aside."""
    numbered = [(i, *r[1:]) for i, r in enumerate(rows)]
    return [comp for _, _, comp in brute.near_components(numbered, 5)]


def test_stages_of_empty_tables_and_unlabelled_ones(spark):
    import corpus_pipeline as c

    none = spark.createDataFrame([], CLASHING)
    for name, stage in c.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0 and (name == "pack" or out.columns == list(c.COLUMNS))
    unlabelled = [(i, t, None, "s", None) for i, t in enumerate(["a text", "", None, "12"])]
    docs = spark.createDataFrame(unlabelled, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(tuple, c.language(spark, docs, SF).collect())) == unlabelled
