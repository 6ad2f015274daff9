import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions.vectors import cosine_distance, frames, hamming
from weftline.operators.batches import batch_json, cue_lines, last_rows, micro_batches, srt_documents
from weftline.operators.clustering import leader_clusters, leaders, speaker_counts, speaker_labels
from weftline.operators.intervals import split_long, to_samples, voice_segments
from weftline.operators.joins import band_join
from weftline.operators.json_records import explode_records, parse_records
from weftline.operators.signal import band_log_energy, segment_features
from weftline.plans.adapters import ask, extract_audio, tone_recognizer, upper_translator
from weftline.plans.pipeline import run, translate
from weftline.sources.config import AppConfig, append_log, load_config, log_paths, media_tool, merged, model_file, model_folder, resolve_input, save_config
from weftline.sources.sinks import mux, write_srt
from weftline.sources.wav import decode, duration, read_binary, samples, to_wav


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


def test_srt_time(spark):
    got = column(spark, [0.0, 1.0005, 59.9996, 3661.25, -5.0, 360000.0], T.srt_time, "double")
    assert got == ["00:00:00,000", "00:00:01,001", "00:01:00,000", "01:01:01,250", "00:00:00,000", "100:00:00,000"]


def test_between_tags(spark):
    assert column(spark, ["x<asr_text> hi </asr_text>", "<asr_text>hi", " hi ", "", "<asr_text>a\nb\n"], lambda c: T.between_tags(c, "asr_text")) == ["hi", "hi", "hi", "", "a\nb"]


def test_repair_quotes(spark):
    flat = '{"text":"a quiet lake"}'
    inner = '{"text":"the "old" mill","speaker_id":"S2"}'
    done = '{"text":"the \\"old\\" mill"}'
    path = '{"text":"C:\\\\mill\\\\wheel"}'
    got = column(spark, [flat, inner, done, path], T.repair_quotes)
    assert got == [flat, '{"text":"the \\"old\\" mill","speaker_id":"S2"}', done, path]


PARSED = [
    ('[{"start_sec":2.5,"end_sec":4.0,"text":"Øre","speaker_id":"S2"}]', [(2.5, 4.0, "Øre", "S2")]),
    ('Well: [{"start_sec":0,"end_sec":1,"text":"a"}] that is it', [(0.0, 1.0, "a", None)]),
    ('Well: [{"start_sec":0,"end_sec":1,"text":"the "old" mill","speaker_id":"S1"}]', [(0.0, 1.0, 'the "old" mill', "S1")]),
    ("", None),
    ("no brackets", None),
    ("[]", []),
    ('[{"start_sec":0,"end_sec":1,"text":"a"},{"end_sec":2,"text":"b"}]', [(0.0, 1.0, "a", None)]),
    ('[{"start_sec":0,"end_sec":1,"text":""}]', [(0.0, 1.0, "", None)]),
    ('[{"start_sec":0,"end_sec": oops,, {"start_sec":1,"end_sec":2,"text":"да","x":1}]', [(1.0, 2.0, "да", None)]),
]


@pytest.mark.parametrize("raw,want", PARSED)
def test_parse_records(spark, raw, want):
    got = column(spark, [raw], parse_records)[0]
    assert (None if got is None else [tuple(r) for r in got]) == want


def test_explode_records(spark):
    x = spark.createDataFrame([("m", 0, PARSED[6][0]), ("m", 1, "nothing")], "media_id string, batch_id int, raw string")
    assert [(r.batch_id, r.pos, r.text) for r in explode_records(x).collect()] == [(0, 0, "a")]


VAD = [
    (["silence_start: 3.0", "silence_end: 4.0 | silence_duration: 1.0", "silence_start: 18.0"], 20, [(0, 3.1), (3.9, 11.9), (11.9, 18.1)]),
    ([], 10, [(0, 8), (8, 10)]),
    (["silence_start: 0"], 20, [(0, 20)]),
    (["silence_start: 1.0", "silence_end: 3.0 | x", "silence_start: 3.2", "silence_end: 5.0 | x"], 5, [(0, 1.1)]),
    (["silence_start: 3.0", "silence_end: 4.0"], 6, [(0, 3.1), (0, 6)]),
    (["noise", "silence_start: abc", "silence_start: 3 dB"], 6, [(0, 6)]),
]


@pytest.mark.parametrize("lines,total,want", VAD)
def test_voice_segments(spark, lines, total, want):
    media = spark.createDataFrame([("m", float(total))], "media_id string, total double")
    log = spark.createDataFrame([("m", i, f"[x] {s}") for i, s in enumerate(lines)], "media_id string, line_no int, line string")
    got = [(r.start_sec, r.end_sec) for r in voice_segments(media, log).orderBy("seg_idx").collect()]
    assert np.allclose(sorted(got), sorted(want))


def test_split_tiles_its_interval(spark):
    x = spark.createDataFrame([(1, 0.0, 8.0), (2, 1.5, 30.7), (3, 2.0, 2.1)], "id int, start double, end double")
    for i, lo, hi in [(1, 0.0, 8.0), (2, 1.5, 30.7), (3, 2.0, 2.1)]:
        got = sorted((r.start, r.end) for r in split_long(x).filter(F.col("id") == i).collect())
        assert got[0][0] == lo and got[-1][1] == hi and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_to_samples(spark):
    x = spark.createDataFrame([(-1.0, 0.5, 16000), (0.9, 2.0, 16000), (3.0, 4.0, 16000)], "start_sec double, end_sec double, n_samples long")
    assert [(r.start_sample, r.end_sample) for r in to_samples(x).collect()] == [(0, 8000), (14400, 16000)]


def test_band_join_takes_the_first_not_the_nearest(spark):
    speakers = spark.createDataFrame([("m", 0, 8.0, "A"), ("m", 1, 8.4, "B")], "media_id string, seg_idx int, start_sec double, speaker string")
    chunks = spark.createDataFrame([(1, "m", 8.4), (2, "m", 9.0), (3, "n", 8.0), (4, "m", 8.5)], "id int, media_id string, start_sec double")
    got = band_join(chunks, speakers, "id", ["media_id"], "start_sec", "start_sec", 0.5, "seg_idx", "speaker", "S?")
    assert {r.id: r.speaker for r in got.collect()} == {1: "A", 2: "S?", 3: "S?", 4: "B"}


def test_band_join_has_no_nested_loop(spark):
    x = spark.range(10).select(F.col("id"), F.lit("m").alias("media_id"), F.col("id").cast("double").alias("t"))
    plan = band_join(x, x.withColumnRenamed("id", "o"), "id", ["media_id"], "t", "t", 0.5, "o", "media_id", "?")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_micro_batches(spark):
    x = spark.createDataFrame([("m", i, float(i), i + 0.5, f't"{i}\n', "S1") for i in range(23)], "media_id string, seg_idx int, start_sec double, end_sec double, text string, who string")
    b = micro_batches(x, ["media_id"], ["seg_idx"])
    assert [r["count"] for r in b.groupBy("batch_id").count().orderBy("batch_id").collect()] == [10, 10, 3]
    docs = batch_json(b, ["media_id"], "seg_idx", "who").orderBy("batch_id").collect()
    assert docs[0].json.startswith('[\n  {"id":0,"start_sec":0,"end_sec":0.5,"text":"t\\"0\\n"')
    assert [r["text"] for d in docs for r in json.loads(d.json)] == [f't"{i}\n' for i in range(23)]


def test_srt(spark, tmp_path):
    x = spark.createDataFrame([("m", 0, 0.0, 1.0, "a", None), ("m", 1, 1.0, 2.0, "   ", "X"), ("m", 2, 2.0, 3.5, "b", "Speaker_2")], "media_id string, seg_idx int, start_sec double, end_sec double, text string, speaker_id string")
    assert [r.number for r in cue_lines(x).collect()] == [1, 2]
    want = "﻿1\n00:00:00,000 --> 00:00:01,000\n[Speaker] a\n\n2\n00:00:02,000 --> 00:00:03,500\n[Speaker_2] b\n\n"
    assert srt_documents(x).collect()[0].srt == want
    write_srt(x, str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").rglob("part-*")] == [want]


def test_cosine_and_leaders(spark):
    a = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in a.select(cosine_distance(F.col("a"), F.col("b"))).collect()] == [0.0, 2.0, 2.0]
    vectors = [(1.0, 0.0), (0.9, 0.1), (-1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    x = spark.createDataFrame([("m", i, list(v)) for i, v in enumerate(vectors)] + [("one", 0, [1.0, 2.0])], "media_id string, seg_idx int, vec array<double>")
    y = speaker_labels(leader_clusters(x))
    got = {(r.media_id, r.seg_idx): r.speaker_id for r in y.collect()}
    assert [got["m", i] for i in range(5)] == ["Speaker_1", "Speaker_1", "Speaker_2", "Speaker_3", "Speaker_4"] and got["one", 0] == "Speaker_1"
    assert {r.media_id: r.n_speakers for r in speaker_counts(y).collect()} == {"m": 4, "one": 1}


def test_leaders_against_a_plain_loop():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    out, firsts = [], []
    for v in x:
        d = [1 - v @ f / (np.linalg.norm(v) * np.linalg.norm(f)) for f in firsts]
        if d and min(d) < 0.7:
            out.append(int(np.argmin(d)))
        else:
            out.append(len(firsts))
            firsts.append(v)
    assert leaders(x, 0.7).tolist() == out


def test_features(spark):
    assert (band_log_energy(np.ones(383)) == 0).all() and band_log_energy(np.ones(384)).any()
    rng = np.random.default_rng(2)
    x = rng.normal(size=1000).astype(np.float32)
    count = (len(x) - 256) // 128
    n = np.arange(256)
    bands = np.zeros(13)
    for f in range(count):
        part = x[f * 128 : f * 128 + 256] * (0.54 - 0.46 * np.cos(2 * np.pi * n / 256))
        for k in range(129):
            bands[int(k / 129 * 13)] += abs((part * np.exp(-2j * np.pi * k * n / 256)).sum())
    assert np.allclose(band_log_energy(x), np.log(bands / count + 1e-10))
    audio = spark.createDataFrame([("m", x.tolist())], "media_id string, samples array<float>")
    segments = spark.createDataFrame([("m", 0, 0.0, 1.0), ("m", 1, 0.0, 0.02)], "media_id string, seg_idx int, start_sec double, end_sec double")
    got = {r.seg_idx: r.vec for r in segment_features(audio, segments).collect()}
    assert np.allclose(got[0], band_log_energy(x)) and not any(got[1])


def test_frames_and_window(spark):
    x = spark.createDataFrame([(list(range(20)),)], "s array<int>")
    assert x.select(frames(F.col("s"), 8, 4, 100)).first()[0] == [list(range(a, a + 8)) for a in (0, 4, 8)]
    assert abs(spark.range(1).select(hamming(F.lit(128))).first()[0] - 1.0) < 1e-12


def test_paths(spark):
    x = spark.createDataFrame([("/a/b.mp4", "mkv"), ("x.MOV", ""), ("noext", None), (".mp4", "")], "p string, f string")
    fmt = T.output_format(F.col("f"), F.col("p"))
    got = x.select(fmt, T.subtitle_codec(fmt), T.video_output(F.col("p"), fmt), T.srt_output(F.col("p"))).collect()
    assert tuple(got[0]) == ("mkv", "srt", "/a/b_subbed.mkv", "/a/b_subs.srt")
    assert got[1][0] == "MOV" and got[2][0] == "mp4" and got[3][0] == "mp4"


def test_log_functions(spark):
    x = spark.createDataFrame([(86_400 * 3 + 3661, "ERROR", "m")], "s long, level string, message string")
    got = x.select(T.log_line(F.col("s"), F.col("level"), F.col("message")), T.level_class(F.col("level"))).first()
    assert tuple(got) == ("01:01:01 [ERROR] m", "log-error")
    assert last_rows(spark.range(5001).withColumnRenamed("id", "seq"), ["seq"]).agg(F.min("seq"), F.count("seq")).first()[:] == (1, 5000)


def test_numbers(spark):
    assert column(spark, [0.0, 8.0, 1.5, 12345678.25, 0.0001], T.plain_number, "double") == ["0", "8", "1.5", "12345678.25", "0.0001"]


def test_config(tmp_path):
    p = tmp_path / "c" / "config.toml"
    assert load_config(p) == AppConfig() and p.exists()
    save_config(p, held := AppConfig("mkv", 'a"\\b', None, "-30", None))
    assert load_config(p) == held
    p.write_text('ffmpeg_path = "x"\n')
    assert load_config(p) == AppConfig()
    assert merged({"vad_threshold_db": "", "sherpa_onnx_dir": None}, AppConfig(sherpa_onnx_dir="d", gguf_model_path="g")) == AppConfig("mp4", None, None, "-40", "d")


def test_lookups(tmp_path):
    (tmp_path / "test").mkdir()
    (tmp_path / "test" / "a.mp4").touch()
    assert resolve_input(str(tmp_path / "a.mp4")) == str(tmp_path / "test" / "a.mp4")
    assert resolve_input("/none/x.mp4") == "/none/x.mp4"
    for f in ("encoder.onnx", "encoder.int8.onnx"):
        (tmp_path / f).touch()
    assert model_file(str(tmp_path), "encoder").name == "encoder.int8.onnx" and model_file(str(tmp_path), "x") is None
    assert model_folder("/none", (str(tmp_path),)) == str(tmp_path) and model_folder("/none") == "/none"
    assert media_tool(None, "no-such-tool") == "no-such-tool"
    paths = log_paths([str(tmp_path), str(tmp_path), "/proc/none"])
    append_log(paths, "x")
    assert len(paths) == 2 and paths[0].read_text() == "x\n"


def tone(seconds, level=0.5, hz=440):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * 16000)) / 16000)


def test_wav(spark, tmp_path):
    x = tone(0.5)
    assert decode(to_wav(x))[0] == 16000 and np.allclose(decode(to_wav(x))[1], x, atol=1e-4) and decode(b"junk") [0] == 0
    (tmp_path / "a.wav").write_bytes(to_wav(x))
    got = read_binary(spark, str(tmp_path)).select(duration(F.col("content")).alias("d"), samples(F.col("content")).alias("s")).first()
    assert got.d == 0.5 and got.s.rate == 16000 and len(got.s.samples) == 8000


def test_pipeline(spark):
    quiet = np.zeros(16000)
    files = [("one", to_wav(np.concatenate([tone(2), quiet, tone(10, 0.3, 2000), quiet]))), ("silent", to_wav(np.zeros(32000)))]
    stages = []
    out = run(spark.createDataFrame(files, "media_id string, content binary"), tone_recognizer, upper_translator, on_progress=lambda *a: stages.append(a[:2]))
    assert stages == [("extract", 5), ("vad", 15), ("stt", 30), ("diarize", 50), ("translate", 70), ("mux", 90)]
    text = {r.media_id: r.srt for r in out["srt"].collect()}
    assert set(text) == {"one"} and "TONE" in text["one"] and text["one"].count("-->") == 3
    assert {r.media_id: (r.stage, r.error) for r in out["status"].collect()} == {"one": ("done", None), "silent": ("error", "nothing was recognised")}
    assert {r.translated for r in out["translated"].collect()} == {True}
    with pytest.raises(ValueError):
        run(spark.range(1), tone_recognizer)


def test_translation_falls_back_to_brackets(spark):
    chunks = spark.createDataFrame([("m", i, float(i), i + 1.0, t, None) for i, t in enumerate(["a", " ", "c"])], "media_id string, seg_idx int, start_sec double, end_sec double, text string, speaker_id string")
    speakers = spark.createDataFrame([("m", 0, 0.0, 1.0, "Speaker_1")], "media_id string, seg_idx int, start_sec double, end_sec double, speaker_id string")

    def broken():
        def fail(prompt):
            raise RuntimeError

        return fail

    assert sorted((r.text, r.speaker, r.n_asked, r.n_answered, r.n_matched) for r in translate(chunks, speakers, broken).collect()) == [("[a]", "Speaker_1", 3, 0, 0), ("[c]", "S?", 3, 0, 0)]
    assert [r.text for r in translate(chunks, speakers, None).orderBy("seg_idx").collect()] == ["a", " ", "c"]


def test_adapters_report_failures(spark, tmp_path):
    srt = tmp_path / "s.srt"
    srt.write_text("x")
    items = spark.createDataFrame([("m", "v", str(srt), "srt", "o", str(tmp_path / "v_subs.srt"))], "media_id string, video string, srt string, codec string, output string, srt_output string")

    def fail(*a):
        raise RuntimeError("no tool")

    got = mux(items, fail).first()
    assert (got.muxed, got.error, (tmp_path / "v_subs.srt").read_text()) == (False, "no tool", "x")
    bad = extract_audio(spark.createDataFrame([("m", "/none")], "media_id string, video string"), "false").first()
    assert bad.content is None and bad.error is not None
    assert ask(spark.createDataFrame([("m", "broken")], "media_id string, json string"), upper_translator).first().raw == ""


def test_log_stream(spark, tmp_path):
    from weftline.sources.sinks import append_logs
    from weftline.streaming.progress import follow, log_stream

    append_logs(spark.createDataFrame([(i, "INFO", str(i)) for i in range(20)], "seq long, level string, message string"), str(tmp_path / "log"))
    seen = []
    q = follow(log_stream(spark, str(tmp_path / "log")), lambda df, epoch: seen.extend(r.seq for r in df.collect()), str(tmp_path / "state"), 5)
    q.awaitTermination()
    assert seen == [19, 18, 17, 16, 15]


def test_levels(spark):
    assert column(spark, ["ERROR", "INFO", "DEBUG"], T.level_at_least) == [True, True, False]


CHUNKS = "media_id string, seg_idx int, start_sec double, end_sec double, text string, speaker_id string"


def chunks_of(spark, texts):
    x = spark.createDataFrame([("m", i, i * 2.0, i * 2.0 + 1, t, None) for i, t in enumerate(texts)], CHUNKS)
    return x, spark.createDataFrame([("m", 0, 0.0, 1.0, "Speaker_1")], "media_id string, seg_idx int, start_sec double, end_sec double, speaker_id string")


def test_answers_find_their_rows(spark, tmp_path):
    """A translator that drops, adds, repeats and turns records round; and one call a batch."""
    calls = str(tmp_path)

    def careless():
        def run(prompt):
            import uuid

            open(f"{calls}/{uuid.uuid4().hex}", "w").close()
            assert prompt.startswith("Translate") and prompt.endswith("Output:")
            got = json.loads(prompt[prompt.index("Input: ") + 7 : prompt.rindex("\n\nOutput:")])
            out = [r | {"text": f"new {r['text']}"} for r in got if r["id"] not in (0, 13)]
            del out[1]["id"]  # found by its start
            return json.dumps([*out[::-1], {"id": 99, "start_sec": 1, "end_sec": 2, "text": "stray"}, out[0] | {"text": "again"}])

        return run

    chunks, speakers = chunks_of(spark, [f"t{i}" for i in range(23)])
    got = sorted(translate(chunks, speakers, careless).collect(), key=lambda r: r.seg_idx)  # a sort by Spark would run it twice, to sample
    assert [r.text for r in got] == [f"[t{i}]" if i in (0, 13) else f"new t{i}" for i in range(23)]
    assert [r.translated for r in got] == [i not in (0, 13) for i in range(23)]
    assert {(r.batch_id, r.n_asked, r.n_answered, r.n_matched) for r in got} == {(0, 10, 11, 9), (1, 10, 11, 9), (2, 3, 5, 3)}
    assert len(list(tmp_path.iterdir())) == 3


def test_limits_of_prompts_and_answers(spark):
    from weftline.plans.adapters import Limits, count_tokens, cut_tokens

    assert [cut_tokens("one, two  three", n) for n in (0, 1, 2, 3, 4, 9)] == ["", "one", "one,", "one, two", "one, two  three", "one, two  three"]
    assert count_tokens("one, two  three") == 4
    chunks, speakers = chunks_of(spark, ["short", " ", "word " * 400, *(f"t{i}" for i in range(8))])
    got = {r.seg_idx: r.text for r in translate(chunks, speakers, upper_translator, limits=Limits(prompt=300)).collect()}
    assert got[0] == "[short]" and 1 not in got and got[10] == "T7"  # the first prompt is too long, blank rows go
    cut = {r.seg_idx: r.text for r in translate(*chunks_of(spark, [f"t{i}" for i in range(5)]), upper_translator, limits=Limits(answer=70)).collect()}
    assert cut == {i: f"[t{i}]" for i in range(5)}  # an answer without its end is none


def test_recognised_text_is_cut(spark):
    from weftline.plans.adapters import recognize

    x = spark.createDataFrame([("m", 0, 0.0, 1.0, [0.0] * 4)], "media_id string, seg_idx int, start_sec double, end_sec double, slice array<float>")
    assert recognize(x, lambda: lambda slices, rate: ["a b c d e"] * len(slices), most_tokens=3).first().text == "a b c"


def test_models_are_made_once_and_errors_remembered(tmp_path):
    from weftline.plans import adapters

    made = []

    def factory():
        made.append(1)
        return "model"

    def broken():
        made.append(2)
        raise OSError("no such model")

    key = "a key of this test"
    assert [adapters._made(key, factory) for _ in range(3)] == ["model"] * 3 and made == [1]
    for _ in range(2):
        with pytest.raises(OSError):
            adapters._made(key + "2", broken)
    assert made == [1, 2]


def test_decode_tokens(spark):
    vocabulary = ["д".encode()[:1], "д".encode()[1:], b" ok", b"</s>"]
    assert column(spark, [[0, 1, 2, 3, 7, -1], [0, 2], [], None], lambda c: T.decode_tokens(c, vocabulary, [3]), "array<int>") == ["д ok", "\ufffd ok", "", None]


def test_text_lines(spark):
    x = spark.createDataFrame([("m", "a\r\nb\n\nc"), ("n", "")], "media_id string, text string")
    assert [tuple(r) for r in T.text_lines(x, "text").orderBy("media_id", "line_no").collect()] == [("m", 0, "a"), ("m", 1, "b"), ("m", 2, ""), ("m", 3, "c"), ("n", 0, "")]


def test_trim_and_blank_know_all_white_space(spark):
    assert set(T.SPACES) == {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isspace() and not 0x1C <= c <= 0x1F}
    texts = [f"{T.SPACES}a b{T.SPACES}", T.SPACES, "", "\u200b", "x", *T.SPACES, None]
    assert column(spark, texts, T.trim_space) == [None if t is None else t.strip(T.SPACES) for t in texts]
    assert column(spark, texts, T.is_blank) == [None if t is None else not t.strip(T.SPACES) for t in texts]


def test_band_join_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    a = [(i, rng.choice("xy"), rng.randint(-300, 300)) for i in range(300)]
    b = [(rng.randint(0, 40), rng.choice("xyz"), rng.choice([5, 5, 5, rng.randint(-300, 300)]), f"v{i}") for i in range(300)]
    left, right = spark.createDataFrame(a, "id long, k string, t long"), spark.createDataFrame(b, "o long, k string, t long, v string")
    for width in (1, 7, 100):
        got = {r.id: r.v for r in band_join(left, right, "id", ["k"], "t", "t", width, "o", "v", "?").collect()}
        assert got == {i: min(((o, v) for o, kk, tt, v in b if kk == k and abs(tt - t) < width), default=(0, "?"))[1] for i, k, t in a}
    none = band_join(left, right.limit(0), "id", ["k"], "t", "t", 5, "o", "v", "?")
    assert {r.v for r in none.collect()} == {"?"}


def test_stored_stages_run_once(spark, tmp_path):
    from weftline.plans.pipeline import stored_under

    calls = tmp_path / "calls"
    calls.mkdir()

    def counting():
        model = tone_recognizer()

        def run_(slices, rate):
            import uuid

            (calls / uuid.uuid4().hex).touch()
            return model(slices, rate)

        return run_

    files = spark.createDataFrame([("one", to_wav(np.concatenate([tone(2), np.zeros(16000), tone(1)])))], "media_id string, content binary").coalesce(1)
    told = []
    out = run(files, counting, upper_translator, on_progress=lambda *a: told.append(a), store=stored_under(str(tmp_path / "run")))
    for name in ("srt", "status", "speakers"):
        out[name].collect()
    assert len(list(calls.iterdir())) == 1
    assert [t[:2] for t in told] == [("extract", 5), ("vad", 15), ("stt", 30), ("diarize", 50), ("translate", 70), ("mux", 90)] and all(t[2] > 0 for t in told)


def test_stages_name_what_they_lack(spark):
    from weftline.plans.pipeline import detect, diarize, transcribe

    audio = spark.createDataFrame([("m", [0.0], 1, 1.0)], "media_id string, samples array<float>, n_samples long, total double")
    for call in (lambda: detect(audio.drop("total")), lambda: transcribe(audio, audio, tone_recognizer), lambda: diarize(audio, audio), lambda: translate(audio, audio, None)):
        with pytest.raises(ValueError, match="lack the column"):
            call()


def test_one_run_at_a_time(spark):
    from weftline.plans.pipeline import Runs

    runs, seen = Runs(), []
    files = spark.createDataFrame([("m", to_wav(tone(1)))], "media_id string, content binary")

    def progress(*a):
        seen.append(runs.busy())
        with pytest.raises(RuntimeError):
            runs.process(files, tone_recognizer)

    assert set(runs.process(files, tone_recognizer, on_progress=progress)) > {"srt", "status"}
    assert all(seen) and not runs.busy()


def test_unattended_runs():
    from weftline.plans.pipeline import unattended
    from weftline.sources.config import missing_settings

    whole, told = AppConfig(gguf_model_path="g", sherpa_onnx_dir="d"), []
    tell = lambda *a: told.append(a)
    assert not unattended({}, whole, None, tell) and not unattended({"WEFTLINE_INPUT": "v"}, AppConfig(), None, tell) and told == []
    assert unattended({"WEFTLINE_INPUT": "v"}, whole, lambda path, config: path + ".out", tell) and told == [("started", 0, None), ("done", 100, "v.out")]
    assert not unattended({"WEFTLINE_INPUT": "v"}, whole, lambda path, config: 1 // 0, tell) and told[-1] == ("error", 0, None)
    assert missing_settings(AppConfig(), "") == ["input_path", "gguf_model_path", "sherpa_onnx_dir"] and missing_settings(whole, "v") == []


def test_places_side_by_side(spark):
    from weftline.operators.joins import zip_positions

    a = spark.createDataFrame([("m", 0, "a"), ("m", 1, "b")], "media_id string, seg_idx int, x string")
    b = spark.createDataFrame([("m", 1, "c"), ("n", 0, "d")], "media_id string, seg_idx int, y string")
    assert [tuple(r) for r in zip_positions(a, b).collect()] == [("m", 1, "b", "c")]


def test_videos_are_listed_and_samples_scaled(spark, tmp_path):
    from weftline.functions.vectors import pcm_to_float
    from weftline.sources.wav import list_videos

    for name in ("a.mp4", "b.mkv", "c.txt"):
        (tmp_path / name).write_bytes(b"xy")
    assert sorted(r.media_id.rsplit("/", 1)[1] for r in list_videos(spark, str(tmp_path)).collect()) == ["a.mp4", "b.mkv"]
    assert column(spark, [-32768, 0, 16384], pcm_to_float, "int") == [-1.0, 0.0, 0.5]


def test_files_are_muxed(spark, tmp_path):
    from weftline.sources.sinks import tool_muxer

    tool = tmp_path / "tool"
    tool.write_text('#!/bin/sh\nfor last; do :; done\necho "$@" > "$last"\n')
    tool.chmod(0o755)
    item = spark.createDataFrame([("m", "v.mp4", "s.srt", "mov_text", str(tmp_path / "o.mp4"), "x")], "media_id string, video string, srt string, codec string, output string, srt_output string")
    got = mux(item, tool_muxer(str(tool))).first()
    assert (got.muxed, got.error, got.result_path) == (True, None, str(tmp_path / "o.mp4"))
    assert "-i v.mp4 -i s.srt" in (tmp_path / "o.mp4").read_text() and "-c:s mov_text" in (tmp_path / "o.mp4").read_text()
