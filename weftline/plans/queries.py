"""Registered queries of the interval, transcript and vector operators. Times are whole microseconds, so results are exact."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.functions import text as T
from weftline.functions.vectors import argmax_last, argmin_first, cosine_distance, dot, pcm_to_float
from weftline.operators.batches import NO_SPEAKER, batch_json, cue_lines, last_rows, micro_batches, ordered_text, srt_documents, with_number
from weftline.operators.clustering import leader_clusters, speaker_labels
from weftline.operators.intervals import activity_islands, long_enough, or_whole, pad, parse_detector_log, speech_intervals, split_long, to_samples
from weftline.operators.joins import band_join, zip_positions
from weftline.operators.json_records import explode_records, objects
from weftline.operators.signal import energies, segment_features
from weftline.plans.adapters import ask, careless_translator, upper_translator
from weftline.plans.pipeline import translate

HOUR = 3_600_000_000
GAP, PAD, LEAST, MOST = 4 * HOUR, HOUR // 2, 2 * HOUR, 8 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> F.Column:
    """A timestamp without zone as microseconds of its wall clock, whatever the session's zone."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("t", micros("ts"))


def _islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity_islands(events(spark, sf_dir), "user_id", "t", GAP)


def q_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _islands(spark, sf_dir).select("user_id", F.col("island").cast("long").alias("island"), F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n")


def _padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_enough(pad(_islands(spark, sf_dir).select("user_id", "island", "start", "end"), PAD), LEAST)


def q_pad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _padded(spark, sf_dir).select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


def q_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_long(_padded(spark, sf_dir), MOST).select("user_id", F.col("island").cast("long").alias("island"), "piece", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


def q_fallback_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("media_id"), F.lit(24 * HOUR).alias("total"))
    found = _padded(spark, sf_dir).withColumnRenamed("user_id", "media_id")
    return or_whole(media, found).select("media_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


def q_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is an item, microseconds since the first event of all its time. An event of type error begins a silence; one of
    type view ends it, with a known time if its value is above 1."""
    x = events(spark, sf_dir)
    whole = x.agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    x = x.crossJoin(F.broadcast(whole))  # one row
    media = x.groupBy(F.col("user_id").alias("media_id")).agg(F.first(F.col("t1") - F.col("t0")).alias("total"))
    at = F.col("t") - F.col("t0")
    starts, ends = F.col("event_type") == "error", F.col("event_type") == "view"
    marks = x.filter(starts | ends).select(F.col("user_id").alias("media_id"), F.struct("t", "event_id").alias("line_no"), starts.alias("starts"), F.when(starts, at).alias("start_at"), ends.alias("ends"), F.when(ends & (F.col("value") > 1), at).alias("end_at"))
    return speech_intervals(media, marks).select("media_id", F.col("start").cast("long").alias("start_us"), F.col("end").cast("long").alias("end_us"))


def q_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the type of the first event of another user less than 30 s from it."""
    x = events(spark, sf_dir)
    left = x.select("event_id", "t", (F.col("user_id") % 2).alias("side"))
    right = x.select("t", "event_id", "event_type", (1 - F.col("user_id") % 2).alias("side"))
    return band_join(left, right, "event_id", ["side"], "t", "t", 30_000_000, "event_id", "event_type", "S?")


def q_microbatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = micro_batches(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"])
    record = F.concat(F.lit('{"turn":'), F.col("turn").cast("string"), F.lit(',"text":"'), T.escape_json(F.coalesce("text", F.lit(""))), F.lit('"}'))
    place = F.struct("turn", "role", "text")
    return x.groupBy("conv_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("[\n"), ordered_text(place, record, ",\n"), F.lit("\n]")).alias("json"))


def q_json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("Here it is:\n["), F.col("props"), F.lit("] and that was all."))
    got = F.from_json(T.between_brackets(raw), "array<struct<k: bigint>>")
    return table(spark, sf_dir, "events").select("event_id", F.size(got).alias("n"), got[0]["k"].alias("k"))


def q_json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("["), F.col("props"), F.lit(', {"k": oops, '), F.col("props"), F.lit(', {"k": "x"}, {"k": 7'))
    got = F.filter(F.transform(objects(raw), lambda o: F.from_json(o, "k bigint")), lambda r: r["k"].isNotNull())
    return table(spark, sf_dir, "events").select("event_id", F.size(got).alias("n"), F.aggregate(got, F.lit(0).cast("long"), lambda s, r: s + r["k"]).alias("total"))


def q_tag_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.between_tags(F.col("html"), "title").alias("title"))


def q_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    y = table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    return x.unionByName(y).filter(~T.is_blank(F.col("text"))).select("kind", "id", "turn", T.bracketed(T.trim_space(F.col("text"))).alias("text"))


def q_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.escape_json(F.col("text")).alias("escaped"))


def q_srt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item is a user, a cue an event: milliseconds since the first event, and one second more."""
    x = events(spark, sf_dir)
    x = x.crossJoin(F.broadcast(x.agg(F.min("t").alias("t0"))))  # one row
    x = with_number(x.filter(F.col("event_type") != "view"), ["user_id"], ["t", "event_id"], "number", 1)
    ms = F.floor((F.col("t") - F.col("t0") + 500) / 1000).cast("long")
    label = F.coalesce(F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string"))), F.lit(NO_SPEAKER))
    cue = F.format_string("%d\n%s --> %s\n[%s] %s\n\n", "number", T.srt_time_ms(ms), T.srt_time_ms(ms + 1000), label, F.col("event_type"))
    return x.select("user_id", "number", cue.alias("cue"))


def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    fmt = T.output_format(F.when(F.col("page_id") % 3 == 0, "MKV").otherwise(""), url)
    return table(spark, sf_dir, "pages").select("page_id", T.base_name(url).alias("base"), T.extension(url).alias("ext"), T.stem(url).alias("stem"), T.parent(url).alias("parent"), fmt.alias("fmt"), T.subtitle_codec(fmt).alias("codec"), T.video_output(url, fmt).alias("video"), T.srt_output(url).alias("srt"))


def q_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector and the one after it in its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    x = table(spark, sf_dir, "embeddings").withColumns({"next_id": F.lead("vec_id").over(w), "next": F.lead("embedding").over(w)})
    return x.filter(F.col("next_id").isNotNull()).select("vec_id", "next_id", F.round(cosine_distance(F.col("embedding"), F.col("next")), 9).alias("distance"))


def q_leader(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select(F.col("label").alias("media_id"), F.col("vec_id").alias("seg_idx"), F.col("embedding").alias("vec"))
    return speaker_labels(leader_clusters(x, 0.9)).select("media_id", "seg_idx", "cluster", "speaker_id")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return x.withColumn("x", F.round(F.col("x").cast("double"), 1))  # rounded, so that there are ties


def q_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).groupBy("vec_id").agg(argmax_last(F.col("x"), F.col("i")).alias("last_max"))


def q_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(spark, sf_dir).groupBy("vec_id").agg(argmin_first(F.col("x"), F.col("i")).alias("first_min"))


def q_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(dot(e, e), 9).alias("norm2"))


def q_band_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as signals of 64 samples: 4 bands, frames of 16, hop 8, at most 4 frames."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", energies(F.col("embedding"), bands=4, size=16, hop=8, most=4).alias("e"))
    return x.select("vec_id", F.posexplode("e").alias("band", "x")).select("vec_id", "band", F.round("x", 6).alias("energy"))


def q_speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return x.agg(F.count_distinct("role").alias("n_roles"), F.count(F.lit(1)).alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"))


def q_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return last_rows(events(spark, sf_dir).select("event_id", "t", "event_type"), ["t", "event_id"], 5000)


def q_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("asked"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("held"))
    x = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return x.select("o_orderkey", T.default_if_empty(F.col("asked"), T.default_if_empty(F.col("held"), "-40")).alias("value"))


def q_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels of two tables, each once with its number of rows."""
    a = table(spark, sf_dir, "conversations").select(F.col("role").alias("label"))
    b = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"))
    return a.unionByName(b).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def q_distinct_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered, each once: folders of a page's address, the fixed ones and again its own."""
    own = T.parent(F.col("url"))
    paths = F.array_distinct(F.array(own, F.lit("/tmp"), own, F.lit("/var/log"), F.lit("/tmp")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(paths, ";").alias("paths"), F.array_contains(paths, "/tmp").alias("has_tmp"))


def q_log_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARN").otherwise("INFO")
    x = events(spark, sf_dir).withColumn("level", level)
    return x.select("event_id", T.log_line(F.col("t") / 1_000_000, F.col("level"), F.col("event_type")).alias("line"), T.level_class(F.col("level")).alias("css"), T.log_copy(F.col("level"), F.col("event_type")).alias("copy"))


def q_translate_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a conversation through a translator that answers in upper case, matched to their turns by place."""
    order = ["turn", "role", "text"]
    x = micro_batches(table(spark, sf_dir, "conversations"), ["conv_id"], order)
    x = with_number(x, ["conv_id", "batch_id"], order, "pos").withColumn("text", F.coalesce("text", F.lit("")))
    record = F.to_json(F.struct(F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"), "text"))
    batches = x.groupBy("conv_id", "batch_id").agg(F.concat(F.lit("["), ordered_text(F.col("pos"), record, ","), F.lit("]")).alias("json"))
    answers = ask(batches, upper_translator).select("conv_id", "batch_id", F.posexplode(F.from_json("raw", "array<struct<text: string>>")).alias("pos", "r"))
    joined = x.join(answers, ["conv_id", "batch_id", "pos"], "left")
    return joined.select("conv_id", "turn", "role", F.coalesce(F.col("r.text"), T.bracketed(F.col("text"))).alias("text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chunks: a second and a half a turn, spoken by its role."""
    x = with_number(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], "seg_idx")
    return x.select(F.col("conv_id").cast("string").alias("media_id"), "seg_idx", (F.col("seg_idx") * 1.5).alias("start_sec"), (F.col("seg_idx") * 1.5 + 1).alias("end_sec"), F.coalesce("text", F.lit("")).alias("text"), F.col("role").alias("speaker_id"))


def q_translate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The translation stage with a translator that leaves records out, turns them round, repeats one and invents one."""
    x = _turns(spark, sf_dir)
    out = translate(x.withColumn("speaker_id", F.lit(None).cast("string")), x, careless_translator)
    return out.select("media_id", "seg_idx", "batch_id", "text", "speaker", "translated", "n_asked", "n_answered", "n_matched")


def q_batch_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = micro_batches(_turns(spark, sf_dir), ["media_id"], ["seg_idx"])
    return batch_json(x, ["media_id"], "seg_idx", "speaker_id").select("media_id", "batch_id", "n", "json")


def q_cue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_lines(_turns(spark, sf_dir).withColumn("speaker_id", F.when(F.col("speaker_id") != "user", F.col("speaker_id"))))


def q_srt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return srt_documents(_turns(spark, sf_dir))


def q_parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of four kinds: whole, with bare quotes inside a text, with a broken record among whole ones, without any."""
    x = table(spark, sf_dir, "events")
    one = F.concat(F.lit('{"start_sec":'), F.col("user_id").cast("string"), F.lit(',"end_sec":'), (F.col("user_id") + 1).cast("string"), F.lit(',"text":"'))
    word, kind = F.col("event_type"), F.col("event_id") % 4
    whole = F.concat(F.lit("Here:\n["), one, word, F.lit('"}, '), one, F.lit('more","speaker_id":"S1","x":1}]'))
    quoted = F.concat(F.lit("["), one, F.lit('say "'), word, F.lit('" twice"}]'))
    broken = F.concat(F.lit('[{"start_sec": oops}, '), one, word, F.lit('"}, {"end_sec":3,"text":"no start"}, {"start_sec":1]'))
    raw = F.when(kind == 0, whole).when(kind == 1, quoted).when(kind == 2, broken).otherwise(word)
    return explode_records(x.select("event_id", raw.alias("raw")))


def q_detector_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as the text of a detector's log, in whole seconds since the first event of all, read back to speech."""
    x = events(spark, sf_dir).filter(F.col("event_type").isin("error", "view", "click"))
    x = x.crossJoin(F.broadcast(events(spark, sf_dir).agg(F.min("t").alias("t0"), F.max("t").alias("t1"))))  # one row
    second = lambda c: F.floor((F.col(c) - F.col("t0")) / 1_000_000).cast("long")
    at = second("t").cast("string")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("[silencedetect @ 0x1] silence_start: "), at)).when(F.col("event_type") == "view", F.concat(F.lit("[silencedetect @ 0x1] silence_end: "), at, F.when(F.col("value") > 1, " | silence_duration: 1").otherwise(""))).otherwise("frame= 1")
    logs = x.groupBy(F.col("user_id").cast("string").alias("media_id")).agg(ordered_text(F.struct("t", "event_id"), line, "\n").alias("text"), F.max(second("t1")).cast("double").alias("total"))
    found = speech_intervals(logs.select("media_id", "total"), parse_detector_log(T.text_lines(logs.select("media_id", "text"), "text")))
    return found.select("media_id", F.col("start").cast("long").alias("start_s"), F.col("end").cast("long").alias("end_s"))


def q_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of orders in quarter seconds, before the start and beyond the end of a recording too, as sample numbers."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 40 / 4 - 1).alias("start_sec"), (F.col("o_custkey") % 50 / 4).alias("end_sec"), (F.col("o_orderkey") % 7 * 30_000).cast("long").alias("n_samples"))
    return to_samples(x).select("o_orderkey", "start_sample", "end_sample")


def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings, each eight times in a row, as audio of 512 samples; a whole segment and one too short for a frame."""
    audio = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("media_id"), F.flatten(F.array_repeat("embedding", 8)).alias("samples"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("seg_idx"), F.lit(0.032).alias("end_sec")), F.struct(F.lit(1).alias("seg_idx"), F.lit(0.01).alias("end_sec"))))
    segments = audio.select("media_id", ends.alias("s")).select("media_id", "s.seg_idx", F.lit(0.0).alias("start_sec"), "s.end_sec")
    return segment_features(audio, segments).select("media_id", "seg_idx", F.posexplode("vec").alias("band", "x")).select("media_id", "seg_idx", "band", F.round("x", 6).alias("energy"))


def q_decode_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as one token a byte, led by a special token and followed by one outside the vocabulary."""
    codes = F.transform(F.split("p_name", ""), lambda c: F.ascii(c))
    ids = F.concat(F.array(F.lit(256)), codes, F.array(F.lit(999), F.lit(-1)))
    return table(spark, sf_dir, "part").select("p_partkey", T.decode_tokens(ids, [bytes([b]) for b in range(256)] + [b"<s>"], [256]).alias("text"))


def q_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns beside the batch that they fall into, by place."""
    x = _turns(spark, sf_dir)
    return zip_positions(x.select("media_id", "seg_idx", "speaker_id"), micro_batches(x, ["media_id"], ["seg_idx"], 4).filter("batch_id > 0").select("media_id", "seg_idx", "batch_id"))


def q_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", pcm_to_float(F.col("l_partkey") % 65536 - 32768).alias("x"))


def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.translation_prompt(F.col("url"), "English", "German").alias("prompt"))


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, T.LEVELS)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", level.alias("level")).filter(T.level_at_least(F.col("level"), "WARN"))


def q_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: activity islands of each user, padded, filtered, split and numbered as subtitle cues."""
    x = split_long(_padded(spark, sf_dir), MOST)
    x = x.crossJoin(F.broadcast(events(spark, sf_dir).agg(F.min("t").alias("t0"))))  # one row
    x = with_number(x, ["user_id"], ["start", "end"], "number", 1)
    at = lambda c: T.srt_time_ms(F.floor((F.col(c) - F.col("t0")) / 1000).cast("long"))
    return x.select("user_id", "number", F.concat(at("start"), F.lit(" --> "), at("end")).alias("cue"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for name, f in list(globals().items()) if name.startswith("q_")}
