"""Text functions, built in but for the decoding of tokens."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: Unicode white space, written out so that any regex engine takes it the same way.
SPACE = r"[\s\x0B\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same, character by character.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """No character beside white space; found at the first other one, without rewriting the text."""
    return ~c.rlike(rf"[^{SPACE[1:-1]}]")


def bracketed(c: Column) -> Column:
    return F.concat(F.lit("["), c, F.lit("]"))


def default_if_empty(c: Column, default: str | Column) -> Column:
    """Empty counts as missing."""
    return F.coalesce(F.nullif(c, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def srt_time(seconds: Column) -> Column:
    """HH:MM:SS,mmm, half up to milliseconds, negative: 0; hours may take more than two digits."""
    return srt_time_ms(F.floor(seconds * 1000 + 0.5).cast("long"))


def srt_time_ms(ms: Column) -> Column:
    ms = F.greatest(ms, F.lit(0).cast("long"))
    part = lambda by, of: F.floor(ms / by).cast("long") % of
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("long"), part(60_000, 60), part(1000, 60), ms % 1000)


def between_tags(c: Column, tag: str) -> Column:
    """What stands between <tag> and </tag>, or to the end without the latter; without <tag> all of it; trimmed."""
    inside = F.regexp_extract(c, rf"(?s)<{tag}>(.*?)(?:</{tag}>|$(?!\n))", 1)
    return trim_space(F.when(F.instr(c, f"<{tag}>") > 0, inside).otherwise(c))


def escape_json(c: Column) -> Column:
    for raw, out in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(out))
    return c


def plain_number(c: Column) -> Column:
    """A double without exponent and without a fraction of zero: 0, 8, 1.5."""
    usual = (F.abs(c) < 1e7) & ((F.abs(c) >= 1e-3) | (c == 0))
    text = F.when(usual, c.cast("string")).otherwise(c.cast("decimal(38,12)").cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def json_record(number: Column, start: Column, end: Column, text: Column, speaker: Column) -> Column:
    parts = ('{"id":', number.cast("string"), ',"start_sec":', plain_number(start), ',"end_sec":', plain_number(end), ',"text":"', escape_json(text), '","speaker_id":"', speaker, '"}')
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def between_brackets(c: Column) -> Column:
    """From the first [ to the last ]; empty if there is no such stretch."""
    return F.regexp_extract(c, r"(?s)\[.*\]", 0)


def repair_quotes(c: Column) -> Column:
    """Escape quotes inside JSON strings: those that neither open after [ { , : nor close before , : ] }."""
    return F.regexp_replace(c, r'(?<!\\)(?<![\[{,:]\s{0,20})"(?!\s*[,:}\]])', r'\\"')


def extension(path: Column) -> Column:
    """Without the dot; empty if there is none, or if the name begins with its only dot."""
    return F.regexp_extract(path, r"[^/\\.][^/\\]*\.([^./\\]*)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(extension(path) != "", F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def _beside(path: Column, name: Column) -> Column:
    at = F.regexp_extract(path, r"^(.*[/\\])[^/\\]*$", 1)
    return F.concat(at, name)


def video_output(path: Column, fmt: Column) -> Column:
    return _beside(path, F.concat(stem(path), F.lit("_subbed."), fmt))


def srt_output(path: Column) -> Column:
    return _beside(path, F.concat(stem(path), F.lit("_subs.srt")))


def output_format(fmt: Column, path: Column) -> Column:
    return F.coalesce(F.nullif(fmt, F.lit("")), F.nullif(extension(path), F.lit("")), F.lit("mp4"))


def subtitle_codec(fmt: Column) -> Column:
    return F.when(F.lower(fmt) == "mkv", "srt").otherwise("mov_text")


def level_class(level: Column) -> Column:
    return F.when(level == "ERROR", "log-error").when(level == "WARN", "log-warn").otherwise("")


def log_copy(level: Column, message: Column) -> Column:
    return F.concat(F.lit("["), level, F.lit("] "), message)


def clock(seconds: Column) -> Column:
    """Epoch seconds as UTC HH:MM:SS."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("long") % 24, F.floor(s / 60).cast("long") % 60, s % 60)


def log_line(seconds: Column, level: Column, message: Column) -> Column:
    return F.concat(clock(seconds), F.lit(" "), log_copy(level, message))


#: What stands before and behind a batch's records in a prompt.
PROMPT_INPUT, PROMPT_OUTPUT = "\n\nInput: ", "\n\nOutput:"


def translation_prompt(batch_json: Column, source: str = "English", target: str = "Russian") -> Column:
    """What a translator is asked: a JSON array of the batch's records, to be answered by one of the same shape."""
    head = f"Translate the texts of this JSON array from {source} to {target}. Answer with a JSON array of the same records only, each with its own id; escape double quotes inside texts."
    return F.concat(F.lit(head + PROMPT_INPUT), batch_json, F.lit(PROMPT_OUTPUT))


def text_lines(x: DataFrame, text: str, line: str = "line", number: str = "line_no") -> DataFrame:
    """One row a line of a text, numbered from 0; line ends may be those of any system."""
    keys = [c for c in x.columns if c != text]
    return x.select(*keys, F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias(number, line))


def decode_tokens(ids: Column, vocabulary: Sequence[bytes], special: Sequence[int] = ()) -> Column:
    """The text of token ids (array<int>): bytes of all tokens that are neither special nor outside the vocabulary, one after the
    other, as UTF-8; what is no UTF-8 becomes U+FFFD."""
    drop = frozenset(special)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else b"".join(vocabulary[i] for i in x if 0 <= i < len(vocabulary) and i not in drop).decode("utf-8", "replace"))

    return run(ids)


#: Log levels, the most severe first.
LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")


def level_at_least(level: Column, least: str = "INFO") -> Column:
    """Whether an entry is severe enough to be kept."""
    return level.isin(*LEVELS[: LEVELS.index(least) + 1])
