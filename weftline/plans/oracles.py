"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from weftline.functions.text import SPACE

_HOUR = 3_600_000_000
_EVENTS = "e AS (SELECT *, epoch_us(ts) AS t FROM events)"
_ISLANDS = f"""{_EVENTS},
m AS (SELECT user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= {4 * _HOUR} THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT user_id, t, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m),
g AS (SELECT user_id, island, min(t) AS s, max(t) AS f, count(*) AS n FROM i GROUP BY ALL)"""
_PADDED = f"""{_ISLANDS},
p AS (SELECT user_id, island, greatest(s - {_HOUR // 2}, 0) AS s, f + {_HOUR // 2} AS f FROM g WHERE f + {_HOUR // 2} - greatest(s - {_HOUR // 2}, 0) >= {2 * _HOUR})"""
_SPLIT = f"""{_PADDED},
k AS (SELECT user_id, island, s, f, CASE WHEN f - s > {8 * _HOUR} THEN (f - s + {8 * _HOUR - 1}) // {8 * _HOUR} - 1 ELSE 0 END AS last FROM p),
x AS (SELECT *, unnest(range(0, last + 1)) AS piece FROM k),
c AS (SELECT user_id, island, CAST(piece AS INTEGER) AS piece, s + piece * {8 * _HOUR} AS s, CASE WHEN piece < last THEN s + (piece + 1) * {8 * _HOUR} ELSE f END AS f FROM x)"""


def _srt(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', greatest({ms}, 0) // 3600000, greatest({ms}, 0) // 60000 % 60, greatest({ms}, 0) // 1000 % 60, greatest({ms}, 0) % 1000)"


def _escape(c: str) -> str:
    return f"""replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"""


_EXT = r"regexp_extract(url, '[^/\\.][^/\\]*\.([^./\\]*)$', 1)"
_BASE = r"regexp_extract(url, '[^/\\]+$', 0)"
_STEM = rf"CASE WHEN {_EXT} <> '' THEN regexp_replace({_BASE}, '\.[^.]*$', '') ELSE {_BASE} END"
_AT = r"regexp_extract(url, '^(.*[/\\])[^/\\]*$', 1)"
_FMT = f"coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN 'MKV' ELSE '' END, ''), nullif({_EXT}, ''), 'mp4')"
_PARENT = r"regexp_extract(url, '^(.*)[/\\][^/\\]*$', 1)"

_BLANK = f"regexp_replace(text, '{SPACE}', '', 'g') = ''"
_TURNS = "t AS (SELECT CAST(conv_id AS VARCHAR) AS media_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS seg_idx, role, coalesce(text, '') AS text FROM conversations)"
_CUE = f"number || chr(10) || {_srt('ms')} || ' --> ' || {_srt('(ms + 1000)')} || chr(10) || '[' || label || '] ' || text || chr(10) || chr(10)"
_CUES = lambda label: f"{_TURNS}, c AS (SELECT media_id, seg_idx * 1500 AS ms, {label} AS label, text, CAST(row_number() OVER (PARTITION BY media_id ORDER BY seg_idx) AS INTEGER) AS number FROM t WHERE NOT ({_BLANK}))"
_SECONDS = lambda factor: f"regexp_replace(CAST({factor} AS VARCHAR), '\\.0$', '')"
_UPPER = "translate({}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"

ORACLES: dict[str, str] = {
    "q_translate_gaps": f"""WITH {_TURNS},
b AS (SELECT *, seg_idx // 10 AS batch_id, seg_idx % 3 > 0 AS kept FROM t),
n AS (SELECT media_id, batch_id, count(*) AS n_asked, count(*) FILTER (kept) AS n_matched FROM b GROUP BY ALL)
SELECT media_id, seg_idx, CAST(batch_id AS INTEGER) AS batch_id, CASE WHEN kept THEN {_UPPER.format('text')} ELSE '[' || text || ']' END AS text, role AS speaker, kept AS translated,
n_asked, n_matched + 1 + CASE WHEN n_matched > 0 THEN 1 ELSE 0 END AS n_answered, n_matched FROM b JOIN n USING (media_id, batch_id) WHERE kept OR NOT ({_BLANK})""",
    "q_batch_json": f"""WITH {_TURNS}
SELECT media_id, CAST(seg_idx // 10 AS INTEGER) AS batch_id, count(*) AS n, '[' || chr(10) || string_agg('  {{"id":' || seg_idx || ',"start_sec":' || {_SECONDS('CAST(seg_idx * 1.5 AS DOUBLE)')} || ',"end_sec":' || {_SECONDS('CAST(seg_idx * 1.5 + 1 AS DOUBLE)')} || ',"text":"' || {_escape('text')} || '","speaker_id":"' || role || '"}}', ',' || chr(10) ORDER BY seg_idx) || chr(10) || ']' AS json
FROM t GROUP BY media_id, seg_idx // 10""",
    "q_cue_lines": f"WITH {_CUES("CASE WHEN role <> 'user' THEN role ELSE 'Speaker' END")} SELECT media_id, number, {_CUE} AS cue FROM c",
    "q_srt_documents": f"WITH {_CUES('role')} SELECT media_id, chr(65279) || string_agg({_CUE}, '' ORDER BY number) AS srt FROM c GROUP BY media_id",
    "q_parse_records": """WITH e AS (SELECT event_id, event_id % 4 AS kind, user_id::DOUBLE AS s, event_type AS word FROM events)
SELECT event_id, 0 AS pos, s AS start_sec, s + 1 AS end_sec, CASE WHEN kind = 1 THEN 'say "' || word || '" twice' ELSE word END AS text, NULL::VARCHAR AS speaker_id FROM e WHERE kind < 3
UNION ALL SELECT event_id, 1, s, s + 1, 'more', 'S1' FROM e WHERE kind = 0""",
    "q_detector_log": f"""WITH {_EVENTS},
z AS (SELECT min(t) AS t0, (max(t) - min(t)) // 1000000 AS total FROM e),
m AS (SELECT user_id, t, event_id, (t - t0) // 1000000 AS pos, event_type = 'error' AS starts, CASE WHEN event_type = 'view' AND value > 1 THEN (t - t0) // 1000000 END AS end_at FROM e, z WHERE event_type IN ('error', 'view')),
b AS (SELECT *, coalesce(last_value(end_at IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM m),
l AS (SELECT user_id, arg_max(starts, (t, event_id)) AS silent, arg_max(end_at, (t, event_id)) FILTER (end_at IS NOT NULL) AS last_end FROM m GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM e WHERE event_type IN ('error', 'view', 'click'))
SELECT CAST(user_id AS VARCHAR) AS media_id, began AS start_s, pos AS end_s FROM b WHERE starts AND pos > began
UNION ALL
SELECT CAST(u.user_id AS VARCHAR), coalesce(last_end, 0), total FROM u LEFT JOIN l USING (user_id), z WHERE NOT coalesce(silent, false) AND total > coalesce(last_end, 0)""",
    "q_samples": """WITH s AS (SELECT o_orderkey, greatest(o_orderkey % 40 * 4000 - 16000, 0) AS start_sample, least(o_custkey % 50 * 4000, o_orderkey % 7 * 30000) AS end_sample FROM orders)
SELECT * FROM s WHERE start_sample < end_sample""",
    "q_features": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
f AS (SELECT vec_id, f, k, sum(x[(f * 128 + n) % 64 + 1] * (0.54 - 0.46 * cos(2 * pi() * n / 256)) * cos(2 * pi() * (k * n % 256) / 256)) AS re, sum(x[(f * 128 + n) % 64 + 1] * (0.54 - 0.46 * cos(2 * pi() * n / 256)) * sin(2 * pi() * (k * n % 256) / 256)) AS im
  FROM s, range(0, 2) a(f), range(0, 129) b(k), range(0, 256) c(n) GROUP BY ALL)
SELECT CAST(vec_id AS VARCHAR) AS media_id, 0 AS seg_idx, CAST(k * 13 // 129 AS INTEGER) AS band, round(ln(sum(sqrt(re * re + im * im)) / 2 + 1e-10), 6) AS energy FROM f GROUP BY ALL
UNION ALL SELECT CAST(vec_id AS VARCHAR), 1, CAST(b AS INTEGER), 0.0 FROM s, range(0, 13) r(b)""",
    "q_decode_tokens": "SELECT p_partkey, p_name AS text FROM part",
    "q_zip": f"WITH {_TURNS} SELECT media_id, seg_idx, role AS speaker_id, CAST(seg_idx // 4 AS INTEGER) AS batch_id FROM t WHERE seg_idx >= 4",
    "q_pcm": "SELECT l_orderkey, l_linenumber, (l_partkey % 65536 - 32768) / 32768.0::DOUBLE AS x FROM lineitem",
    "q_prompts": """SELECT page_id, 'Translate the texts of this JSON array from English to German. Answer with a JSON array of the same records only, each with its own id; escape double quotes inside texts.' || chr(10) || chr(10) || 'Input: ' || url || chr(10) || chr(10) || 'Output:' AS prompt FROM pages""",
    "q_levels": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'ERROR' ELSE 'WARN' END AS level FROM events WHERE event_id % 5 < 2",
    "q_islands": f"WITH {_ISLANDS} SELECT user_id, island, s AS start_us, f AS end_us, n FROM g",
    "q_pad_filter": f"WITH {_PADDED} SELECT user_id, s AS start_us, f AS end_us FROM p",
    "q_split": f"WITH {_SPLIT} SELECT user_id, island, piece, s AS start_us, f AS end_us FROM c",
    "q_fallback_interval": f"WITH {_PADDED} SELECT c_custkey AS media_id, coalesce(s, 0) AS start_us, CASE WHEN s IS NULL THEN {24 * _HOUR} ELSE f END AS end_us FROM customer LEFT JOIN p ON user_id = c_custkey",
    "q_complement": f"""WITH {_EVENTS},
z AS (SELECT min(t) AS t0, max(t) AS t1 FROM e),
m AS (SELECT user_id, t, event_id, t - t0 AS pos, event_type = 'error' AS starts, CASE WHEN event_type = 'view' AND value > 1 THEN t - t0 END AS end_at FROM e, z WHERE event_type IN ('error', 'view')),
b AS (SELECT *, coalesce(last_value(end_at IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM m),
l AS (SELECT user_id, arg_max(starts, (t, event_id)) AS silent, arg_max(end_at, (t, event_id)) FILTER (end_at IS NOT NULL) AS last_end FROM m GROUP BY user_id),
u AS (SELECT DISTINCT user_id FROM e)
SELECT user_id AS media_id, began AS start_us, pos AS end_us FROM b WHERE starts AND pos > began
UNION ALL
SELECT u.user_id, coalesce(last_end, 0), t1 - t0 FROM u LEFT JOIN l USING (user_id), z WHERE NOT coalesce(silent, false) AND t1 - t0 > coalesce(last_end, 0)""",
    "q_band_join": f"""WITH {_EVENTS},
h AS (SELECT a.event_id, arg_min(b.event_type, b.event_id) AS v FROM e a JOIN e b ON (a.user_id % 2) = (1 - b.user_id % 2) AND abs(a.t - b.t) < 30000000 GROUP BY a.event_id)
SELECT e.event_id, coalesce(v, 'S?') AS event_type FROM e LEFT JOIN h USING (event_id)""",
    "q_microbatch": f"""WITH b AS (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1) // 10 AS INTEGER) AS batch_id FROM conversations)
SELECT conv_id, batch_id, count(*) AS n, '[' || chr(10) || string_agg('{{"turn":' || turn || ',"text":"' || {_escape("coalesce(text, '')")} || '"}}', ',' || chr(10) ORDER BY turn, role, text) || chr(10) || ']' AS json FROM b GROUP BY conv_id, batch_id""",
    "q_json_extract": r"""WITH r AS (SELECT event_id, regexp_extract('Here it is:' || chr(10) || '[' || props || '] and that was all.', '\[.*\]', 0, 's') AS j FROM events)
SELECT event_id, CAST(json_array_length(j) AS INTEGER) AS n, CAST(json_extract(j, '$[0].k') AS BIGINT) AS k FROM r""",
    "q_json_salvage": r"""WITH r AS (SELECT event_id, regexp_extract_all('[' || props || ', {"k": oops, ' || props || ', {"k": "x"}, {"k": 7', '(\{[^{}]*\})', 1) AS o FROM events),
u AS (SELECT event_id, unnest(o) AS j FROM r),
v AS (SELECT event_id, CASE WHEN json_valid(j) THEN TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) END AS k FROM u)
SELECT event_id, CAST(count(k) AS INTEGER) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM v GROUP BY event_id""",
    "q_tag_text": rf"""SELECT page_id, regexp_replace(CASE WHEN instr(html, '<title>') > 0 THEN regexp_extract(html, '<title>(.*?)(?:</title>|\z)', 1, 's') ELSE html END, '^{SPACE}+|{SPACE}+$', '', 'g') AS title FROM pages""",
    "q_clean_text": f"""WITH a AS (SELECT 'document' AS kind, doc_id AS id, 0::BIGINT AS turn, text FROM documents UNION ALL SELECT 'turn', conv_id, turn, text FROM conversations)
SELECT kind, id, turn, '[' || regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') || ']' AS text FROM a WHERE regexp_replace(text, '{SPACE}', '', 'g') <> ''""",
    "q_escape": f"SELECT doc_id, {_escape('text')} AS escaped FROM documents",
    "q_srt_lines": f"""WITH {_EVENTS}, z AS (SELECT min(t) AS t0 FROM e),
r AS (SELECT user_id, event_type, (t - t0 + 500) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS number FROM e, z WHERE event_type <> 'view')
SELECT user_id, CAST(number AS INTEGER) AS number, number || chr(10) || {_srt('ms')} || ' --> ' || {_srt('(ms + 1000)')} || chr(10) || '[' || CASE WHEN user_id % 3 > 0 THEN 'S' || (user_id % 3) ELSE 'Speaker' END || '] ' || event_type || chr(10) || chr(10) AS cue FROM r""",
    "q_paths": f"""SELECT page_id, {_BASE} AS base, {_EXT} AS ext, {_STEM} AS stem, {_PARENT} AS parent, {_FMT} AS fmt, CASE WHEN lower({_FMT}) = 'mkv' THEN 'srt' ELSE 'mov_text' END AS codec,
{_AT} || ({_STEM}) || '_subbed.' || {_FMT} AS video, {_AT} || ({_STEM}) || '_subs.srt' AS srt FROM pages""",
    "q_cosine": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS a, lead(vec_id) OVER w AS next_id, (lead(embedding) OVER w)::DOUBLE[] AS b FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT vec_id, next_id, round(1 - list_cosine_similarity(a, b), 9) AS distance FROM n WHERE next_id IS NOT NULL""",
    "q_leader": """WITH RECURSIVE v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
r AS (
  SELECT label, vec_id, i, [e] AS held, 1 AS c FROM v WHERE i = 1
  UNION ALL
  SELECT label, vec_id, i, CASE WHEN near < 0.9 THEN held ELSE list_append(held, e) END, CASE WHEN near < 0.9 THEN list_position(d, near) ELSE len(held) + 1 END
  FROM (SELECT v.label, v.vec_id, v.i, v.e, r.held, list_transform(r.held, lambda h: 1 - list_cosine_similarity(h, v.e)) AS d, list_min(list_transform(r.held, lambda h: 1 - list_cosine_similarity(h, v.e))) AS near
        FROM r JOIN v ON v.label = r.label AND v.i = r.i + 1))
SELECT label AS media_id, vec_id AS seg_idx, CAST(c - 1 AS BIGINT) AS cluster, 'Speaker_' || c AS speaker_id FROM r""",
    "q_argmax": """WITH p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, round(unnest(embedding)::DOUBLE, 1) AS x FROM embeddings)
SELECT vec_id, CAST(arg_max(i, (x, i)) AS INTEGER) AS last_max FROM p GROUP BY vec_id""",
    "q_argmin": """WITH p AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, round(unnest(embedding)::DOUBLE, 1) AS x FROM embeddings)
SELECT vec_id, CAST(arg_min(i, (x, i)) AS INTEGER) AS first_min FROM p GROUP BY vec_id""",
    "q_norms": "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 9) AS norm2 FROM embeddings",
    "q_band_energy": """WITH s AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
f AS (SELECT vec_id, x, unnest(range(0, 4)) AS f FROM s),
k AS (SELECT vec_id, x, f, unnest(range(0, 9)) AS k FROM f),
n AS (SELECT vec_id, f, k, unnest(range(0, 16)) AS n, x FROM k),
d AS (SELECT vec_id, f, k, sum(x[f * 8 + n + 1] * (0.54 - 0.46 * cos(2 * pi() * n / 16)) * cos(2 * pi() * k * n / 16)) AS re, sum(x[f * 8 + n + 1] * (0.54 - 0.46 * cos(2 * pi() * n / 16)) * sin(2 * pi() * k * n / 16)) AS im FROM n GROUP BY ALL)
SELECT vec_id, CAST(floor(k / 9 * 4) AS INTEGER) AS band, round(ln(sum(sqrt(re * re + im * im)) / 4 + 1e-10), 6) AS energy FROM d GROUP BY ALL""",
    "q_speaker_counts": "SELECT conv_id, count(DISTINCT role) AS n_roles, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user FROM conversations GROUP BY conv_id",
    "q_tail": f"WITH {_EVENTS} SELECT event_id, t, event_type FROM e ORDER BY t DESC, event_id DESC LIMIT 5000",
    "q_defaults": """SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END, ''), coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), '-40')) AS value
FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "q_append": "SELECT label, count(*) AS n FROM (SELECT role AS label FROM conversations UNION ALL SELECT lang FROM documents) GROUP BY label",
    "q_distinct_paths": f"""WITH p AS (SELECT page_id, {_PARENT} AS own FROM pages)
SELECT page_id, CASE WHEN own = '/tmp' THEN '/tmp;/var/log' WHEN own = '/var/log' THEN '/var/log;/tmp' ELSE own || ';/tmp;/var/log' END AS paths, true AS has_tmp FROM p""",
    "q_log_format": f"""WITH {_EVENTS}, l AS (SELECT *, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END AS level FROM e)
SELECT event_id, strftime(ts, '%H:%M:%S') || ' [' || level || '] ' || event_type AS line, CASE level WHEN 'ERROR' THEN 'log-error' WHEN 'WARN' THEN 'log-warn' ELSE '' END AS css, '[' || level || '] ' || event_type AS copy FROM l""",
    "q_translate_stub": "SELECT conv_id, turn, role, translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS text FROM conversations",
    "q_cues": f"""WITH {_SPLIT}, z AS (SELECT min(t) AS t0 FROM e),
r AS (SELECT user_id, s - t0 AS s, f - t0 AS f, row_number() OVER (PARTITION BY user_id ORDER BY s, f) AS number FROM c, z)
SELECT user_id, CAST(number AS INTEGER) AS number, {_srt('CAST(floor(s / 1000) AS BIGINT)')} || ' --> ' || {_srt('CAST(floor(f / 1000) AS BIGINT)')} AS cue FROM r""",
}
