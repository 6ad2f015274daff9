"""Schemas. Order is a column (seg_idx, line_no, seq) and a media item a key: many items are processed at once."""

from __future__ import annotations

TIME_SEGMENT = "media_id string, seg_idx int, start_sec double, end_sec double"
SUBTITLE_CHUNK = "media_id string, seg_idx int, start_sec double, end_sec double, text string, speaker_id string"
SPEAKER_SEGMENT = "media_id string, seg_idx int, start_sec double, end_sec double, speaker_id string"
DETECTOR_LOG = "media_id string, line_no int, line string, total_sec double"
LLM_OUTPUT = "media_id string, batch_id int, raw string"
FEATURES = "media_id string, seg_idx int, vec array<double>"
LOG_ENTRY = "seq long, level string, message string"
PROGRESS = "media_id string, stage string, percent float, result_path string"
PIPELINE_CONFIG = "input_path string, output_format string, gguf_model_path string, ffmpeg_path string, vad_threshold_db string, sherpa_onnx_dir string"
#: One record of translated JSON; optional fields may be missing, unknown ones are ignored.
CHUNK_JSON = "start_sec double, end_sec double, text string, speaker_id string"
#: The same with the place in its item that the record was sent with.
ANSWER_JSON = "id long, " + CHUNK_JSON
REQUIRED = ("start_sec", "end_sec", "text")
