"""Schemas of the documents and tables that the engine reads; JSON is read with these, never by inference."""

from __future__ import annotations

WORD = "STRUCT<word:STRING,text:STRING,start:DOUBLE,`end`:DOUBLE,probability:DOUBLE>"
SEGMENT = f"STRUCT<text:STRING,start:DOUBLE,`end`:DOUBLE,words:ARRAY<{WORD}>,confidence:STRUCT<avg:DOUBLE,min:DOUBLE>>"
TOKEN = "STRUCT<text:STRING,offsets:STRUCT<`from`:BIGINT,`to`:BIGINT>,p:DOUBLE>"
RAW = f"STRUCT<timestamps:STRUCT<`from`:STRING,`to`:STRING>,offsets:STRUCT<`from`:BIGINT,`to`:BIGINT>,text:STRING,tokens:ARRAY<{TOKEN}>>"

#: Both layouts of a transcript in one schema; which of the two a file has shows in what is null.
TRANSCRIPT = f"audio_info STRUCT<duration:BIGINT>, result STRUCT<text:STRING,segments:ARRAY<{SEGMENT}>>, _device STRING, detected_language STRING, _source STRING, _label STRING, transcription ARRAY<{RAW}>"

SEGMENTS = "session_id STRING, seg_idx INT, text STRING, start_ms BIGINT, end_ms BIGINT"
FRAMES = "session_id STRING, frame_idx INT, ts_ms BIGINT, text STRING, confidence DOUBLE, box ARRAY<ARRAY<DOUBLE>>"
LINES = "session_id STRING, frame_idx INT, line_idx INT, text STRING, confidence DOUBLE, box ARRAY<ARRAY<INT>>"
TRANSLATION = "session_id STRING, seg_idx INT, src STRING, dst STRING, src_lang STRING, dst_lang STRING, start_time BIGINT, end_time BIGINT, speaker STRING"
TIMINGS = TRANSLATION + ", actual_start_time BIGINT, actual_end_time BIGINT, tts_duration_ms BIGINT, stretched_duration_ms BIGINT"
TASKS = "id STRING, url STRING, title STRING, status STRING, current_stage STRING, session_path STRING, final_video_path STRING, error_message STRING, created_at STRING, started_at STRING, completed_at STRING"
TASK_STAGES = "task_id STRING, name STRING, label STRING, status STRING, started_at STRING, completed_at STRING, last_message STRING, error_message STRING, progress INT"
BENCH_RESULTS = "engine STRING, device STRING, text_key STRING, text_len INT, load_time_s DOUBLE, generate_time_s DOUBLE, total_time_s DOUBLE, output_samples BIGINT, output_duration_s DOUBLE, auto_patches INT, rtf DOUBLE"
MESSAGES = "type STRING, stage STRING, task_id STRING, progress INT, message STRING, error STRING"

# Stages in order, with their labels.
STAGES = [
    ("download", "Download"), ("separate", "Separate"), ("asr", "Transcribe"), ("asr_fix", "Fix transcript"), ("ocr", "Read subtitles"), ("ocr_fix", "Fix subtitles"),
    ("translate", "Translate"), ("split_audio", "Split audio"), ("tts", "Synthesise"), ("merge_audio", "Merge audio"), ("merge_video", "Merge video"),
]
