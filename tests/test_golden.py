"""Cases worked out by hand, and folds against plain loops."""

import base64
import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from segloom.functions import columns as C
from segloom.operators import decoding, folds, intervals, islands
from segloom.plans import tables
from segloom.sources import transcripts
from segloom.streaming import messages

SEGMENTS = "session_id string, seg_idx int, text string, start_ms bigint, end_ms bigint"


def rows(spark, *spans, texts=None):
    return spark.createDataFrame([("s", i, (texts or {}).get(i, "a"), *span) for i, span in enumerate(spans)], SEGMENTS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("spans, want", [
    ([(1000, 2000), (2500, 3000), (3020, 4000)], [(900, 2300), (2400, 3010), (3010, 4300)]),
    ([(0, 1000), (1250, 2000)], [(0, 1150), (1200, 2300)]),
])
def test_pad(spark, spans, want):
    assert [(r.padded_start, r.padded_end) for r in islands.pad(rows(spark, *spans)).orderBy("seg_idx").collect()] == want


def test_schedule(spark):
    df = spark.createDataFrame([("s", 0, 1000, 2000, 900), ("s", 1, 2000, 3000, 1300), ("s", 2, 3000, 4000, 1000)], "session_id string, seg_idx int, start_ms bigint, end_ms bigint, dur_ms bigint")
    assert [(r.actual_start, r.actual_end) for r in folds.schedule(df).orderBy("seg_idx").collect()] == [(1000, 1900), (2000, 3238), (3238, 4190)]


@pytest.mark.parametrize("end, fragments, want", [(1000, ["aaaaa", "b" * 15], [(0, 250), (250, 1000)]), (150, ["aaaaa", "bbbbb"], [(0, 200), (200, 300)])])
def test_cues(spark, end, fragments, want):
    df = spark.createDataFrame([("s", 0, 0, end, fragments)], "session_id string, seg_idx int, start_ms bigint, end_ms bigint, fragments array<string>")
    assert [(r.start_ms, r.end_ms) for r in folds.allocate_cues(df).orderBy("part").collect()] == want


def test_same_text(spark):
    got = islands.merge_same_text(rows(spark, (0, 100), (900, 1000), (2100, 2200))).orderBy("start_ms").collect()
    assert [(r.start_ms, r.end_ms) for r in got] == [(0, 1000), (2100, 2200)]


def test_best_match_ties_and_touches(spark):
    truth, found = rows(spark, (0, 1000)), rows(spark, (0, 500), (500, 1000))
    assert intervals.best_match(truth, found).first()["hyp_idx"] == 0
    later = rows(spark, (1000, 2000))
    assert intervals.missed(truth, later).count() == 1 and intervals.false_positives(truth, later).count() == 1


def test_range_pairs_like_nested_loops(spark):
    rng = random.Random(3)
    spans = lambda n: [(s, s + rng.choice([0, 1, 50, 5000])) for s in (rng.randrange(0, 20_000) for _ in range(n))]
    a, b = spans(60), spans(60)
    got = intervals.range_pairs(rows(spark, *a), rows(spark, *b), 100, 300, closed=True, bucket_ms=700)
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x[0] <= y[1] + 300 and y[0] - 100 <= x[1])
    assert sorted((r.a_seg_idx, r.b_seg_idx) for r in got.collect()) == want


@pytest.mark.parametrize(("before", "after", "closed"), [(0, 0, False), (500, 700, True)])
def test_range_pairs_of_mixed_lengths(spark, before, after, closed):
    """Points, broken ends far away, ends before the start, and rows without a session; no segment has many rows."""
    draw = random.Random(1)

    def some(n):
        starts = [draw.randrange(-(10**6), 10**8) for _ in range(n)]
        return [(draw.choice([1, 2, None]), i, at, at + draw.choice([0, 1, 500, 60_000, 10**7, 10**10, 10**15, -5, 3 * 10**18])) for i, at in enumerate(starts)]

    a, b = some(80), some(80)
    of = lambda rows: spark.createDataFrame(rows, "session_id bigint, seg_idx bigint, start_ms bigint, end_ms bigint")
    meet = lambda x, y: (x[2] <= y[3] + after and y[2] - before <= x[3]) if closed else (x[2] < y[3] + after and y[2] - before < x[3])
    want = {(x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and meet(x, y)}
    found = [(r["a_seg_idx"], r["b_seg_idx"]) for r in intervals.range_pairs(of(a), of(b), before, after, closed).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert intervals.range_pairs(of(a), of([])).count() == 0


def test_edit_operations():
    assert folds.edit_operations(list("abc"), list("axcd")) == (2, 1, 1, 0)
    assert folds.edit_operations([], []) == (0, 0, 0, 0)


def test_edit_operations_against_the_full_table():
    def full(ref, hyp):
        table = [list(range(len(hyp) + 1))]
        for i, x in enumerate(ref, 1):
            row = [i]
            for j, y in enumerate(hyp, 1):
                row.append(min(table[-1][j] + 1, row[-1] + 1, table[-1][j - 1] + (x != y)))
            table.append(row)
        i, j, counts = len(ref), len(hyp), [0, 0, 0]
        while i or j:
            both = i and j
            if both and ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
            elif both and table[i][j] == table[i - 1][j - 1] + 1:
                i, j, counts[0] = i - 1, j - 1, counts[0] + 1
            elif j and table[i][j] == table[i][j - 1] + 1:
                j, counts[1] = j - 1, counts[1] + 1
            else:
                i, counts[2] = i - 1, counts[2] + 1
        return (table[-1][-1], *counts)

    rng = random.Random(3)
    for _ in range(3000):
        ref, hyp = ([rng.choice("abcd"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(12))] for _ in range(2))
        assert folds.edit_operations(ref, hyp) == full(ref, hyp), (ref, hyp)
    for n, letters in ((700, "ab"), (300, "abcdefgh"), (900, "abcdefghijklmnopqrstuvwxyz ")):
        ref = [rng.choice(letters) for _ in range(n)]
        hyp = [rng.choice(letters) if rng.random() < 0.2 else x for x in ref if rng.random() < 0.9] + [rng.choice(letters) for _ in range(n // 3)]
        assert folds.edit_operations(ref, hyp) == full(ref, hyp)


def test_wer_counts_of_whole_texts(spark, tmp_path):
    same = "word " * 20
    spark.createDataFrame([(1, same + "one two")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, same + "one three four")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = tables.wer_counts(spark, str(tmp_path)).first()
    assert (row.ref_words, row.hyp_words, row.word_errors, row.word_subs, row.word_ins, row.word_dels) == (22, 23, 2, 1, 1, 0)


def test_scalars(spark):
    assert value(spark, C.js_round(F.lit(-2.5))) == -2
    assert value(spark, C.srt_time(F.lit(3723004))) == "01:02:03,004"
    assert value(spark, C.normalize_for_score(F.lit("师父，一百20个 人"))) == "师傅#个人"
    assert value(spark, C.numbered_lines(F.lit("1: a\n2) b\n3. c"), F.lit(3))) == ["a", "b", "c"]
    assert value(spark, C.numbered_lines(F.lit("1: a\n2) b\n3. c"), F.lit(4))) is None
    assert value(spark, C.lenient_json(F.lit('so: {"a": 1} ok'))) == '{"a": 1}'
    assert value(spark, C.is_part_of(F.lit("a"), F.lit("ab"))) and not value(spark, C.is_part_of(F.lit(""), F.lit("ab")))
    assert value(spark, C.guarded_translation(F.lit("源"), F.lit("译文译文"), F.lit("en"))) == "源"


def test_line_ties_go_to_the_last(spark):
    df = spark.createDataFrame([("s", 0, 0, "x", 0.9), ("s", 0, 1, "y", 0.9)], "session_id string, frame_idx int, line_idx int, text string, confidence double")
    assert islands.best_lines(df).first()["text"] == "y"


def test_log_lines(spark):
    df = spark.createDataFrame([("[00:00:01.250 --> 00:00:02.50] hi",), ("noise",)], "value string")
    assert [tuple(r) for r in transcripts.parse_log(df).collect()] == [("hi", 1250, 2500)]


def test_transcripts_of_both_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"result": {"text": "x",\n "segments": [{"text": " hi ", "start": 1, "end": 2.5}]}}')
    (tmp_path / "b.json").write_text('{"transcription": [{"text": " ho", "offsets": {"from": 10, "to": 20}}]}')
    got = transcripts.segments_of(transcripts.read_transcripts(spark, str(tmp_path)))
    assert sorted((r.text, r.start_ms, r.end_ms) for r in got.collect()) == [("hi", 1, 3), ("ho", 10, 20)]


def test_subtitle_file(spark):
    cues = spark.createDataFrame([("s", 0, 0, 0, 1000, "a"), ("s", 0, 1, 1000, 2000, "b")], "session_id string, seg_idx int, part int, start_ms bigint, end_ms bigint, text string")
    assert transcripts.subtitle_files(cues).first()["value"] == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb\n"


def run_stream(spark, stream, name, tmp_path, until):
    """Runs a stream into a table in memory until it has ``until`` rows, or a time is over."""
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"checkpoint-{name}")).start()
    try:
        deadline = time.time() + 120  # a query with timers has batches without data, and so no end of its own
        while time.time() < deadline and spark.table(name).count() < until:
            time.sleep(1)
    finally:
        query.stop()
    return spark.table(name).collect()


def test_idle_task(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"type":"progress","stage":"tts","task_id":"t","progress":40}\n')
    stream = messages.task_outcomes(messages.parse_messages(spark.readStream.text(str(tmp_path / "in"))), idle_ms=1)
    assert [tuple(r) for r in run_stream(spark, stream, "idle", tmp_path, 1)] == [("t", "tts", "idle", 40)]


def arriving(spark, tmp_path, schema, *batches):
    """A stream of the batches, one file after the other."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "made" / str(k)))
    files = sorted((tmp_path / "made").glob("*/part-*.json"), key=lambda f: int(f.parent.name))
    (tmp_path / "in").mkdir()
    for k, f in enumerate(files):
        f.rename(tmp_path / "in" / f"{k}.json")
        os.utime(tmp_path / "in" / f"{k}.json", (1000 + k, 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def test_frames_as_they_come(spark, tmp_path):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    first = [("s", at(0), "hello"), ("s", at(1), "hallo"), ("s", at(3), "world"), ("s", at(4), "world"), ("s", at(4.5), "")]
    frames = arriving(spark, tmp_path, "session_id string, ts timestamp, text string", first, [("other", at(90), "x")], [("other", at(200), "x")])
    got = run_stream(spark, messages.frame_segments(frames), "segments", tmp_path, 2)
    zero = int(datetime(2024, 1, 1).timestamp() * 1000)
    assert sorted((r.text, r.start_ms - zero, r.end_ms - zero) for r in got if r.session_id == "s") == [("hello", 0, 2500), ("world", 3000, 4500)]


@pytest.mark.parametrize("seed, size, restarts", [(1, 7, 0), (2, 20, 0), (3, 12, 2)])
def test_frames_in_any_order(spark, tmp_path, seed, size, restarts):
    """Shuffled arrivals in batches of any size give what the frames in order give, also across restarts."""
    rng = random.Random(0)
    zero, frames, at = datetime(2024, 1, 1), [], 0
    for _ in range(60):
        at += rng.choice([200, 400, 1000, 1800])
        frames.append((rng.choice(["s", "t"]), zero + timedelta(milliseconds=at), rng.choice(["hello", "hallo", "world", "world!", "", None])))
    base = int(zero.timestamp() * 1000)
    want = []
    for session in "st":
        run, blanks = None, []
        for _, ts, text in [*(f for f in frames if f[0] == session), (session, zero + timedelta(days=1), "?")]:
            now = int(ts.timestamp() * 1000)
            if not text:
                blanks.append(now)
            elif run and now - run[2] <= 1500 and folds.within(text, run[0], 2):
                run[2], blanks = now, []
            else:
                if run and (end := min([now, run[2] + 1500, *blanks])) - run[1] >= 500:
                    want.append((session, run[0], run[1] - base, end - base))
                run, blanks = [text, now, now], []
    shuffled = frames[:]
    random.Random(seed).shuffle(shuffled)
    batches = [shuffled[k : k + size] for k in range(0, len(shuffled), size)]
    ends = [[("end", zero + timedelta(hours=k), "?")] for k in (1, 2, 3)]
    stream = messages.frame_segments(arriving(spark, tmp_path, "session_id string, ts timestamp, text string", *batches, *ends), "10 minutes")
    for _ in range(restarts):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        time.sleep(8)
        query.stop()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [(r.session_id, r.text, r.start_ms - base, r.end_ms - base) for r in spark.read.schema("session_id string, text string, start_ms long, end_ms long").parquet(str(tmp_path / "out")).collect() if r.session_id != "end"]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_sessions_of_events(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    events = arriving(spark, tmp_path, "user_id int, ts timestamp", [(1, at(0)), (1, at(20)), (1, at(80))], [(2, at(900))], [(2, at(1900))])
    got = run_stream(spark, messages.event_sessions(events), "sessions", tmp_path, 2)
    assert sorted((r.user_id, r.start, r.end, r.n) for r in got if r.user_id == 1) == [(1, at(0), at(50), 2), (1, at(80), at(110), 1)]


def test_progress_lines(spark):
    lines = spark.createDataFrame([("[PROGRESS] 40",), ("3/12",), ("none",), ("1/0",)], "value string")
    assert [r.progress for r in messages.progress_of(lines).collect()] == [40, 25]


def test_decoders(spark):
    steps = F.array(*[F.array(*map(F.lit, row)) for row in ([0.1, 0.7, 0.2], [0.1, 0.8, 0.1], [0.9, 0.1, 0.0], [0.0, 0.6, 0.4], [0.5, 0.5, 0.0], [0.1, 0.2, 0.7])])
    assert value(spark, decoding.best_path(steps, F.array(F.lit(""), F.lit("a"), F.lit("b")))) == ("aab", pytest.approx((0.7 + 0.6 + 0.7) / 3))
    assert value(spark, decoding.best_path(F.array().cast("array<array<double>>"), F.array(F.lit("")))) == ("", 0.0)
    vocabulary = spark.createDataFrame([(0, base64.b64encode(b" hi").decode()), (1, base64.b64encode("é".encode()[:1]).decode()), (2, base64.b64encode("é".encode()[1:]).decode()), (3, "=")], "token int, piece string")
    ids = {"plain": [0, 1, 2, 3, 50300], "timed": [0, 50364, 1, 2, 50414, 50424, 0, 50264], "none": [50364, 50365]}
    tokens = spark.createDataFrame([(s, i, t) for s, row in ids.items() for i, t in enumerate(row)], "session_id string, pos int, token int")
    got = decoding.timed_tokens(tokens, vocabulary).collect()
    assert sorted((r.session_id, r.text, r.start_ms, r.end_ms) for r in got) == [("plain", "hié", 0, 0), ("timed", "hi", 1200, 1700), ("timed", "hié", 0, 1000)]


def test_tokens_by_character(spark):
    vocabulary = spark.createDataFrame([(0, "▁中文"), (1, "中"), (2, "文"), (3, "文字"), (4, "ab"), (5, "中")], "token int, piece string")
    tokens = spark.createDataFrame([("s", i, t) for i, t in enumerate([4, 0, 3, 0])], "session_id string, pos int, token int")
    assert decoding.by_character(tokens, vocabulary).first()["tokens"] == [4, 1, 2, 3, 1, 2]


@pytest.mark.parametrize("chunk", [600_000, 3000, 500])
def test_merges_of_a_hot_session(spark, monkeypatch, chunk):
    """Row by row by definition, whatever the chunks, with broken ends among the rows."""
    rng = random.Random(5)
    spans, at = [], 0
    for _ in range(400):
        at += rng.choice([0, 300, 1500])
        spans.append((at, at + rng.choice([50, 900, 4000, -20])))
    texts = {i: rng.choice(["a", "a", "a", "b", ""]) for i in range(400)}
    want = []
    for i, (start, end) in enumerate(spans):
        if not texts[i]:
            continue
        if want and want[-1][1] == texts[i] and start - want[-1][3] <= 1000:
            want[-1] = [*want[-1][:3], max(want[-1][3], end), want[-1][4] + 1]
        else:
            want.append([i, texts[i], start, end, 1])
    monkeypatch.setattr(islands, "CHUNK_MS", chunk)
    found = islands.merge_same_text(rows(spark, *spans, texts=texts)).select("seg_idx", "text", "start_ms", "end_ms", "n_merged")
    assert sorted(list(r) for r in found.collect()) == want and 10 < len(want) < 250


@pytest.mark.parametrize("text, want", [("师父，你好", "师傅你好"), ("「好」{a}～~[b]", "好ab"), ("a\u3000b\ufeffc", "abc"), ("一百20个…—-", "#个"), ("“x” ‘y’", "xy")])
def test_scored_text(spark, text, want):
    assert value(spark, C.normalize_for_score(F.lit(text))) == want


def test_fusions_by_hand(spark):
    seg = lambda *r: spark.createDataFrame([("s", i, *x) for i, x in enumerate(r)], SEGMENTS)
    plain = lambda df: [(r.text, r.start_ms, r.end_ms) for r in df.orderBy("start_ms").collect()]
    assert plain(intervals.fusion_split(seg(("a", 0, 3000), ("a", 3500, 4000)), seg(("b", 1000, 2000), ("a", 2100, 2200)))) == [("a", 0, 1000), ("b", 1000, 2000), ("a", 2000, 4000)]
    assert plain(intervals.fusion_union(seg(("a", 0, 1000)), seg(("x", 100, 1400), ("a", 1200, 2000)))) == [("a", 0, 2000)]
    assert plain(intervals.fusion_short(seg(("abc", 0, 1000)), seg(("b", 500, 900), ("x", 1500, 3500), ("y", 4000, 6001)))) == [("abc", 0, 1000), ("x", 1500, 3500)]


def test_time_ids(spark):
    a, b = (spark.range(1).select(C.time_id(F.lit(ms))).first()[0] for ms in (1_700_000_000_000, 1_700_000_000_001))
    assert len(a) == len(b) == 16 and a[:8] < b[:8]


def test_whole_texts_are_compared(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 100 + "bc"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, "a" * 100 + "xé"), (2, "abcd")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.item_id: (r.cer, r.cer_longest) for r in tables.cer_whole(spark, str(tmp_path)).collect()}
    assert got == {1: (pytest.approx(2 / 102), pytest.approx(2 / 102)), 2: (4.0, 1.0)}


def test_message_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"type":"progress","stage":"tts","task_id":"t","progress":40}\nnot json\n{"type":"complete","stage":"tts","task_id":"t"}\n{"type":"progress","stage":"asr","task_id":"t","progress":5}\n')
    stream = messages.task_outcomes(messages.parse_messages(spark.readStream.text(str(tmp_path / "in"))))
    run = stream.writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        deadline = time.time() + 120  # a query with timers has batches without data, and so no end of its own
        while time.time() < deadline and not spark.table("outcomes").count():
            time.sleep(1)
    finally:
        run.stop()
    assert [tuple(r) for r in spark.table("outcomes").collect()] == [("t", "tts", "complete", 40)]
