"""Queries over segments, hypotheses and frames, each with the same in DuckDB SQL where SQL has it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import folds, intervals, islands, metrics
from . import datasets as D

OVERLAP = "g.session_id = h.session_id AND g.start_ms < h.end_ms AND h.start_ms < g.end_ms"
IOU = "(least(g.end_ms, h.end_ms) - greatest(g.start_ms, h.start_ms)) / CAST(greatest(g.end_ms, h.end_ms) - least(g.start_ms, h.start_ms) AS DOUBLE)"
MATCH_SQL = f"""WITH {D.HYP_SQL}, pairs AS (
  SELECT g.session_id, g.seg_idx, h.seg_idx AS hyp_idx, {IOU} AS iou, h.start_ms - g.start_ms AS start_offset, h.end_ms - g.end_ms AS end_offset FROM seg g JOIN hyp h ON {OVERLAP}),
best AS (SELECT * FROM pairs WHERE iou > 0 QUALIFY row_number() OVER (PARTITION BY session_id, seg_idx ORDER BY iou DESC, hyp_idx) = 1),
matches AS (SELECT s.session_id, s.seg_idx, hyp_idx, iou, start_offset, end_offset FROM seg s LEFT JOIN best USING (session_id, seg_idx)) """

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(MATCH_SQL + "SELECT * FROM matches")
def eval_matches(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.best_match(D.seg(spark, sf), D.hyp(spark, sf))


@query(f"""WITH {D.HYP_SQL}, broken AS (SELECT session_id, seg_idx, text, start_ms, CASE WHEN seg_idx >= 1000 THEN 100000000000000 ELSE end_ms END AS end_ms FROM (SELECT session_id, seg_idx, text, CASE WHEN seg_idx >= 1000 THEN 0 ELSE start_ms END AS start_ms, end_ms FROM hyp))
SELECT g.session_id, g.seg_idx, h.seg_idx AS hyp_idx, least(g.end_ms, h.end_ms) - greatest(g.start_ms, h.start_ms) AS overlap_ms FROM seg g JOIN broken h ON {OVERLAP}""")
def broken_ends(spark: SparkSession, sf: str) -> DataFrame:
    """All overlaps where one hypothesis of each session never ends."""
    extra = F.col("seg_idx") >= 1000
    hyp = D.hyp(spark, sf).withColumns({"start_ms": F.when(extra, 0).otherwise(F.col("start_ms")), "end_ms": F.when(extra, 10**14).otherwise(F.col("end_ms"))})
    pairs = intervals.range_pairs(D.seg(spark, sf), hyp)
    return pairs.select(F.col("a_session_id").alias("session_id"), F.col("a_seg_idx").alias("seg_idx"), F.col("b_seg_idx").alias("hyp_idx"), (F.least("a_end_ms", "b_end_ms") - F.greatest("a_start_ms", "b_start_ms")).alias("overlap_ms"))


@query(MATCH_SQL + """SELECT session_id, count(*) AS n_truth, count(hyp_idx) AS n_matched, avg(start_offset) AS mean_start_offset, median(start_offset) AS median_start_offset,
avg(end_offset) AS mean_end_offset, median(end_offset) AS median_end_offset, count(hyp_idx) / CAST(count(*) AS DOUBLE) AS detection FROM matches GROUP BY session_id""")
def eval_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.offset_report(intervals.best_match(D.seg(spark, sf), D.hyp(spark, sf)))


@query(MATCH_SQL + """, labelled AS (SELECT m.*, s.speaker FROM matches m JOIN seg s USING (session_id, seg_idx))
SELECT speaker, count(*) AS n_truth, count(hyp_idx) AS n_matched, avg(start_offset) AS mean_start_offset, median(start_offset) AS median_start_offset,
avg(end_offset) AS mean_end_offset, median(end_offset) AS median_end_offset, count(hyp_idx) / CAST(count(*) AS DOUBLE) AS detection FROM labelled GROUP BY speaker""")
def eval_by_label(spark: SparkSession, sf: str) -> DataFrame:
    truth = D.seg(spark, sf)
    labelled = intervals.best_match(truth, D.hyp(spark, sf)).join(truth.select("session_id", "seg_idx", "speaker"), ["session_id", "seg_idx"])
    return metrics.offset_report(labelled, "speaker")


@query(f"WITH {D.HYP_SQL} SELECT * FROM seg g WHERE NOT EXISTS (SELECT 1 FROM hyp h WHERE {OVERLAP})")
def eval_missed(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.missed(D.seg(spark, sf), D.hyp(spark, sf))


@query(f"WITH {D.HYP_SQL} SELECT * FROM hyp h WHERE NOT EXISTS (SELECT 1 FROM seg g WHERE {OVERLAP})")
def eval_false_positives(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.false_positives(D.seg(spark, sf), D.hyp(spark, sf))


@query(f"""WITH {D.SEG_SQL}, g AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY session_id ORDER BY seg_idx) AS gap FROM seg)
SELECT session_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS covered_ms, coalesce(sum(end_ms - start_ms) / CAST(nullif(max_by(end_ms, seg_idx) - min_by(start_ms, seg_idx), 0) AS DOUBLE), 0) AS coverage,
count(*) FILTER (gap > 0) AS n_gaps, CAST(coalesce(sum(gap) FILTER (gap > 0), 0) AS BIGINT) AS gap_sum_ms, coalesce(avg(gap) FILTER (gap > 0), 0) AS gap_mean_ms, coalesce(max(gap) FILTER (gap > 0), 0) AS gap_max_ms
FROM g GROUP BY session_id""")
def eval_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.gap_report(D.seg(spark, sf))


NEAR_SQL = """SELECT g.session_id, g.seg_idx, h.seg_idx AS near_idx, abs(g.start_ms - h.start_ms) AS dist, h.text AS near_text FROM seg g JOIN hyp h ON g.session_id = h.session_id AND abs(g.start_ms - h.start_ms) <= 4000
QUALIFY row_number() OVER (PARTITION BY g.session_id, g.seg_idx ORDER BY abs(g.start_ms - h.start_ms), h.seg_idx) = 1"""


@query(f"WITH {D.HYP_SQL}, near AS ({NEAR_SQL}) SELECT s.session_id, s.seg_idx, s.text, near_idx, dist, near_text FROM seg s LEFT JOIN near USING (session_id, seg_idx)")
def asof_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.nearest_start(D.seg(spark, sf), D.hyp(spark, sf))


@query(f"""WITH {D.HYP_SQL}, near AS ({NEAR_SQL}), own AS (SELECT g.session_id, g.seg_idx, h.seg_idx AS i2, abs(g.start_ms - h.start_ms) AS d2 FROM seg g JOIN seg h ON g.session_id = h.session_id AND abs(g.start_ms - h.start_ms) <= 4000 AND h.seg_idx % 2 = 0
QUALIFY row_number() OVER (PARTITION BY g.session_id, g.seg_idx ORDER BY abs(g.start_ms - h.start_ms), h.seg_idx) = 1)
SELECT s.session_id, s.seg_idx, s.text, CASE WHEN dist <= coalesce(d2, dist) THEN near_idx ELSE i2 END AS match_idx, CASE WHEN dist <= coalesce(d2, dist) THEN dist ELSE d2 END AS dist
FROM seg s LEFT JOIN near USING (session_id, seg_idx) LEFT JOIN own USING (session_id, seg_idx)""")
def asof_best_of_two(spark: SparkSession, sf: str) -> DataFrame:
    truth = D.seg(spark, sf)
    return intervals.nearest_of_two(truth, D.hyp(spark, sf), truth.where("seg_idx % 2 = 0"))


@query(f"""WITH {D.HYP_SQL}, m AS (SELECT g.session_id, g.seg_idx, h.seg_idx AS match_idx, least(g.end_ms, h.end_ms) - greatest(g.start_ms, h.start_ms) AS overlap_ms,
  CASE WHEN length(g.text) <= length(h.text) THEN g.text ELSE h.text END AS a, CASE WHEN length(g.text) <= length(h.text) THEN h.text ELSE g.text END AS b FROM seg g JOIN hyp h ON {OVERLAP})
SELECT session_id, seg_idx, match_idx, overlap_ms FROM m WHERE overlap_ms > 0 AND (a = '' OR contains(b, a) OR 2 * len(list_filter(string_split(a, ''), lambda c: contains(b, c))) >= length(a))
QUALIFY row_number() OVER (PARTITION BY session_id, seg_idx ORDER BY overlap_ms DESC, match_idx) = 1""")
def overlap_text_match(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.overlap_text_match(D.seg(spark, sf), D.hyp(spark, sf))


def _inner(spark: SparkSession, sf: str) -> DataFrame:
    return D.seg(spark, sf).select("session_id", "seg_idx", F.concat(F.lit("x"), F.substring("text", 1, 5)).alias("text"), (F.col("start_ms") + 100).alias("start_ms"), (F.col("end_ms") - 50).alias("end_ms")).where("seg_idx % 2 = 0")


PLAIN = ["session_id", "seg_idx", "text", "start_ms", "end_ms"]


def merge_sql(rows: str, order: str, max_gap: int = 1000) -> str:
    """CTEs ``run`` and ``isle`` over the CTE ``rows``, and the SELECT of its rows of one text merged in ``order``."""
    return f"""run AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY {order}) AS run FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY session_id ORDER BY {order}) = text THEN 0 ELSE 1 END AS new FROM {rows} WHERE text <> '')),
isle AS (SELECT *, sum(far) OVER (PARTITION BY session_id, run ORDER BY {order}) AS isle FROM (SELECT *, CASE WHEN start_ms - max(end_ms) OVER (PARTITION BY session_id, run ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {max_gap} THEN 1 ELSE 0 END AS far FROM run))
SELECT session_id, first(seg_idx ORDER BY {order}) AS seg_idx, any_value(text) AS text, first(start_ms ORDER BY {order}) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_merged FROM isle GROUP BY session_id, run, isle"""


@query(f"""WITH {D.SEG_SQL}, o AS (SELECT session_id, seg_idx, text, start_ms, end_ms FROM seg), i AS (SELECT session_id, seg_idx, 'x' || substring(text, 1, 5) AS t, start_ms + 100 AS s, end_ms - 50 AS e FROM seg WHERE seg_idx % 2 = 0),
c AS (SELECT o.*, i.t, i.s, i.e FROM o LEFT JOIN i ON o.session_id = i.session_id AND i.s >= o.start_ms AND i.e <= o.end_ms AND i.t <> o.text),
p AS (SELECT session_id, seg_idx, 0 AS piece, start_ms AS from_ms, text, start_ms, coalesce(s, end_ms) AS end_ms FROM c
UNION ALL SELECT session_id, seg_idx, 1, start_ms, t, s, e FROM c WHERE s IS NOT NULL UNION ALL SELECT session_id, seg_idx, 2, start_ms, text, e, end_ms FROM c WHERE s IS NOT NULL),
{merge_sql("p", "from_ms, seg_idx, piece")}""")
def fusion_split(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.fusion_split(D.seg(spark, sf).select(PLAIN), _inner(spark, sf))


@query(f"""WITH {D.HYP_SQL}, o AS (SELECT session_id, seg_idx, text, start_ms, end_ms FROM seg WHERE seg_idx % 3 <> 1),
u AS (SELECT *, 0 AS source FROM o UNION ALL SELECT a.*, 1 FROM hyp a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = a.session_id AND o.start_ms <= a.start_ms AND o.end_ms >= a.end_ms - 500)), {merge_sql("u", "start_ms, source, seg_idx")}""")
def fusion_union(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.fusion_union(D.seg(spark, sf).select(PLAIN).where("seg_idx % 3 <> 1"), D.hyp(spark, sf))


@query(f"""WITH {D.HYP_SQL}, o AS (SELECT session_id, seg_idx, text, start_ms, end_ms FROM seg WHERE seg_idx % 3 <> 1),
u AS (SELECT *, 0 AS source FROM o UNION ALL SELECT a.*, 1 FROM hyp a WHERE a.end_ms - a.start_ms <= 2000 AND NOT EXISTS (SELECT 1 FROM o WHERE o.session_id = a.session_id AND o.start_ms <= a.end_ms AND o.end_ms >= a.start_ms AND (contains(o.text, a.text) OR contains(a.text, o.text)))), {merge_sql("u", "start_ms, source, seg_idx")}""")
def fusion_short(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.fusion_short(D.seg(spark, sf).select(PLAIN).where("seg_idx % 3 <> 1"), D.hyp(spark, sf))


@query(f"""WITH {D.HYP_SQL}, r AS (SELECT * FROM seg g WHERE EXISTS (SELECT 1 FROM hyp h WHERE h.session_id = g.session_id AND h.start_ms <= g.end_ms + 1000 AND h.end_ms >= g.start_ms - 1000
  AND (len(list_intersect(string_split(g.text, ''), string_split(h.text, ''))) > 0 AND g.text <> '' AND h.text <> '' OR length(g.text) < 3))),
w AS (SELECT session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM seg GROUP BY session_id), p AS (SELECT session_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY session_id)
SELECT w.session_id, w.n, w.chars, coalesce(p.n, 0) AS n_recalled, coalesce(p.chars, 0) AS chars_recalled FROM w LEFT JOIN p USING (session_id)""")
def recall_cover(spark: SparkSession, sf: str) -> DataFrame:
    truth = D.seg(spark, sf)
    return metrics.recall_report(truth, intervals.recalled(truth, D.hyp(spark, sf)))


NOISE_SQL = """n AS (SELECT session_id, seg_idx, CASE WHEN seg_idx % 2 = 0 THEN text ELSE list_extract(string_split(text, ' '), -1) END AS text, start_ms + CASE WHEN seg_idx % 2 = 0 THEN -3000 ELSE 0 END AS start_ms, end_ms + CASE WHEN seg_idx % 2 = 0 THEN 3000 ELSE 0 END AS end_ms, CASE WHEN seg_idx % 2 = 0 THEN 30 ELSE 9 END AS frames FROM seg)"""


def _noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Even turns long and whole, odd ones short with their last word."""
    even = F.col("seg_idx") % 2 == 0
    pick = lambda a, b: F.when(even, a).otherwise(b)
    text = pick(F.col("text"), F.element_at(F.split("text", " ", -1), -1))
    return D.seg(spark, sf).select("session_id", "seg_idx", text.alias("text"), (F.col("start_ms") + pick(-3000, 0)).alias("start_ms"), (F.col("end_ms") + pick(3000, 0)).alias("end_ms"), pick(30, 9).alias("frames"))


@query(f"""WITH {D.SEG_SQL}, {NOISE_SQL} SELECT * FROM n s WHERE NOT EXISTS (SELECT 1 FROM n o WHERE o.session_id = s.session_id AND o.seg_idx <> s.seg_idx AND o.start_ms <= s.start_ms AND o.end_ms >= s.end_ms AND contains(o.text, s.text) AND o.frames > 2 * s.frames)""")
def substring_noise(spark: SparkSession, sf: str) -> DataFrame:
    return intervals.without_noise(_noisy(spark, sf))


@query(f"WITH {D.SEG_SQL}, {NOISE_SQL} SELECT * FROM n WHERE NOT (length(text) <= 1 AND frames < 10 OR contains(text, '于嘛') OR text IN ('公', '猪'))")
def noise_filter(spark: SparkSession, sf: str) -> DataFrame:
    noise = ((F.length("text") <= 1) & (F.col("frames") < 10)) | F.col("text").contains("于嘛") | F.col("text").isin("公", "猪")
    return _noisy(spark, sf).where(~noise)


PAD = "CASE WHEN {g} >= 450 THEN {m}.0 WHEN {g} > 50 THEN ({g} - 50) * CAST({m} AS DOUBLE) / 400 ELSE {g} / CAST(2 AS DOUBLE) END"


@query(f"""WITH {D.SEG_SQL}, g AS (SELECT *, start_ms - lag(end_ms) OVER w AS b, lead(start_ms) OVER w - end_ms AS a FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY seg_idx))
SELECT session_id, seg_idx, speaker, text, start_ms, end_ms, greatest(start_ms - CASE WHEN b IS NULL THEN 100 ELSE {PAD.format(g="b", m=100)} END, CAST(0 AS DOUBLE)) AS padded_start,
end_ms + CASE WHEN a IS NULL THEN 300 ELSE {PAD.format(g="a", m=300)} END AS padded_end FROM g""".replace("100.0", "CAST(100 AS DOUBLE)").replace("300.0", "CAST(300 AS DOUBLE)"))
def pad_segments(spark: SparkSession, sf: str) -> DataFrame:
    return islands.pad(D.seg(spark, sf))


def _worded(spark: SparkSession, sf: str) -> DataFrame:
    return D.seg(spark, sf).withColumn("text", F.when(F.col("seg_idx") % 5 == 1, "").when(F.col("seg_idx") % 4 < 3, "same").otherwise(F.col("speaker")))


@query(f"""WITH {D.SEG_SQL}, t AS (SELECT session_id, seg_idx, CASE WHEN seg_idx % 5 = 1 THEN '' WHEN seg_idx % 4 < 3 THEN 'same' ELSE speaker END AS text, start_ms, end_ms FROM seg),
{merge_sql("t", "start_ms, seg_idx", 400)}""")
def same_text_merge(spark: SparkSession, sf: str) -> DataFrame:
    return islands.merge_same_text(_worded(spark, sf), 400)


RUNS_SQL = """marked AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts_ms, frame_idx) AS run FROM (SELECT *, CASE WHEN lag(text) OVER (PARTITION BY session_id ORDER BY ts_ms, frame_idx) = text THEN 0 ELSE 1 END AS new FROM frame {where})),
runs AS (SELECT session_id, CAST(run AS BIGINT) AS run, any_value(text) AS text, min(ts_ms) AS start_ms, max(ts_ms) AS last_ts, count(*) AS frames FROM marked GROUP BY session_id, run)"""


@query(f"""WITH {D.FRAME_SQL}, {RUNS_SQL.format(where="WHERE text <> ''")}, l AS (SELECT session_id, max(ts_ms) AS last_ms FROM frame GROUP BY session_id),
e AS (SELECT session_id, run, text, start_ms, coalesce(lead(start_ms) OVER (PARTITION BY session_id ORDER BY run), last_ms) AS end_ms, frames FROM runs JOIN l USING (session_id))
SELECT * FROM e WHERE end_ms - start_ms >= 500""")
def frame_rle(spark: SparkSession, sf: str) -> DataFrame:
    return islands.frame_runs(D.frame(spark, sf))


@query(f"WITH {D.FRAME_SQL}, {RUNS_SQL.format(where='')} SELECT session_id, run, text, start_ms, last_ts AS end_ms, frames FROM runs WHERE frames >= 2")
def stable_runs(spark: SparkSession, sf: str) -> DataFrame:
    return islands.stable_runs(D.frame(spark, sf), 50.0)


@query(f"""WITH {D.FRAME_SQL}, {RUNS_SQL.format(where='')}, f AS (SELECT *, lag(text) OVER (PARTITION BY session_id ORDER BY start_ms, run) AS from_text FROM runs)
SELECT session_id, start_ms AS ms, from_text, text AS to_text FROM f WHERE from_text IS NOT NULL AND from_text <> text""")
def transitions(spark: SparkSession, sf: str) -> DataFrame:
    return islands.transitions(islands.stable_runs(D.frame(spark, sf), 1.0))


@query(f"WITH {D.LINE_SQL} SELECT * FROM line QUALIFY row_number() OVER (PARTITION BY session_id, frame_idx ORDER BY confidence DESC, line_idx DESC) = 1")
def best_line(spark: SparkSession, sf: str) -> DataFrame:
    return islands.best_lines(D.line(spark, sf))


@query()
def frame_merge(spark: SparkSession, sf: str) -> DataFrame:
    return folds.merge_frames(D.frame(spark, sf).withColumns({"box_low": F.lit(620.0), "box_high": F.lit(700.0)}))


@query()
def clean_timings(spark: SparkSession, sf: str) -> DataFrame:
    return folds.clean_timings(islands.frame_runs(D.frame(spark, sf), 30).select("session_id", F.col("run").alias("seg_idx"), "text", "start_ms", "end_ms", "frames", F.lit(0.5).alias("confidence_avg")))


@query()
def reopened_runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = islands.stable_runs(D.frame(spark, sf), 1.0)
    return folds.reopen_runs(runs.select("session_id", "run", "text", "start_ms", F.col("run").alias("first"), F.col("run").alias("last"), (F.col("end_ms") + 1000).alias("total_ms")), 10.0)


@query(f"""WITH RECURSIVE {D.SEG_SQL}, t AS (SELECT *, end_ms - start_ms + (seg_idx * 211) % 700 - 300 AS dur, row_number() OVER (PARTITION BY session_id ORDER BY seg_idx) AS k FROM seg),
f AS (SELECT session_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seg_idx, CAST(NULL AS BIGINT) AS actual_start, CAST(0 AS BIGINT) AS actual_end, CAST(0 AS DOUBLE) AS stretched_ms, CAST(0 AS DOUBLE) AS drift FROM seg GROUP BY session_id
  UNION ALL SELECT session_id, k, seg_idx, b, CAST(floor(b + ms) AS BIGINT), ms, CASE WHEN fits THEN slot - dur WHEN dur / slot < 1.05 THEN 0 ELSE slot - ms END FROM (
    SELECT *, dur <= slot AS fits, CASE WHEN dur <= slot THEN CAST(dur AS DOUBLE) ELSE dur / least(CAST(1.05 AS DOUBLE), dur / slot) END AS ms FROM (
      SELECT *, greatest(CAST(50 AS DOUBLE), e - b + drift) AS slot FROM (
        SELECT t.session_id, t.k, t.seg_idx, greatest(t.start_ms, f.actual_end) AS b, t.end_ms AS e, CAST(t.dur AS DOUBLE) AS dur, f.drift FROM f JOIN t ON t.session_id = f.session_id AND t.k = f.k + 1))))
SELECT session_id, seg_idx, actual_start, actual_end, stretched_ms FROM f WHERE k > 0""")
def drift_schedule(spark: SparkSession, sf: str) -> DataFrame:
    dur = F.col("end_ms") - F.col("start_ms") + (F.col("seg_idx") * 211) % 700 - 300
    return folds.schedule(D.seg(spark, sf).withColumn("dur_ms", dur))


@query(f"""WITH {D.SEG_SQL}, f AS (SELECT session_id, seg_idx, start_ms, end_ms, string_split(text, '.') AS p FROM seg WHERE text <> ''),
w AS (SELECT *, list_transform(p, lambda x: greatest(length(regexp_replace(x, '\\s', '', 'g')), 1)) AS w FROM f), u AS (SELECT *, len(p) AS n, list_sum(w) AS total FROM w),
cues AS (WITH RECURSIVE c AS (SELECT *, 0 AS part, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS share FROM u UNION ALL
  SELECT session_id, seg_idx, start_ms, end_ms, p, w, n, total, part + 1, used + share, CAST(CASE WHEN part < n - 1 THEN greatest(200, least(floor((end_ms - start_ms) * w[part + 1] / CAST(total AS DOUBLE) + 0.5), end_ms - start_ms - used - share - 100)) ELSE greatest(100, end_ms - start_ms - used - share) END AS BIGINT)
  FROM c WHERE part < n) SELECT * FROM c WHERE part > 0)
SELECT session_id, seg_idx, part - 1 AS part, start_ms + used AS start_ms, start_ms + used + share AS end_ms, p[part] AS text FROM cues""")
def cue_allocation(spark: SparkSession, sf: str) -> DataFrame:
    return folds.allocate_cues(D.seg(spark, sf).where("text <> ''").withColumn("fragments", F.split("text", r"\.")))


@query()
def split_subtitle(spark: SparkSession, sf: str) -> DataFrame:
    return folds.allocate_cues(folds.with_fragments(D.seg(spark, sf)))


@query(f"WITH {D.SEG_SQL} SELECT session_id, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM seg GROUP BY session_id")
def transcript_concat(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.transcript(D.seg(spark, sf))


@query(f"""WITH {D.SEG_SQL}, g AS (SELECT *, start_ms - lag(end_ms) OVER w AS gap, lead(start_ms) OVER w AS next FROM seg WINDOW w AS (PARTITION BY session_id ORDER BY seg_idx)),
a AS (SELECT session_id, count(*) AS n_segments, count(*) FILTER (gap = 0) AS zero_gaps, count(*) FILTER (end_ms = next) AS touching, count(*) FILTER (end_ms - start_ms > 5000) AS over_5s FROM g GROUP BY session_id)
SELECT *, CASE WHEN n_segments > 1 AND zero_gaps = n_segments - 1 THEN 'vad_not_fired' WHEN zero_gaps > 0 THEN 'partial_zero_gaps' END AS issue FROM a""")
def check_asr(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.check_report(D.seg(spark, sf))


@query(f"""WITH {D.SEG_SQL}, w AS (SELECT *, max(end_ms) OVER (PARTITION BY session_id) - 400 AS total_ms FROM seg)
SELECT session_id, seg_idx, speaker, text, start_ms, end_ms, total_ms, greatest(start_ms - 80, 0) AS clip_start, least(total_ms, end_ms + 160) AS clip_end FROM w WHERE least(total_ms, end_ms + 160) > greatest(start_ms - 80, 0)""")
def clip_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.seg(spark, sf)
    total = rows.groupBy("session_id").agg((F.max("end_ms") - 400).alias("total_ms"))
    return islands.clip_windows(rows.join(total, "session_id").select(*rows.columns, "total_ms"))


@query(f"WITH {D.HYP_SQL}, d AS (SELECT session_id, max(end_ms) AS duration FROM seg GROUP BY session_id) SELECT h.* FROM hyp h JOIN d USING (session_id) WHERE h.start_ms < duration AND h.end_ms > 0 AND trim(h.text) <> '' AND h.end_ms - h.start_ms >= 500")
def range_filter(spark: SparkSession, sf: str) -> DataFrame:
    duration = D.seg(spark, sf).groupBy("session_id").agg(F.max("end_ms").alias("duration"))
    good = (F.col("start_ms") < F.col("duration")) & (F.col("end_ms") > 0) & (F.trim("text") != "") & (F.col("end_ms") - F.col("start_ms") >= 500)
    return D.hyp(spark, sf).join(duration, "session_id").where(good).drop("duration")


@query(f"WITH {D.SEG_SQL} SELECT session_id, CAST(floor(seg_idx / CAST(3 AS DOUBLE)) AS BIGINT) AS batch, count(*) AS n, string_agg(seg_idx || ': ' || text, chr(10) ORDER BY seg_idx) AS prompt FROM seg GROUP BY ALL")
def prompt_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    prompt = F.array_join(F.transform(rows, lambda x: F.concat_ws(": ", x["seg_idx"].cast("string"), x["text"])), "\n")
    return D.seg(spark, sf).groupBy("session_id", F.floor(F.col("seg_idx") / 3).alias("batch")).agg(F.count("*").alias("n"), prompt.alias("prompt"))


@query(f"WITH {D.SEG_SQL}, s AS (SELECT session_id, seg_idx, unnest(generate_series(CAST(ceil(start_ms / CAST(1000 AS DOUBLE)) AS BIGINT), CAST(floor(end_ms / CAST(1000 AS DOUBLE)) AS BIGINT))) AS second FROM seg) SELECT session_id, seg_idx, second, second * 5 + 1 AS frame_no FROM s")
def guided_frames(spark: SparkSession, sf: str) -> DataFrame:
    first, last = F.ceil(F.col("start_ms") / 1000), F.floor(F.col("end_ms") / 1000)
    seconds = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return D.seg(spark, sf).select("session_id", "seg_idx", F.explode(seconds).alias("second")).withColumn("frame_no", C.js_round(F.col("second") * 5.0) + 1)


@query(f"""WITH {D.SEG_SQL}, t AS (SELECT session_id, seg_idx, text AS src, '[' || text || ']' AS dst, start_ms, end_ms FROM seg) SELECT t.session_id, t.seg_idx, src, dst, start_ms, end_ms, seg.speaker FROM t JOIN seg USING (session_id, seg_idx, start_ms, end_ms)""")
def zip_timings(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.seg(spark, sf)
    translated = rows.select("session_id", "seg_idx", F.concat(F.lit("["), "text", F.lit("]")).alias("dst"))
    return intervals.zip_segments(rows, translated).select("session_id", "seg_idx", F.col("text").alias("src"), F.col("b_dst").alias("dst"), "start_ms", "end_ms", "speaker")


@query(f"""WITH {D.FRAME_SQL} SELECT session_id, count(*) FILTER (confidence >= 0) AS n, avg(confidence) AS conf_avg, min(confidence) AS conf_min, stddev_pop(confidence) AS conf_std, count(*) FILTER (confidence > CAST(0.3 AS DOUBLE)) AS n_sure FROM frame GROUP BY session_id""")
def confidence_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("confidence")
    return D.frame(spark, sf).groupBy("session_id").agg(F.count_if(c >= 0).alias("n"), F.avg(c).alias("conf_avg"), F.min(c).alias("conf_min"), F.stddev_pop(c).alias("conf_std"), F.count_if(c > 0.3).alias("n_sure"))
