"""Reports: aggregates over matches, gaps, confidences and benchmark rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import js_round
from .islands import with_gaps


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where there is no whole."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def offset_report(matches: DataFrame, by: str = "session_id") -> DataFrame:
    """Mean and exact median of start and end offsets, and the share of segments that were found."""
    found = F.count("hyp_idx")
    figures = [f(c).alias(f"{n}_{c}") for c in ("start_offset", "end_offset") for n, f in (("mean", F.avg), ("median", F.median))]
    return matches.groupBy(by).agg(F.count("*").alias("n_truth"), found.alias("n_matched"), *figures, share(found, F.count("*")).alias("detection"))


def gap_report(segments: DataFrame) -> DataFrame:
    """Covered time, its share of the session's hull, and the gaps above 0: number, sum, mean and maximum."""
    gap = F.when(F.col("gap_ms") > 0, F.col("gap_ms"))
    hull = F.max_by("end_ms", "seg_idx") - F.min_by("start_ms", "seg_idx")
    covered = F.sum(F.col("end_ms") - F.col("start_ms"))
    return with_gaps(segments).groupBy("session_id").agg(
        covered.alias("covered_ms"), share(covered, hull).alias("coverage"), F.count(gap).alias("n_gaps"), F.coalesce(F.sum(gap), F.lit(0)).alias("gap_sum_ms"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("gap_mean_ms"), F.coalesce(F.max(gap), F.lit(0)).alias("gap_max_ms"),
    )


def check_report(segments: DataFrame) -> DataFrame:
    """Per session: segments, gaps of zero, ends at the next start, and what that says about speech detection."""
    from pyspark.sql import Window as W

    following = F.lead("start_ms").over(W.partitionBy("session_id").orderBy("seg_idx"))
    marked = with_gaps(segments).withColumn("touches", F.col("end_ms") == following)
    zero, n = F.count_if(F.col("gap_ms") == 0), F.count("*")
    issue = F.when((n > 1) & (zero == n - 1), "vad_not_fired").when(zero > 0, "partial_zero_gaps")
    return marked.groupBy("session_id").agg(n.alias("n_segments"), zero.alias("zero_gaps"), F.count_if("touches").alias("touching"), F.count_if(F.col("end_ms") - F.col("start_ms") > 5000).alias("over_5s"), issue.alias("issue"))


def recall_report(truth: DataFrame, recalled: DataFrame) -> DataFrame:
    """Segments and characters recalled of all."""
    figures = lambda df: df.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    whole, part = figures(truth), figures(recalled).select("session_id", F.col("n").alias("n_recalled"), F.col("chars").alias("chars_recalled"))
    return whole.join(part, "session_id", "left").fillna(0, ["n_recalled", "chars_recalled"])


def alignment_counts(matches: DataFrame) -> DataFrame:
    """From rows with truth, orig and fixed texts (null: unmatched): exact ones, what the fix mended or broke, and distances."""
    right = lambda c: F.coalesce(F.col(c) == F.col("truth"), F.lit(False))
    both = F.col("orig").isNotNull()
    return matches.groupBy("session_id").agg(
        F.count_if(right("orig")).alias("exact_orig"), F.count_if(right("fixed")).alias("exact_fixed"), F.count_if(both & ~right("orig") & right("fixed")).alias("fixed_correct"),
        F.count_if(both & right("orig") & ~right("fixed")).alias("fixed_wrong"), F.count_if(both & ~right("orig") & ~right("fixed")).alias("same_wrong"), F.count_if(~both).alias("unmatched"), F.avg("dist").alias("avg_dist"),
    )


def confidence(words: Column) -> Column:
    """avg and min probability of an array of words with one, to four digits; null for none."""
    p = F.transform(F.filter(words, lambda w: w["probability"] >= 0), lambda w: w["probability"])
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    return F.when(F.size(p) > 0, F.struct(F.round(mean, 4).alias("avg"), F.round(F.array_min(p), 4).alias("min")))


def transcript(segments: DataFrame, separator: str = " ") -> DataFrame:
    """A session's texts in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    return segments.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), separator).alias("text"))


def real_time_factors(results: DataFrame, by: list[str]) -> DataFrame:
    """Processing time over media time for each group, best first, and the speed-up against the first group's time."""
    rtf = share(F.sum("total_time_s"), F.sum("output_duration_s"))
    grouped = results.groupBy(*by).agg(F.count("*").alias("n"), F.sum("total_time_s").alias("total_s"), rtf.alias("rtf"))
    first = grouped.agg(F.min_by("total_s", F.struct(*by)).alias("first_s"))  # one row
    return grouped.join(F.broadcast(first)).withColumn("speed_up", F.col("first_s") / F.nullif(F.col("total_s"), F.lit(0.0))).drop("first_s").orderBy("rtf", *by)


def outcomes(trials: DataFrame) -> DataFrame:
    """Trials by status: number, share in percent, and mean time."""
    counted = trials.groupBy("status").agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s"))
    total = counted.agg(F.sum("n").alias("all"))  # one row
    return counted.join(F.broadcast(total)).withColumn("percent", 100.0 * F.col("n") / F.col("all")).drop("all")


def stage_times(frames: DataFrame, stages: list[str]) -> DataFrame:
    """For columns of milliseconds by frame: each stage's sum, rounded, and the whole's mean by frame."""
    sums = [js_round(F.sum(c)).cast("long").alias(f"{c}_ms") for c in stages]
    whole = sum((F.col(c) for c in stages[1:]), F.col(stages[0]))
    return frames.groupBy("session_id").agg(F.count("*").alias("n_frames"), *sums, js_round(F.avg(whole)).cast("long").alias("mean_ms"))


def scheduled_seconds(timings: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """The sum of all segments' lengths in seconds."""
    return timings.groupBy("session_id").agg((F.sum(F.col(end) - F.col(start)) / 1000).alias("scheduled_s"))


def progress_counts(items: DataFrame) -> DataFrame:
    """How many items were made, skipped (there already, no text, or no reference) and failed, and the share that is done in percent."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    skipped = F.col("exists") | blank | F.col("reference").isNull()
    failed = ~skipped & F.col("failed")
    done = F.count_if(skipped | F.col("finished"))
    return items.groupBy("session_id").agg(
        F.count_if(~skipped & F.col("finished") & ~F.col("failed")).alias("generated"), F.count_if(skipped).alias("skipped"), F.count_if(failed & F.col("finished")).alias("errors"),
        F.floor(100 * done / F.count("*")).alias("percent"),
    )


def group_confidence(frames: DataFrame, by: list[str]) -> DataFrame:
    """The mean confidence of a group's frames, to three digits."""
    return frames.groupBy(*by).agg(F.round(F.avg("confidence"), 3).alias("confidence"))


def normalised(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``value`` less its group's mean, over the group's population deviation (1 where that is 0); and the group's peak."""
    stats = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.max(F.abs(value)).alias("peak"))
    scaled = (F.col(value) - F.col("mean")) / F.when(F.col("deviation") > 0, F.col("deviation")).otherwise(1.0)
    return rows.join(stats, by).withColumn("scaled", scaled)


def error_report(scores: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Scores with the metrics known for their key, ``N/A`` for others, the lowest rate first."""
    return scores.join(metrics, key, "left").withColumn("shown", F.when(F.col("cer").isNull(), "N/A").otherwise(F.format_string("%.2f%%", F.col("cer") * 100))).orderBy(F.col("cer").asc_nulls_last(), key)


def fixed_width(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Lines of a report: text columns padded at the right and numbers at the left, as wide as given; longer values stay whole."""
    kinds = dict(rows.dtypes)

    def cell(name: str, width: int) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit("-"))
        pad = F.rpad if kinds[name] == "string" else F.lpad
        return F.when(F.length(value) >= width, value).otherwise(pad(value, width, " "))

    return rows.select(F.concat_ws(" ", *[cell(n, w) for n, w in widths.items()]).alias("value"))
