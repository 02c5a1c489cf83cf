"""Task and stage state as a log of changes folded to the latest: no row is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ms_between


def latest(log: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Each key's last change; with partial aggregation, so a key with many changes is no hot spot."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("row")).select(*keys, "row.*")


#: Rows that a list of stages may have: such lists become part of plans.
MOST_STAGES = 1000


def _listed(specs: DataFrame) -> list:
    rows = specs.limit(MOST_STAGES + 1).collect()
    if len(rows) > MOST_STAGES:
        raise ValueError(f"a list of stages has {MOST_STAGES} rows at most")
    return rows


def stage_status(stored: DataFrame, specs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Every stage of every task in order, stored or pending. ``specs`` is the short list of stages.

    Stored rows are gathered by task, at most one for each stage, and the list is laid over them.
    """
    named = tasks.select("task_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("progress"))
    both = stored.select("task_id", "name", "status", F.col("progress").cast("int").alias("progress")).union(named.distinct())
    pair = F.struct("name", F.struct("status", "progress"))
    known = both.groupBy("task_id").agg(F.map_from_entries(F.filter(F.collect_set(pair), lambda x: x["name"].isNotNull())).alias("known"))
    listed = F.array(*[F.struct(F.lit(r["ord"]).alias("ord"), F.lit(r["name"]).alias("name"), F.lit(r["label"]).alias("label")) for r in sorted(_listed(specs), key=lambda r: r["ord"])])
    rows = known.select("task_id", "known", F.explode(listed).alias("s")).select("task_id", "s.*", F.col("known")[F.col("s.name")].alias("have"))
    return rows.select("task_id", "ord", "name", "label", F.coalesce("have.status", F.lit("pending")).alias("status"), F.coalesce("have.progress", F.lit(0)).alias("progress"))


def status_summary(status: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "succeeded")
    return status.groupBy("task_id").agg(done.alias("done"), F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))


def missing_stages(stored: DataFrame, specs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Stages of ``specs``, a short list, that a task has no row for."""
    kinds = specs.schema
    given = tasks.select("task_id", F.lit(None).cast("string").alias("name")).distinct()
    have = stored.select("task_id", "name").union(given).groupBy("task_id").agg(F.collect_set("name").alias("have"))  # nulls aren't collected
    listed = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c].dataType).alias(c) for c in specs.columns]) for r in _listed(specs)])
    return have.select("task_id", F.explode(F.filter(listed, lambda s: ~F.array_contains("have", s["name"]))).alias("s")).select("task_id", "s.*")


def resume_points(status: DataFrame) -> DataFrame:
    """Where each task goes on: its first stage that didn't succeed; null if all did."""
    return status.groupBy("task_id").agg(F.min(F.when(F.col("status") != "succeeded", F.col("ord"))).alias("resume_ord"))


def reset_from(status: DataFrame, points: DataFrame) -> DataFrame:
    """Stages from a task's resume point on are pending again."""
    later = F.col("ord") >= F.col("resume_ord")
    return status.join(points, "task_id").withColumn("status", F.when(later, "pending").otherwise(F.col("status"))).drop("resume_ord")


def delete_tasks(tasks: DataFrame, stages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the tasks whose ids are given."""
    return tasks.join(ids.select("id"), "id", "left_anti"), stages.join(ids.select(F.col("id").alias("task_id")), "task_id", "left_anti")


def newest(tasks: DataFrame, needle: str) -> DataFrame:
    """The newest task whose id is ``needle`` or whose URL contains it, taken literally."""
    return tasks.where((F.col("id") == needle) | F.col("url").contains(needle)).orderBy(F.desc("created_at"), F.desc("seq")).limit(1)


def with_durations(stages: DataFrame) -> DataFrame:
    return stages.withColumns({"progress": F.coalesce("progress", F.lit(0)), "duration_ms": ms_between(F.col("started_at"), F.col("completed_at"))})


def stale_outputs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sessions (session_id, mtime) with an input newer than any of their outputs."""
    newest_in = inputs.groupBy("session_id").agg(F.max("mtime").alias("newest_input"))
    oldest_out = outputs.groupBy("session_id").agg(F.min("mtime").alias("oldest_output"))
    return newest_in.join(oldest_out, "session_id").where(F.col("newest_input") > F.col("oldest_output"))


def merge_records(records: DataFrame, keys: list[str]) -> DataFrame:
    """One record for each key: every field from the first source (``prio``) that has it."""
    fields = [c for c in records.columns if c not in (*keys, "prio")]
    return records.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("prio"))).alias(c) for c in fields])


def with_fallback(rows: DataFrame, files: DataFrame, least_bytes: int = 38_400) -> DataFrame:
    """Each row's own reference file if it is large enough, else the session's first that is, else null."""
    good = files.where(F.col("bytes") >= least_bytes)
    own = good.select("session_id", "seg_idx", F.col("path").alias("own"))
    first = good.groupBy("session_id").agg(F.min_by("path", "seg_idx").alias("first"))
    return rows.join(own, ["session_id", "seg_idx"], "left").join(first, "session_id", "left").withColumn("reference", F.coalesce("own", "first")).drop("own", "first")


def grid(a: DataFrame, b: DataFrame, done: DataFrame, most: int = 10_000) -> DataFrame:
    """All combinations of two small parameter tables that aren't done; tables of over ``most`` rows are refused."""
    if b.limit(most + 1).count() > most:
        raise ValueError(f"the second table has over {most} rows")
    return a.join(F.broadcast(b)).join(done, [c for c in done.columns], "left_anti")


def created(tasks: DataFrame, specs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes that create tasks (task_id, url) and their stages: queued at the first stage, all stages pending."""
    first = specs.agg(F.min_by("name", "ord")).first()[0]
    rows = tasks.withColumns({"status": F.lit("queued"), "current_stage": F.lit(first)})
    return rows, missing_stages(rows.select("task_id", F.lit(None).cast("string").alias("name")).where("false"), specs, rows).withColumn("status", F.lit("pending"))


def known_tasks(wanted: DataFrame, tasks: DataFrame) -> DataFrame:
    """Wanted URLs (video_id) with the newest task that has their video, or null: what needn't be created."""
    newest_of = tasks.where(F.col("video_id").isNotNull()).groupBy("video_id").agg(F.max_by("task_id", F.struct("created_at", "seq")).alias("known_task"))
    return wanted.join(newest_of, "video_id", "left")


def with_mode(status: DataFrame, switched: DataFrame, stage: str = "merge_video") -> DataFrame:
    """For tasks in ``switched`` the stage whose result depends on the mode is pending again, without progress."""
    marked = status.join(switched.select("task_id", F.lit(True).alias("__switched")).distinct(), "task_id", "left")
    reset = F.col("__switched").isNotNull() & (F.col("name") == stage)
    return marked.withColumns({"status": F.when(reset, "pending").otherwise(F.col("status")), "progress": F.when(reset, 0).otherwise(F.col("progress"))}).drop("__switched")


def changes(patches: DataFrame, keys: list[str]) -> DataFrame:
    """Patches that change something: those with a value besides their keys; others do nothing."""
    rest = [c for c in patches.columns if c not in keys]
    return patches.where(F.coalesce(*[F.col(c).cast("string") for c in rest]).isNotNull()) if rest else patches.where("false")


def stages_of(specs: DataFrame, pipeline: str, source: str = "asr", translate: bool = True, align: bool = False) -> DataFrame:
    """The stages that a configuration leaves: a mode's own, those of the other source of text taken out, in order."""
    drop = set()
    if source == "ocr":
        drop |= {"asr", "asr_fix", "separate"}
    else:
        drop |= {"ocr", "ocr_fix"}
    drop |= set() if translate else {"translate"}
    if pipeline == "subtitle":
        drop |= {"tts", "merge_audio"} | (set() if align else {"split_audio"})
    return specs.where(~F.col("name").isin(*sorted(drop)))


def stages_by_mode(tasks: DataFrame, modes: dict[str, DataFrame]) -> DataFrame:
    """A row for each task (with ``mode``) and each of its mode's stages, which are short lists."""
    listed = None
    for mode, specs in modes.items():
        rows = specs.withColumn("mode", F.lit(mode))
        listed = rows if listed is None else listed.unionByName(rows)
    return tasks.join(F.broadcast(listed), "mode")


def cache_state(devices: DataFrame, cached: DataFrame) -> DataFrame:
    """For each host whether all its devices' drivers are those of its cache; hosts without a cache have a stale one."""
    joined = devices.join(cached.select("host", "vendor", "name", F.col("driver").alias("cached")), ["host", "vendor", "name"], "left")
    return joined.groupBy("host").agg(F.every(F.coalesce(F.col("driver") == F.col("cached"), F.lit(False))).alias("valid"))


def settled(config: DataFrame, environment: dict[str, str], defaults: dict[str, str]) -> DataFrame:
    """Each setting from the configuration, else from the environment, else the default."""
    names = [*config.columns, *[k for k in {**environment, **defaults} if k not in config.columns]]
    of = lambda c: [F.col(c)] if c in config.columns else []
    rest = lambda c: [F.lit(x[c]) for x in (environment, defaults) if c in x]
    return config.select(*[F.coalesce(*of(c), *rest(c)).alias(c) for c in names])


def snapshot(config: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """A run's settings: chosen fields of each group in a struct, and the groups in one."""
    return config.select("session_id", F.struct(*[F.struct(*[F.col(f"{g}_{f}").alias(f) for f in fields]).alias(g) for g, fields in groups.items()]).alias("last_run"))
