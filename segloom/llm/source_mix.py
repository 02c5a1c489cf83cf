"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

Each source has a target in words. The mix is so many blocks of BLOCK words as its sources' targets make, and each goes
to the source with the highest quotient of its target by 1, 3, 5, ...; a source's blocks go to its SHARDS in the same
way, by the shards' words. A shard's documents stand in a seeded order, and its quota takes whole rounds of them and
then the first blocks, so that no document is taken over MOST times. A source at its bound is taken MOST times whole.

Quotients needn't be gone through one by one: with ``n`` names of total weight W, the divisors W / (seats ± n/2) give
seats that are surely too few and surely too many, and only the few quotients between are ranked. Ranks come from a
range partition, so no source, shard or quotient is gathered in one task. Everything is in DataFrame functions.

Defined cases: a null text has no words; null sources are one source, the last in order; empty texts and sources take
nothing; a table without words has targets of zero. Rows of one doc_id are documents of their own; among rows alike in
doc_id and text it is left open which is taken first, they are the same rows in the result. Equal quotients go by source or
shard. Other columns, whatever their names, are left out; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, split_words, table, text_or_empty

BLOCK, SHARDS, MOST, SEED = 8, 1024, 3, 42
WEIGHTS = (1, 2, 3)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 1: within ranges of it, plus what the ranges before have."""
    placed = table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = sizes.select(F.col("__range").alias("__r"), (F.sum("__n").over(W.orderBy("__range")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__range").orderBy("__at"))
    # a row for each partition, so it is small
    return placed.withColumn("__inside", inside).join(F.broadcast(offsets), F.col("__range") == F.col("__r")).select(*rows.columns, (F.col("__inside") + F.col("__before")).alias(name))


def apportion(names: DataFrame) -> DataFrame:
    """``names`` (grp, name, weight, seats: the seats of its grp) with ``quota``, its part of the seats, by highest quotients.

    Names are integers; groups without weight get nothing.
    """
    total = names.groupBy(F.col("grp").alias("g")).agg(F.sum(F.col("weight").cast("double")).alias("all"), F.count("*").alias("n"))
    known = names.join(total, F.col("grp") == F.col("g")).drop("g")

    def rounded(seats: Column) -> Column:
        return F.floor(F.col("weight") * seats / F.col("all") + 0.5)

    few = F.when((F.col("all") > 0) & (F.col("seats") > F.col("n") / 2), F.greatest(rounded(F.col("seats") - F.col("n") / 2) - 1, F.lit(0))).otherwise(0)
    many = F.when(F.col("weight") > 0, rounded(F.col("seats") + F.col("n") / 2) + 1).otherwise(0)
    bounded = table(known.withColumns({"few": few.cast("long"), "many": many.cast("long")}))
    rest = bounded.groupBy(F.col("grp").alias("g")).agg((F.first("seats") - F.sum("few")).alias("rest"))
    next_ones = bounded.where("many > few").select("grp", "name", F.col("weight").cast("double").alias("w"), F.explode(F.sequence(F.col("few") + 1, F.col("many"))).alias("k"))
    quotients = next_ones.select("grp", "name", (F.col("w") / (2 * F.col("k") - 1)).alias("quotient"))
    ranked = numbered(quotients, [F.asc("grp"), F.desc("quotient"), F.asc("name")], "rank")
    first = ranked.groupBy(F.col("grp").alias("f")).agg(F.min("rank").alias("first"))
    won = ranked.join(first, F.col("grp") == F.col("f")).join(rest, F.col("grp") == F.col("g")).where(F.col("rank") - F.col("first") < F.col("rest")).groupBy(F.col("grp").alias("g"), F.col("name").alias("m")).agg(F.count("*").alias("more"))
    return bounded.join(won, (F.col("grp") == F.col("g")) & (F.col("name") == F.col("m")), "left").select(*names.columns, (F.col("few") + F.coalesce("more", F.lit(0))).alias("quota"))


def targets(sources: DataFrame, most: int = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``number``, by code points and null last, and ``target``: all words by weights that repeat in this order.

    Targets stop at ``most`` times their source; what is over is shared again by weight, until none is above. Each round
    bounds more sources, and only three sums of it are known here.
    """
    placed = numbered(sources, [F.asc_nulls_last("source")], "number")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"))
    known = table(placed.withColumns({"weight": weight, "most": most * F.col("source_size")}))
    rate = 0.0
    while True:
        bounded = F.col("most") <= rate * F.col("weight")
        held, open_weight, words = known.agg(F.sum(F.when(bounded, F.col("most")).otherwise(0)), F.sum(F.when(bounded, 0).otherwise(F.col("weight"))), F.sum("source_size")).first()
        if not open_weight or (share := (words - held) / open_weight) <= rate:
            break
        rate = share
    target = F.least(F.lit(rate) * F.col("weight"), F.col("most").cast("double"))
    return known.select("source", "source_size", "number", target.alias("target"), (target >= F.col("most")).alias("bounded"))


def mixed(docs: DataFrame, block: int = BLOCK, shards: int = SHARDS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of each document (doc_id, source, text)."""
    text = text_or_empty()
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(" ")), text)
    sized = docs.select("doc_id", "source", F.size(split_words(text)).cast("long").alias("size"), order.alias("order"))
    parts = table(sized.withColumn("shard", F.pmod(F.col("order"), F.lit(shards)).cast("int")))
    cells = table(parts.groupBy("source", "shard").agg(F.sum("size").alias("words")))
    sources = table(targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), most))
    blocks = sources.agg(F.round(F.sum("target") / block)).first()[0] or 0
    seats = apportion(sources.select(F.lit(0).alias("grp"), F.col("number").alias("name"), F.col("target").alias("weight"), F.lit(int(blocks)).alias("seats")))
    by_number = sources.join(seats.select(F.col("name").alias("number"), "quota"), "number")
    own = by_number.withColumnRenamed("source", "of_source")
    placed = cells.join(own, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    quotas = apportion(placed.select(F.col("number").alias("grp"), F.col("shard").alias("name"), F.col("words").alias("weight"), F.col("quota").alias("seats")))
    shares = placed.drop("quota").join(quotas.select(F.col("grp").alias("number"), F.col("name").alias("shard"), "quota"), ["number", "shard"])
    taken = F.when(F.col("bounded"), most * F.col("words")).otherwise(F.least(F.col("quota") * block, most * F.col("words")))
    cell = shares.select(F.col("source").alias("of_source"), F.col("shard").alias("of_shard"), "words", "source_size", "target", taken.alias("share"))
    joined = parts.join(cell, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("shard") == F.col("of_shard")))
    before = F.coalesce(F.sum("size").over(W.partitionBy("source", "shard").orderBy("order", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rounds, rest = F.expr("share div words"), F.expr("share % words")
    part = F.greatest(F.least(rest - F.col("before"), F.col("size")), F.lit(0))
    own_words = F.when(F.col("words") > 0, rounds * F.col("size") + part).otherwise(0)
    return joined.withColumn("before", before).select("doc_id", "size", "source_size", "target", own_words.cast("long").alias("taken"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents"))
