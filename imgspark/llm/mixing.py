"""Mixing sources to target weights, with DataFrame functions only.

Words per source are aggregated, targets follow by water-filling over the sources, and a
document is emitted floor(rate) times plus one Bernoulli copy, seeded by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from imgspark.llm.scratch import Scratch

#: Weights of the sources in order of code points, null last, repeated as often as needed.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Sources up to which the plan is broadcast: some 10 MB.
MOST_BROADCAST = 100_000


def word_count(text) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(key) -> Column:
    """A number in [0, 1) from the first 13 hex digits of the key's md5; the same in any engine."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def running(scratch: Scratch, rows: DataFrame, order: list, sums: tuple = ()) -> DataFrame:
    """rows plus _n and, for each name in sums, _<name>: how many rows come before in the order, and their
    sum. Ranges of the order are dealt out and summed by themselves; only the ranges' totals, a row
    a partition, are summed in one place."""
    part = scratch.cut(rows.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = part.withColumn("_n", F.count(F.lit(1)).over(before))
    for c in sums:
        own = own.withColumn(f"_{c}", F.coalesce(F.sum(c).over(before), F.lit(0.0)))
    ranges = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    total = part.groupBy("_pid").agg(F.count(F.lit(1)).alias("t"), *[F.sum(c).alias(f"t_{c}") for c in sums])
    total = total.select("_pid", F.coalesce(F.sum("t").over(ranges), F.lit(0)).alias("o"), *[F.coalesce(F.sum(f"t_{c}").over(ranges), F.lit(0.0)).alias(f"o_{c}") for c in sums])
    own = own.join(F.broadcast(total), "_pid")
    return own.select(*rows.columns, (F.col("_n") + F.col("o")).alias("_n"), *[(F.col(f"_{c}") + F.col(f"o_{c}")).alias(f"_{c}") for c in sums])


def source_targets(sized: DataFrame, weights=WEIGHTS, most=MOST_REPEATS) -> DataFrame:
    """(source, source_size, target, rate) from (source, size).

    target = min(most * size, level * weight), the level such that targets add up to all sizes:
    the fixed point of "what exceeds the cap is shared again by weight". The cap binds first where
    cap / weight is smallest, so with sources in that order the level after the first j are capped
    is (total - caps so far) / (weights left), and it holds for the first j whose next source stays
    below its cap. Ranks and running sums go by ranges, so that sources may be very many; sums of
    sizes and weights are whole numbers, so the order of adding does not show.
    """
    scratch = Scratch(sized.sparkSession, "targets")
    name = F.col("source").asc_nulls_last()
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_n"), F.lit(len(weights))) + 1).cast("int"))
    per = running(scratch, per, [name]).withColumn("w", w).withColumn("cap", (F.col("source_size") * most).cast("double"))
    per = per.withColumn("full", F.col("cap") / F.col("w")).drop("_n")
    per = scratch.cut(running(scratch, per, [F.col("full").asc(), name], ("cap", "w")))
    # two numbers, then one, that hold for all sources
    total, weight = per.agg(F.sum("source_size").cast("double"), F.sum("w")).first()
    level = (F.lit(total) - F.col("_cap")) / (F.lit(weight) - F.col("_w"))
    per = per.withColumn("level", level).withColumn("holds", F.col("level") * F.col("w") <= F.col("cap"))
    chosen = per.agg(F.min_by("level", F.when(F.col("holds"), F.struct("full", "source")))).first()[0]
    target = F.least(F.col("cap"), F.coalesce(F.lit(chosen).cast("double"), F.col("level")) * F.col("w"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return per.withColumn("target", target).select("source", "source_size", "target", rate.alias("rate"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """All columns of docs plus _mix_size, _mix_source_size, _mix_target, _mix_copies.

    A null or blank text has size 0; a null source is a source of its own, last in order. A null
    id is hashed as an empty string; rows with equal ids share one draw, so reruns and repeated
    rows agree. The rate is target / size of the source, at most `most`, so no document is
    emitted more often. Only the per-source table, one row a source, is joined back; it is broadcast
    only if it is counted to have at most MOST_BROADCAST rows. An empty table gives an empty table. Own
    columns start with _mix_; a column of docs that does so too is an error.
    """
    if clash := [c for c in docs.columns if c.startswith("_mix_")]:
        raise ValueError(f"columns that mix_plan makes itself: {clash}")
    own = docs.withColumn("_mix_size", word_count(F.col(text_col).cast("string"))).withColumn("_mix_key", F.to_json(F.struct(F.col(source_col).cast("string").alias("s"))))
    sized = own.select(F.col(source_col).cast("string").alias("source"), F.col("_mix_size").alias("size"))
    plan = source_targets(sized, weights, most).select(
        F.to_json(F.struct(F.col("source").alias("s"))).alias("_mix_key"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target"), F.col("rate").alias("_mix_rate")
    )
    plan = Scratch(docs.sparkSession, "mixing").cut(plan)
    # one row a source: broadcast only when counted to be few, else a join that Spark may split
    small = plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    own = own.join(F.broadcast(plan) if small else plan, "_mix_key")
    draw = unit_hash(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    whole = F.floor("_mix_rate")
    copies = whole + F.when(draw < F.col("_mix_rate") - whole, 1).otherwise(0)
    return own.withColumn("_mix_copies", copies.cast("long")).drop("_mix_key", "_mix_rate")


def mix_emit(docs: DataFrame, **named) -> DataFrame:
    """The mix itself: every document as many times as its plan says, with the columns of docs. Nulls and
    repeated rows: as in mix_plan; documents without words are emitted like others of their source."""
    plan = mix_plan(docs, **named).filter("_mix_copies > 0")
    plan = plan.withColumn("_mix_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies"))))
    return plan.select(*[F.col(f"`{c}`") for c in docs.columns])
