"""Exact interpolated quantiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one aggregation buffer. Here the values are staged
once, a sketch brackets each wanted rank, and everything outside the brackets collapses to counts before the exchange. The
sketch goes to the values, which are never dealt out by group: a few groups would be a few tasks. What is left is dealt over range partitions of (group, value); each partition counts from its own start, and the counts of the
partitions before it, a handful of numbers a group, turn places into ranks. So no task ever orders a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import durable

ACCURACY = 10_000
#: Groups whose sketches, some 200 bytes each, go to every task; those of more are spread by value, so no group is one task.
FEW_GROUPS, SPREAD = 10_000, 16


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float],
                    accuracy: int = ACCURACY) -> DataFrame:
    """One row per group with one column per wanted quantile, linear between neighbouring ranks."""
    known = durable(df.where(F.col(value).isNotNull()).select(
        F.struct(*([F.col(k) for k in keys] or [F.lit(0).alias("all")])).alias("_g"),
        F.col(value).cast("double").alias("_v")), "values")
    # A sketch rank is off by at most total / accuracy, and in groups over `accuracy` rows the two
    # neighbouring ranks are closer than that too, so four such steps either side hold both.
    margin = 4.0 / accuracy
    points = [min(max(q + side * margin, 0.0), 1.0) for q in wanted.values() for side in (-1, 1)]
    sketch = known.groupBy("_g").agg(
        F.count("*").alias("_total"),
        F.percentile_approx("_v", F.array(*map(F.lit, points)), F.lit(accuracy)).alias("_cut"))

    if keys:
        sketch = durable(sketch, "sketch")
        if sketch.count() <= FEW_GROUPS:
            matched = known.join(F.broadcast(sketch), "_g")
        else:
            share = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
            matched = known.withColumn("_share", F.pmod(F.hash("_v"), F.lit(SPREAD))).hint("merge").join(
                sketch.withColumn("_share", share), ["_g", "_share"])
    else:
        # One group: its sketch is a scalar, not a join side.
        packed = sketch.agg(F.first(F.struct("_total", "_cut"))).scalar()
        matched = known.withColumn("_s", packed).select("_g", "_v", "_s._total", "_s._cut")
    small = F.col("_total") <= accuracy
    inside, passed = small, F.lit(0)
    for i in range(len(wanted)):
        low, high = F.col("_cut")[2 * i], F.col("_cut")[2 * i + 1]
        inside = inside | F.col("_v").between(low, high)
        passed = passed + (F.col("_v") >= low).cast("int") + (F.col("_v") > high).cast("int")
    # The slot counts the bracket ends a value has passed, so slots are in value order.
    counted = matched.groupBy(
        "_g", "_total",
        F.when(small, F.lit(0)).otherwise(passed).alias("_slot"),
        F.when(inside, F.col("_v")).alias("_v"),
    ).agg(F.count("*").alias("_n"))
    # Written once, as another run could cut the ranges elsewhere.
    ranged = durable(counted.repartitionByRange("_g", "_slot", "_v").withColumn("_p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_g", "_p").agg(F.sum("_n").alias("_s")).groupBy("_g").agg(
        F.sort_array(F.collect_list(F.struct("_p", "_s"))).alias("_parts"))
    before = F.transform("_parts", lambda part, i: F.struct(
        part["_p"].alias("_p"), F.aggregate(F.slice("_parts", 1, i), F.lit(0).cast("long"), lambda total, x: total + x["_s"]).alias("_before")))
    offsets = sums.select("_g", F.inline(before))
    in_part = Window.partitionBy("_g", "_p").orderBy("_slot", "_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("_upto", F.sum("_n").over(in_part)).where(F.col("_v").isNotNull()).join(
        offsets, ["_g", "_p"]).withColumn("_last", F.col("_before") + F.col("_upto") - 1).withColumn(
        "_first", F.col("_last") - F.col("_n") + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_v")))

    def position(q: float) -> Column:
        return F.lit(float(q)) * (F.col("_total") - 1)

    ends = ranked.groupBy("_g", "_total").agg(
        *[at(F.floor(position(q))).alias(f"_lo_{n}") for n, q in wanted.items()],
        *[at(F.ceil(position(q))).alias(f"_hi_{n}") for n, q in wanted.items()])

    def between(name: str, q: float) -> Column:
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return low + (high - low) * (position(q) - F.floor(position(q)))

    return ends.select(*[F.col("_g")[k].alias(k) for k in keys],
                       *[between(n, q).alias(n) for n, q in wanted.items()])
