"""Keep-first, audits, and checks that fail the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import columns as C


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str] | None = None) -> DataFrame:
    """One row per key, always the same one.

    The rank filter is applied on the map side first, so a key with many copies shuffles
    one row per task, not all of them. By default all other columns order the copies.
    """
    present = [k for k in keys if k in df.columns]
    by = list(order) if order is not None else [c for c in df.columns if c not in present]
    window = Window.partitionBy(*present).orderBy(*(by or [F.lit(1)]))
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], at: str, ties: Sequence[Column | str] = ()) -> DataFrame:
    return keep_first(df, keys, [F.desc(at), *ties])


def inconsistent_keys(df: DataFrame, key: str, details: Sequence[str]) -> DataFrame:
    """Keys that carry more than one value of any detail, NULL counting as a value.

    Copies go first, on hashes and on the map side; smallest against largest then needs no distinct sets.
    """
    def varies(name: str) -> Column:
        nulls = F.max(F.col(name).isNull().cast("int"))
        known = F.max(F.col(name).isNotNull().cast("int"))
        differs = F.coalesce(F.min(name) != F.max(name), F.lit(False))
        return differs | (nulls + known == 2)

    audit = df.select(key, *details).distinct().groupBy(key).agg(*[varies(d).alias(f"varies_{d}") for d in details])
    some = audit[f"varies_{details[0]}"]
    for d in details[1:]:
        some = some | audit[f"varies_{d}"]
    return audit.where(some)


def location_violations(df: DataFrame) -> DataFrame:
    """Counts of each broken rule of the location master, in one row."""
    per_id = df.groupBy("mandi_id").agg(
        F.count("*").alias("n"),
        F.sum((F.col("latitude").isNull() | F.col("longitude").isNull()).cast("int")).alias("no_coords"),
        F.sum((~C.inside_box()).cast("int")).alias("outside"),
    )
    return per_id.agg(
        F.coalesce(F.sum(F.when(F.col("mandi_id").isNull(), F.col("n"))), F.lit(0)).alias("missing_id"),
        F.coalesce(F.sum(F.when(F.col("mandi_id").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_id"),
        F.coalesce(F.sum("no_coords"), F.lit(0)).alias("missing_coordinates"),
        F.coalesce(F.sum("outside"), F.lit(0)).alias("outside_box"),
    )


class CheckFailed(ValueError):
    pass


def require_no_violations(counts: DataFrame) -> None:
    broken = {k: v for k, v in counts.first().asDict().items() if v}
    if broken:
        raise CheckFailed(f"location master breaks its rules: {broken}")
