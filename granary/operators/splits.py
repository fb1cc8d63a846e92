"""Time-ordered splits, folds and the persistence baseline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import columns as C
from granary.operators.joins import by_group_and


def chronological_cuts(df: DataFrame, keys: Sequence[str], train: float = 0.70, val: float = 0.85) -> DataFrame:
    """The dates at the given shares of each group's rows, found on counts per day."""
    days = df.groupBy(*keys, "date").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    so_far = group.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ranked = days.select(*keys, "date", F.sum("_n").over(so_far).alias("_end"), F.sum("_n").over(group).alias("_all"))

    def cut(share: float):
        return F.min(F.when(F.col("_end") > F.floor(F.col("_all") * F.lit(share)), F.col("date")))

    return ranked.groupBy(*keys).agg(cut(train).alias("train_cut"), cut(val).alias("val_cut"))


def chronological_split(df: DataFrame, keys: Sequence[str], train: float = 0.70, val: float = 0.85) -> DataFrame:
    """Rows of one date always land in the same part."""
    part = (F.when(F.col("date") <= F.col("train_cut"), "train")
            .when(F.col("date") <= F.col("val_cut"), "val").otherwise("test"))
    return by_group_and(df, chronological_cuts(df, keys, train, val), keys, "date").withColumn("split", part)


def walk_forward_folds(df: DataFrame, min_train_months: int = 6, val_months: int = 1) -> DataFrame:
    """(month_start, fold, role): an expanding training window followed by its validation months."""
    # The months of the whole table are one short array: one entry per calendar month, whatever the data.
    months = df.agg(F.array_sort(F.collect_set(C.month_start("date"))).alias("_all"))
    ranked = months.select(
        F.floor((F.size("_all") - min_train_months) / val_months).cast("int").alias("_last"),
        F.posexplode("_all").alias("_pos", "month_start")).withColumn("month_idx", F.col("_pos") + 1)
    folds = ranked.where(F.col("_last") > 0).withColumn(
        "fold", F.explode(F.sequence(F.lit(1), F.col("_last"))))
    train_end = F.lit(min_train_months) + (F.col("fold") - 1) * val_months
    role = (F.when(F.col("month_idx") <= train_end, "train")
            .when(F.col("month_idx") <= train_end + val_months, "val"))
    return folds.withColumn("role", role).where("role is not null").select("month_start", "month_idx", "fold", "role")


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    return df.withColumn("month_start", C.month_start("date")).join(
        folds.select("month_start", "fold", "role"), "month_start").drop("month_start")


def persistence(train: DataFrame, test: DataFrame, keys: Sequence[str], value: str = "modal_price",
                ties: Sequence[str] = ("mandi_id",)) -> DataFrame:
    """The last training value of each group on every test row; NULL without training rows."""
    last = train.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.max_by(value, F.struct("date", *ties)).alias("naive_price"))
    if "date" not in test.columns:
        return test.join(last, list(keys), "left")
    return by_group_and(test, last, keys, "date", "left")
