"""Writers. Rows are clustered on the partition column first, so each task writes few files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.tables import file_system


def write_partitioned(df: DataFrame, path: str, by: str = "state", mode: str = "overwrite") -> None:
    """The rebalance hint lets adaptive execution split a hot value and merge small ones."""
    df.hint("rebalance", by).write.mode(mode).partitionBy(by).option("compression", "snappy").parquet(path)


def folder_name(value: Column) -> Column:
    return F.translate(value, " /", "_-")


def write_by_state(df: DataFrame, path: str) -> None:
    """Folder-safe state names; rows without a state are kept, a table without the column goes to ALL."""
    state = folder_name(F.col("state")) if "state" in df.columns else F.lit("ALL")
    write_partitioned(df.withColumn("state", state), path)


def ordered(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Total order over all files, by range partitions."""
    return df.orderBy(*by) if by else df


def write_flat(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    ordered(df, by).write.mode(mode).option("compression", "snappy").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    ordered(df, by).write.mode(mode).option("header", True).csv(path)


def write_named_csvs(df: DataFrame, path: str, name: Column) -> int:
    """One headered CSV file per value of `name`, which is its file name; returns the number of files.

    Rows of a file meet in one task and are written as they come, batch by batch. Nulls are empty fields.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sink, files = None, None, 0
        system, place = file_system(path)
        system.create_dir(place)
        for batch in batches:
            names = batch.column(0)
            for file in names.unique().to_pylist():
                if file != here:
                    if sink is not None:
                        sink.close()
                    here, files = file, files + 1
                    sink = pacsv.CSVWriter(system.open_output_stream(f"{place}/{file}"), pa.schema(list(batch.schema)[1:]))
                sink.write_batch(batch.filter(pc.equal(names, file)).select(columns))
        if sink is not None:
            sink.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})

    rows = df.select(name.alias("_file"), *columns).where("_file is not null")
    written = rows.repartition("_file").sortWithinPartitions("_file").mapInArrow(run, "files long")
    return written.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def write_prediction_log(df: DataFrame, path: str, at: str = "timestamp") -> None:
    """One JSON object per scored request under a folder per day."""
    (
        df.withColumn("log_date", F.to_date(at)).hint("rebalance", "log_date")
        .write.mode("append").partitionBy("log_date").json(path)
    )
