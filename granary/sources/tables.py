"""Readers. Schemas are declared, never inferred; a missing optional table is not an error."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import constants as K
from granary.operators.shape import rename_by_synonym


def lake_path(root: str, layer: str, table: str) -> str:
    return "/".join((root.rstrip("/"), layer.strip("/"), table.strip("/")))


def read_csv_text(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """Headered CSV with every column as text; pass the columns to skip reading the header first."""
    reader = spark.read.option("header", True).option("inferSchema", False)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def read_csv_by_name(spark: SparkSession, folder: str, pattern: str, into: str,
                     synonyms: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Many CSV files with drifting headers; `pattern`'s first group of the file name becomes a column.

    Files with the same header are read as one scan, so the plan has one branch per header, not per file.
    """
    frames = [
        rename_by_synonym(frame.withColumn(
            into, F.regexp_extract(F.replace("_metadata.file_name", F.lit("%20"), F.lit(" ")),
                                   pattern, 1)), synonyms or {})
        for frame in _frames_by_header(spark, folder)
    ]
    return union_all(frames)


def read_history_csvs(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    """Hand-collected CSV files whose headers differ, and the paths of files that cannot be read, which are left out."""
    unreadable: list[str] = []
    frames = [rename_by_synonym(f, K.HISTORY_COLUMNS) for f in _frames_by_header(spark, folder, unreadable)]
    return union_all(frames), unreadable


#: Bytes of a file that are read for its header line, and files that one task reads headers of.
HEADER_BYTES, FILES_PER_TASK = 1 << 16, 200


def csv_headers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, header, error) of every CSV file below a folder: one distributed job that opens each file's first block only.

    Header names are null for an empty file; error says why a file cannot be read (it cannot be opened, is not UTF-8, or its
    header line does not end within HEADER_BYTES).
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.{csv,CSV}")
             .option("recursiveFileLookup", True).load(folder).select("path"))
    tasks = -(-files.count() // FILES_PER_TASK) or 1
    schema = "path string, header array<string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = [_header(p) for p in paths]
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array([h for h, _ in found], pa.list_(pa.string())),
                 pa.array([e for _, e in found], pa.string())], ["path", "header", "error"])

    return files.repartition(tasks, "path").mapInArrow(run, schema)


def _header(path: str) -> tuple[list[str] | None, str | None]:
    try:
        system, place = file_system(path)
        with system.open_input_stream(place) as source:
            block = source.read(HEADER_BYTES)
        if not block:
            return None, None
        if len(block) == HEADER_BYTES and b"\n" not in block:
            return None, "no header line"
        whole = block[:block.rindex(b"\n")] if b"\n" in block else block
        return next(csv.reader(io.StringIO(whole.decode("utf-8-sig"))), None), None
    except (OSError, UnicodeDecodeError, csv.Error) as error:
        return None, f"{type(error).__name__}: {error}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    local = path.removeprefix("file:")
    if local != path or path.startswith("/"):
        return pafs.LocalFileSystem(), unquote("/" + local.lstrip("/"))
    return pafs.FileSystem.from_uri(path)


def _frames_by_header(spark: SparkSession, folder: str, unreadable: list[str] | None = None) -> list[DataFrame]:
    """One scan per distinct header; only headers and paths reach the driver.

    A file that cannot be read fails the job, unless a list is given to take its path.
    """
    headers = csv_headers(spark, folder).groupBy("header", F.col("error").isNotNull().alias("bad")).agg(
        F.sort_array(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    bad = sorted(p for row in headers if row["bad"] for p in row["paths"])
    if bad and unreadable is None:
        raise OSError(f"unreadable: {', '.join(bad[:5])}")
    if unreadable is not None:
        unreadable += bad
    return [_read_alike(spark, row["header"], row["paths"]) for row in headers if row["header"] and not row["bad"]]


def _read_alike(spark: SparkSession, header: list[str], paths: list[str]) -> DataFrame:
    """Files of one header in one scan; empty and repeated names get the place of their column."""
    names = [h if h and header.count(h) == 1 else f"{h or '_c'}{i}" for i, h in enumerate(header)]
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(
        T.StructType([T.StructField(n, T.StringType()) for n in names])).csv([unquote(p) for p in paths])


def read_dataset(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet file or state=... tree; partition values stay text and prune the listing."""
    key = "spark.sql.sources.partitionColumnTypeInference.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = spark.read.parquet(path)
    finally:
        spark.conf.set(key, before)
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table if it exists, else an empty one, so a left join leaves typed NULLs."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    wanted = T.StructType.fromDDL(schema)
    return df.select(*[
        F.col(f.name).cast(f.dataType) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in wanted
    ])


def pick_file(spark: SparkSession, folder: str, glob: str, by: str = "name",
              exclude: str | None = None) -> str:
    """The last file by name, or the largest; only the listing is read, not the content."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True).load(folder).select("path", "length")
    )
    if exclude:
        files = files.where(~F.element_at(F.split("path", "/"), -1).contains(exclude))
    order = [F.desc("length"), F.asc("path")] if by == "size" else [F.desc("path")]
    found = files.orderBy(*order).limit(1).collect()
    if not found:
        raise FileNotFoundError(f"no {glob} in {folder}")
    return found[0]["path"]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    if not frames:
        raise FileNotFoundError("nothing to read")
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def is_crop_loan_table(df: DataFrame) -> bool:
    return K.CROP_LOAN_COLUMNS <= set(df.columns)
