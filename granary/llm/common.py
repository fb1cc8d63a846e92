"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a text, A-Z lower-cased, everything but digits, letters and non-ASCII bytes turned into spaces.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def alnum_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text, A-Z lower-cased, as UTF-8; none for null."""
    return utf8(text).translate(ALNUM).split()


def space_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased, as UTF-8; none for null."""
    return utf8(text).lower().split()


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def map_texts(
    df: DataFrame, columns: list[str], schema: str, rows: Callable[..., Iterable[tuple]], step: int = 512,
) -> DataFrame:
    """mapInArrow over the named columns: rows(list, list, ...) gets step rows at a time and gives tuples of schema.

    Only the named columns leave the JVM, so other columns of df, whatever their names, cannot clash.
    """
    source = df.select(*columns)
    out = arrow_schema(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = list(rows(*[c.to_pylist() for c in part.columns]))
                if got:
                    yield to_batch(got, out)

    return source.mapInArrow(run, schema)


def with_columns(
    df: DataFrame, inputs: list[str], schema: str, rows: Callable[..., Iterable[tuple]], keep: list[str] | None = None,
    step: int = 512,
) -> DataFrame:
    """The columns of df in keep (all by default) and behind them those of schema; no shuffle, no other order of rows.

    rows(list, list, ...) gets the inputs of step rows at a time and gives one tuple for each.
    """
    kept = df.columns if keep is None else keep
    names = list(dict.fromkeys([*kept, *inputs]))
    out = arrow_schema(df, schema)
    places = [names.index(c) for c in inputs]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = to_batch(list(rows(*[part.columns[k].to_pylist() for k in places])), out)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made.columns], [*kept, *out.names])

    return df.select(*[f"`{c}`" for c in names]).mapInArrow(run, ", ".join([*kinds, schema]))


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


class Kept(dict):
    """A dict that forgets everything once it holds a bounded number of keys, so that a long-lived worker stays small."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def __setitem__(self, key: Any, value: Any) -> None:
        if len(self) >= self.most:
            self.clear()
        super().__setitem__(key, value)
