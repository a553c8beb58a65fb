"""Helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows and characters that a task works on at once; a longer text is worked on alone.
SLICE_ROWS, SLICE_CHARS = 1000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null is empty. In a text of ASCII only, as most are,
    ``lower`` does just that and is much faster."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def slices(batches: Iterable[pa.RecordBatch], text: int = 1) -> Iterator[list[list]]:
    """Columns of few rows at a time, cut by the length of the text column, so that long texts
    do not pile up in a Python worker."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE_ROWS):
            columns = [c.to_pylist() for c in batch.slice(first, SLICE_ROWS).columns]
            start = size = 0
            for i, value in enumerate(columns[text]):
                size += len(value or "")
                if size >= SLICE_CHARS:
                    yield [c[start : i + 1] for c in columns]
                    start, size = i + 1, 0
            if start < len(columns[text]):
                yield [c[start:] for c in columns]


def map_texts(df: DataFrame, rows: Callable[[list[list]], Iterable[tuple]], schema: pa.Schema, text: int = 1) -> DataFrame:
    """``rows`` turns the columns of a slice into output rows; Spark deals the slices to tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in slices(batches, text):
            out = list(rows(columns))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema
                )

    return df.mapInArrow(run, from_arrow_schema(schema))


def text_key(text: Column) -> Column:
    """A 64-bit hash of a text, by which the drops name rows; null is a text of its own."""
    return F.xxhash64(text)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it what is no column of ``df`` yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_texts(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text's key is in the only column of ``dropped``."""
    key = free_name(docs, "text_key")
    gone = dropped.select(F.col(dropped.columns[0]).alias(key)).distinct()
    return docs.join(gone, text_key(F.col("text")) == F.col(key), "left_anti")


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that start and last as told, one after another."""
    ends = np.cumsum(lengths)
    shift = np.repeat(starts - (ends - lengths), lengths)
    return flat[shift + np.arange(len(shift))]


#: Bits, a power of two, of the map that keeps rows of other keys out of a shuffle.
MAP_BITS = 1 << 25


def maybe_among(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``column`` is not in the only column of ``keys``, by a bit map of
    bounded size that goes to every task; a join with ``keys`` has to follow."""

    def place(value: Column) -> tuple[Column, Column]:
        bit = F.pmod(F.xxhash64(value), F.lit(MAP_BITS))
        return F.shiftright(bit, 6), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))

    slot, bit = place(F.col(keys.columns[0]))
    bits = keys.select(slot.alias("__slot"), bit.alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))
    slot, bit = place(F.col(column))
    found = df.filter(F.col(column).isNotNull()).join(F.broadcast(bits), slot == F.col("__slot"))
    return found.filter(F.col("__bits").bitwiseAND(bit) != 0).drop("__slot", "__bits")


def joined(parts: Column) -> Column:
    """Texts joined by commas; empty where there are none."""
    return F.coalesce(F.array_join(parts, ","), F.lit(""))
