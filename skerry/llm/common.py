"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_root

#: Bytes of text that one numpy pass works on; bounds a worker's memory whatever the batch size.
SLICE_BYTES = 2_000_000

_made: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write df once as Parquet into the shared folder and read it back.

    This cuts lineage and lets later stages prune columns. The table is removed
    when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/skerry-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_tables() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            return


def site_of(url: str = "url") -> Column:
    """The host of a url in lower case; a null or hostless url belongs to the site ''."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1))


def strings(column: pa.Array) -> pa.Array:
    """column as large_string without nulls."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array and the bounds of its rows in them."""
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch cut into runs of rows that hold up to limit bytes of text (one row at least)."""
    column = strings(batch.column(text))
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def runs(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in runs of a few rows, for passes that build Python objects of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Values of the 256 bytes in the rolling hashes, the multiplier and its inverse modulo 2**64.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """h with its bits mixed (a bijection on 64 bits)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Prefix sums of a byte string that give the hash of any of its ranges in constant time."""

    def __init__(self, values: np.ndarray):
        p, self.inverse = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * p[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


#: Bytes that belong to words: ASCII letters and digits, and all bytes of non-ASCII characters.
WORD_BYTES = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def word_hashes(data: np.ndarray, bounds: np.ndarray, word: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word in the rows of a buffer; words don't cross rows."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = word[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | fresh[1:-1]
    end = np.ones(len(data), bool)
    end[:-1] = ~inside[1:] | fresh[1:-1]
    end &= inside
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return mixed(Rolling(BYTE_VALUES[data]).of(s, e) + (e - s).astype(np.uint64)), np.searchsorted(bounds, s, "right") - 1
