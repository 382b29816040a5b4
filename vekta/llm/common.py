"""Helpers shared by the corpus operators: staged tables, text batches, byte n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..plans.shipping import ensure_shipped
from ..session import scratch_path

SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back:
    cuts the lineage, and a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    ensure_shipped(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores added until no column has it (Spark compares names without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def text_slices(batches: Iterator[pa.RecordBatch], col: str,
                max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into row slices of about ``max_bytes`` of text (one row at
    least), so a task's memory follows the slice and its longest text."""
    for b in batches:
        if b.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // max_bytes
        cuts = np.flatnonzero(np.diff(part)) + 1
        for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
            yield b.slice(s, e - s)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    a = pc.fill_null(col, "").cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def byte_ngrams(data: np.ndarray, off: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams that lie inside one text: (row, bucket), in text order."""
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    key = np.zeros(m, np.uint32)
    for k in range(n):
        key = key * np.uint32(257) + data[k:k + m]
    key *= np.uint32(2654435761)
    key ^= key >> np.uint32(15)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    inside = row[:m] == row[n - 1:]
    return row[:m][inside], (key[inside] % np.uint32(buckets)).astype(np.int32)


def numbered(items: Iterable) -> tuple[np.ndarray, dict]:
    """A number for each item, by first place, and the numbers of the distinct
    items (a dict: pandas takes strings that differ after a NUL for equal)."""
    known: dict = {}
    codes = [known.setdefault(x, len(known)) for x in items]
    return np.array(codes, np.int64), known


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of consecutive segments values[off[i]:off[i+1]] (empty ones give 0)."""
    c = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return c[off[1:]] - c[off[:-1]]
