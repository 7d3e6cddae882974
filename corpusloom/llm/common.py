"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.scale import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space, as ``bytes.split()`` cuts it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text worked on at once: numpy needs some hundred bytes for each.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``size`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + size, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(text_bytes(column)[1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, index, data = column.buffers()
    offsets = np.frombuffer(index, dtype=kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize)
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0]: offsets[-1]], offsets - offsets[0]


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


PRIME = np.uint64((1 << 61) - 1)
BASE = 0x9E3779B97F4A7C15 % ((1 << 61) - 1)
INVERSE = pow(BASE, -1, (1 << 61) - 1)
LOW30, LOW31 = np.uint64((1 << 30) - 1), np.uint64((1 << 31) - 1)
U1, U8, U30, U31, U61 = (np.uint64(x) for x in (1, 8, 30, 31, 61))


def reduced(x: np.ndarray) -> np.ndarray:
    """64-bit numbers modulo 2 ** 61 - 1."""
    x = (x & PRIME) + (x >> U61)
    return np.where(x >= PRIME, x - PRIME, x)


def shifted(x: np.ndarray) -> np.ndarray:
    """x * 2 ** 31 modulo 2 ** 61 - 1, below 2 ** 62 + 2 ** 34; x is below 2 ** 64."""
    return (x >> U30) + ((x & LOW30) << U31)


def product(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """a * (high * 2 ** 31 + low) modulo 2 ** 61 - 1 for factors below it."""
    a_low, a_high = a & LOW31, a >> U31
    return reduced(((a_high * high) << U1) + shifted(a_high * low + a_low * high) + a_low * low)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Low 31 and high 30 bits of base ** 0 .. base ** n modulo 2 ** 61 - 1."""
    out = np.ones(1, np.uint64)
    while len(out) <= n:
        step = np.uint64(pow(base, len(out), int(PRIME)))
        out = np.concatenate([out, product(out, step & LOW31, step >> U31)])
    return out & LOW31, out >> U31


class Rolling:
    """Hashes of any piece of a byte string from one prefix sum.

    Polynomials modulo the prime 2 ** 61 - 1: two different pieces of n bytes agree for at
    most n of all bases, whatever their structure (modulo 2 ** 64 strings such as
    Thue-Morse's agree for every base).
    """

    _up, _down = powers(BASE, 1 << 12), powers(INVERSE, 1 << 12)
    _PART = 1 << 22  # terms whose sums of products with a byte fit 64 bits

    def __init__(self, data: np.ndarray) -> None:
        if len(data) >= len(Rolling._up[0]):  # tables of powers grow to the longest slice seen
            top = 1 << len(data).bit_length()
            Rolling._up, Rolling._down = powers(BASE, top), powers(INVERSE, top)
        self.data, self.back = data, Rolling._down
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        low, high = Rolling._up
        for at in range(0, len(data), self._PART):
            x = data[at: at + self._PART].astype(np.uint64) + U1
            end = at + len(x)
            total = reduced(np.cumsum(x * low[at:end])) + reduced(shifted(np.cumsum(x * high[at:end])))
            self.sums[at + 1: end + 1] = reduced(total + self.sums[at])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hashes of data[start:stop]; equal pieces agree."""
        return mixed(product(reduced(self.sums[stop] + PRIME - self.sums[start]), self.back[0][start], self.back[1][start]))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all pieces of ``width`` bytes; those of up to 16 bytes come from one or two words of 8 bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.empty(0, np.uint64)
        if width > 16:
            return mixed(product(reduced(self.sums[width:] + PRIME - self.sums[:n]), self.back[0][:n], self.back[1][:n]))
        word = min(width, 8)
        block = np.zeros(n + width - word, np.uint64)
        for i in range(word):
            block = (block << U8) | self.data[i: i + len(block)]
        first = mixed(block)
        return mixed(first[:n] ^ (block[width - word:] + BYTES)) if width > 8 else first


BYTES = np.uint64(0x9E3779B97F4A7C15)


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of the texts; no word spans two texts."""
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    space = SPACE[data]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    ink = ~space
    return np.flatnonzero(ink & (before | opens[:n])), np.flatnonzero(ink & (after | opens[1:])) + 1


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a compressed table in the shared folder; smaller than a checkpoint for texts."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
