"""What the operators share: words and their hashes over whole blocks of text, and tables in the shared folder."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a task hashes together.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP, _OTHER = (int(x) | 1 for x in _rng.integers(2**62, 2**63, 3, dtype=np.uint64))
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session in one process may leave it unset, and gets one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/millrace-{os.getpid()}"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(where)
    return where if "://" in where or where.startswith("file:") else f"file://{where}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written as a table to the shared folder and read again: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables of saved() that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for f in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, want: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = f"_{want}"
    return want


def replacing(df: DataFrame, **columns) -> DataFrame:
    """df with these columns, instead of any that it has by such a name in any case."""
    new = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new], *[v.alias(k) for k, v in columns.items()])


def releasing(step):
    """step, a function for mapInArrow, that gives freed memory back to the system when its task is done: the worker stays, beside an executor that shares its limit."""

    def releasing_step(batches):
        yield from step(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return releasing_step


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(base: int, n: int, known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006  kept between calls
    """Powers 0 to n of base and of its inverse modulo 2**64; the tables stay, with less than twice as many (or 2**16)."""
    if base not in known or len(known[base][0]) <= n:
        size = 1 << max(16, (int(n) - 1).bit_length())
        both = []
        for x in (base, pow(base, -1, 1 << 64)):
            p = np.full(size + 1, x, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        known[base] = tuple(both)
    return known[base]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary Arrow array end to end, and the n + 1 offsets of its values. A null is an empty text."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"" if wide == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a run of texts, found in their bytes: maximal stretches without a byte of `delimiters`.

    starts, ends: byte range of each word. bounds: n + 1 offsets of the texts in the words. hashes: 64 bits for each word.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False, delimiters: np.ndarray = WHITE):
        self.buf, self.offsets = buf, offsets
        inside = ~delimiters[buf]
        begins, ends = inside.copy(), inside.copy()
        if len(buf):
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[:-1][np.diff(offsets) > 0]
            begins[edge] = inside[edge]
            ends[edge[1:] - 1] = inside[edge[1:] - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self._lower = lower

    def hashes(self) -> np.ndarray:
        table = _BYTE[_LOWER] if self._lower else _BYTE
        out, first = np.empty(len(self.starts), np.uint64), 0
        while first < len(self.starts):
            low = self.starts[first]
            last = max(first + 1, int(np.searchsorted(self.ends, low + CHUNK, "right")))
            high = self.ends[last - 1]
            up, down = _powers(_BASE, high - low)
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(table[self.buf[low:high]] * up[: high - low], out=total[1:])
            s, e = self.starts[first:last] - low, self.ends[first:last] - low
            out[first:last] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            first = last
        return out


class Lines(Words):
    """The lines of a run of texts: what line feeds separate. A text has one line more than line feeds; an empty line's hash is 0."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        feeds = np.flatnonzero(buf == 10)
        self.buf, self.offsets, self._lower = buf, offsets, False
        self.starts, self.ends = np.sort(np.concatenate([offsets[:-1], feeds + 1])), np.sort(np.concatenate([offsets[1:], feeds]))
        self.bounds = np.searchsorted(feeds, offsets) + np.arange(len(offsets))


def runs(hashes: np.ndarray, n: int, other: bool = False) -> np.ndarray:
    """A hash of hashes[i:i + n] for each i from 0 to len(hashes) - n. With `other` a second one, so that both are 128 bits."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers(_OTHER if other else _STEP, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    at = np.arange(len(hashes) - n + 1)
    return mix((total[at + n] - total[at]) * down[at] + np.uint64(n))


def spans(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of hashes[a:b] for each a of starts and b of stops."""
    up, down = _powers(_STEP, len(hashes))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def pieces(batch: pa.RecordBatch, text: int, most: int = CHUNK):
    """Slices of a batch whose texts have about `most` bytes, one row at least."""
    column = batch.column(text)
    size = np.diff(text_bytes(column)[1]).cumsum()
    first, done = 0, 0
    while first < len(size):
        last = max(first + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(first, last - first)
        first, done = last, size[last - 1]
