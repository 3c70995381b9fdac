"""Helpers that the corpus operators share: tables, checkpoints and views of text as bytes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 18

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; where it names none, a local master, as in tests, gets one of its own."""
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wardlight-checkpoints-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and reads it from there: later steps never recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hint_cleaning(spark: SparkSession) -> None:
    """Lets Spark's cleaner see that shuffles behind a checkpoint are garbage; it acts on the driver's collections only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_fold(column: str, folds: int):
    """crc32 of the id as text, modulo folds; null ids fall in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that what is made of a part can go before the next is made."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def window_hashes(codes: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """Hashes of every window of each width over 64-bit codes, by doubling: h(2w) joins h(w) and its right neighbour.

    The hash of a window depends on its codes alone. Array of width w has len(codes) - w + 1 entries.
    """
    out: dict[int, np.ndarray] = {}
    powers = {1: codes}
    w = 1
    while 2 * w <= max(widths):
        h = powers[w]
        k = len(h) - w
        powers[2 * w] = _join(h[: max(k, 0)], h[w:]) if k > 0 else np.zeros(0, U64)
        w *= 2
    for width in widths:
        n = len(codes) - width + 1
        if n <= 0:
            out[width] = np.zeros(0, U64)
            continue
        at, got = 0, None
        for p in sorted(powers, reverse=True):
            if width - at >= p:
                part = powers[p][at : at + n]
                got = part if got is None else _join(got, part)
                at += p
                if width - at >= p:  # a width below twice its largest power never needs it twice
                    raise AssertionError
        out[width] = got
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(0x9E3779B97F4A7C15) + b
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


#: Rows of texts that Spark sends to Python together at most; its default of 10,000 can be a hundred MB, several times over.
TEXTS_TOGETHER = 2000


def send_fewer_texts(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to TEXTS_TOGETHER if it is larger (or unlimited)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXTS_TOGETHER:
        spark.conf.set(key, str(TEXTS_TOGETHER))


Batches = Iterator[pa.RecordBatch]


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run; when it ends, its worker gives back the memory that Arrow and the C library hold for later. Workers serve many tasks."""

    def own(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return own


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file from the driver, on any file system that Spark can write; one that is there is replaced."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


class Tables:
    """Parquet tables in the shared checkpoint folder, for intermediate results that later steps read more than once."""

    def __init__(self, spark: SparkSession):
        import uuid

        self.spark, self.root, self.n = spark, f"{checkpoint_dir(spark)}/wardlight-{uuid.uuid4().hex}", 0
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """Writes df as a table and reads it back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        got = self.spark.read.schema(df.schema).parquet(path)
        got.wardlight_path = path
        self.kept.append(got)
        return got

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Deletes what only led to these tables."""
        for df in self.kept:
            if not any(df is t for t in tables):
                self.drop(df)
        self.kept = list(tables)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of keep() that nothing reads any more."""
        if path := getattr(df, "wardlight_path", None):
            self.delete(path)

    def delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
