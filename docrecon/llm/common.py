"""Shared helpers: scratch tables, bounded slices of Arrow batches and word splitting."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word pattern of all contracts: a run of anything but space and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows of a side that may be broadcast once they have been counted; a larger side meets its rows by a salted join.
BROADCAST_ROWS = 100_000
#: In force while a scratch table is written: shuffle files go at the end of the query, and rows reach Python in small batches.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

#: Scratch tables that still exist: path to (file system, path), which outlive the session that wrote them.
_made: dict[str, tuple] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docrecon-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes as scratch tables do."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    _made[path] = (place.getFileSystem(context._jsc.hadoopConfiguration()), place)
    return path


def materialise(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: the lineage is cut there, so a lost executor costs no recomputation.

    The shuffle files that writing took go at once, and so do the scratch tables of done, which nothing reads any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _settings(spark, _WHILE_WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    discard(*done)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables; a frame that is none, or is gone already, is passed over."""
    for t in tables:
        _delete(getattr(t, "_scratch", None))


def _delete(path: str | None) -> None:
    if path in _made:
        system, place = _made.pop(path)
        system.delete(place, True)


@contextlib.contextmanager
def scratch_scope(*keep: DataFrame):
    """On leaving, all scratch tables made within go, but those appended to the list that this yields."""
    before, kept = set(_made), list(keep)
    try:
        yield kept
    finally:
        stay = before | {getattr(t, "_scratch", None) for t in kept}
        for path in [p for p in _made if p not in stay]:
            _delete(path)


@atexit.register
def _clear() -> None:
    """Deletes what is left when the driver ends, also after its session has stopped."""
    for path in list(_made):
        try:
            _delete(path)
        except Exception as e:  # noqa: BLE001 - the JVM may be gone first
            print(f"scratch table {path} stays: {type(e).__name__}")
            return


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, for tasks that write or read whole files of the shared folder, and the path there."""
    return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)


def read_file(fs: pa.fs.FileSystem, path: str) -> bytes:
    with fs.open_input_stream(path) as f:
        return f.read()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not use yet."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and the n + 1 offsets; a null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (two multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of a slice that is worked on at once (a longer text is a slice alone).
SLICE_BYTES = 4 << 20


def lines(batches: Iterator[pa.RecordBatch], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and fewer where rows are large."""
    for batch in batches:
        size_here = max(1, min(size, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, size_here):
            yield batch.slice(i, size_here)


def word_count(text: str):
    """A Column: the number of words of a text (a column's name, in backticks where it needs them), 0 where it is null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
