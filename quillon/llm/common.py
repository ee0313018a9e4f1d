"""What the training-data operators share: word rule, shared folder, planning sizes and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch; with texts of some 100 KB a batch still stays near 25 MB.
BATCH_ROWS = 256


#: Setting of Spark by which the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepared(spark: SparkSession) -> SparkSession:
    """The session with Arrow batches small enough for long texts, and without shuffle files of queries that have ended."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set(CLEANUP, "true")
    return spark


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Within, shuffle files of a query go when it ends."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; bytes.lower and bytes.split touch ASCII only, which is exactly the rule."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; on one machine, one of our own where it is unset.

    On a cluster an unset folder raises ValueError: what the driver's own disk holds, executors don't see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, which the driver's JVM deletes when it ends, even after spark.stop()."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _fs(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives lost executors."""
    return Scratch(df.sparkSession).written(df, name)


class Scratch:
    """Tables of one job in the shared folder. As a context it deletes them at its end, after a failure too; `drop` does so earlier.

    What a job returns must not read them any more: its last table is written by the plain `written`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        for path in self.paths:
            drop_path(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        with cleaning(self.spark):
            df.write.mode("overwrite").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths.add(path)
        table._shared_path = path
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        for path in {getattr(t, "_shared_path", None) for t in tables} & self.paths:
            self.paths.remove(path)
            drop_path(self.spark, path)


#: Numbers (an id each) that a filter may broadcast: some 50 MB in a hash table.
FEW_IDS = 1_000_000


def only(df: DataFrame, ids: DataFrame, key: str, *, but: bool = False) -> DataFrame:
    """Rows of df whose key is among ids (one column, distinct), or with `but` those whose key isn't or is null.

    If there are few ids df doesn't move, else both are joined by a shuffle.
    """
    few = ids.limit(FEW_IDS + 1).count() <= FEW_IDS
    ids = ids.toDF("__only")
    return df.join(F.broadcast(ids) if few else ids, F.col(key).cast(ids.schema[0].dataType) == F.col("__only"), "left_anti" if but else "left_semi")


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's bytes, from file sizes; only sets numbers of partitions and buckets.

    Where Catalyst doesn't know (rows that come from no file) it assumes next to infinity; then rows are counted, at 4 KB each.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < 1 << 50 else df.count() << 12


def buckets_for(df: DataFrame, each: int = 4 << 20, least: int = 64) -> int:
    """How many buckets give some `each` bytes of input to one bucket."""
    return max(least, -(-planned_bytes(df) // each))


def share(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id has no remainder."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(divisor)


def map_batches(df: DataFrame, f: Callable[..., dict], schema: str, *args) -> DataFrame:
    """f(batch as a table's columns by name, *args) -> columns, over Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working():
            for batch in batches:
                if batch.num_rows:
                    columns = f({n: batch.column(i) for i, n in enumerate(batch.schema.names)}, *args)
                    yield pa.RecordBatch.from_arrays([_array(columns[x.name], x.type) for x in kind], schema=kind)

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # not glibc
        return None


def trim() -> None:
    """Gives freed memory back, so that a worker that lives on for other tasks doesn't keep its peak."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


_HELD: dict = {}
#: Seconds that a worker without a task keeps what it holds: Spark keeps idle workers for a minute, and often more than it has cores.
KEEP_S = 2.0


class _State:
    tasks, since, watched = 0, 0.0, 0


def held(key: tuple, make: Callable[[], object]):
    """What make() gave for the key in this process. One thing is held at a time: a worker that turns to another operator lets go of the last one's."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


@contextmanager
def working() -> Iterator[None]:
    """A task's run: afterwards freed memory goes back, and what is held too if no task follows soon."""
    _State.tasks += 1
    try:
        yield
    finally:
        _State.tasks, _State.since = _State.tasks - 1, time.monotonic()
        trim()
        if _HELD and _State.watched != os.getpid():
            _State.watched = os.getpid()
            threading.Thread(target=_let_go, daemon=True).start()


def _let_go() -> None:
    while _State.tasks or time.monotonic() - _State.since < KEEP_S:
        time.sleep(0.5)
    _HELD.clear()
    _State.watched = 0
    trim()


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Offsets 0, l0, l0 + l1, ... of ragged rows."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Memo:
    """Values of strings seen lately, by index into an array; forgets everything beyond `limit` keys."""

    def __init__(self, compute: Callable[[list], object], limit: int = 400_000):
        self.compute, self.limit, self.index, self.parts, self.values = compute, limit, {}, [], None

    def __call__(self, rows: list[list]) -> tuple[object, np.ndarray]:
        """(the values of all keys held, the index of each key of the concatenated rows)."""
        new = set().union(*rows).difference(self.index)
        if new and len(self.index) + len(new) > self.limit:
            self.index, self.values = {}, None
            new = set().union(*rows)
        if new:
            new = list(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
            self.values = self.compute(new) if self.values is None else self.join(self.values, self.compute(new))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, sum(map(len, rows)))
        return self.values, at

    @staticmethod
    def join(old, more):
        return np.concatenate([old, more])
