"""Shared plumbing of the training-data operators: shared scratch tables, packaging, crc32 folds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters of mallopt.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3
_lock = threading.Lock()
_shipped: set[str] = set()
#: With it, Spark deletes the shuffle files of a statement when the statement ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writers: dict[str, list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, if the executors
    run in the driver (local masters, as in tests); else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """A folder of Parquet tables under the shared folder, for one operator.

    table() cuts lineage as checkpoint() does: the rows survive lost executors, and no stage before runs again. At the end of
    a with block all tables go but those made by keep(), which the operator's result reads; these go with the
    application.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tessella-{uuid.uuid4().hex}"
        self.made: dict[str, bool] = {}
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str, codec: str = "zstd", keep: bool = False) -> DataFrame:
        """Write a DataFrame and return one that reads it. The shuffle files that the write needed go when it ends."""
        schema, path = df.schema, f"{self.root}/{len(self.made)}-{name}"
        self.made[path] = keep
        with _cleaning(self.spark):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._tessella_path = path  # type: ignore[attr-defined]
        return out

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return self.table(df, name, keep=True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path, fs = self._at(df._tessella_path)  # type: ignore[attr-defined]
            fs.delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, failed, *_) -> None:
        for path, kept in self.made.items():
            if failed or not kept:
                at, fs = self._at(path)
                fs.delete(at, True)


@contextlib.contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their statement while any writer of this application is inside; then the setting is as before."""
    app = spark.sparkContext.applicationId
    with _lock:
        inside = _writers.setdefault(app, [])
        before = inside[0] if inside else spark.conf.get(_CLEAN, "false")
        inside.append(before)
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            inside.pop()
            if not inside:
                spark.conf.set(_CLEAN, before)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives its memory back.

    Workers live through all stages of an application, so what a task's allocators keep adds up. Arrow allocates from the
    system here, large blocks go back as soon as they are free, and the rest does when the task ends.
    """

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        libc = None
        with contextlib.suppress(OSError, AttributeError):  # another C library
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(M_MMAP_THRESHOLD, 1 << 20)
            libc.mallopt(M_TRIM_THRESHOLD, 1 << 20)
        try:
            yield from run(batches)
        finally:
            gc.collect()
            if libc is not None:
                libc.malloc_trim(0)

    return leaner


def slices(texts: list, most: int) -> Iterator[slice]:
    """Slices of a batch with `most` characters or bytes each at most, one row at least."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and total + len(t) > most:
            yield slice(start, i)
            start, total = i, 0
        total += len(t)
    if texts:
        yield slice(start, len(texts))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    sc: SparkContext = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="tessella-zip-")
        target = os.path.join(folder, "tessella_package.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
            for base, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(base, n)
                        out.write(full, os.path.relpath(full, os.path.dirname(top)))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % F.lit(n)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of these names in any case: an operator's own output columns replace clashing ones."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
