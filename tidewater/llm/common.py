"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; a document may be long, so batches hold few of them.
ARROW_ROWS = 1000

#: Where a local session without spark.checkpoint.dir keeps the name of its folder.
_OWN_DIR = "tidewater.shared.dir"

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may go without the setting; its session then gets a
    temporary folder of its own. Elsewhere the missing setting is an error,
    since a machine-local folder would be invisible to the other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    # spark.checkpoint.dir itself can't be set on a session that runs
    if not (own := spark.conf.get(_OWN_DIR, None)):
        own = tempfile.mkdtemp(prefix="tidewater-shared-")
        spark.conf.set(_OWN_DIR, own)
    return own


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    path = f"{shared_dir(spark).rstrip('/')}/tidewater/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(run: Callable) -> Callable:
    """A function of Arrow batches that gives its memory back when a task ends, as Python workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def release() -> None:
    """Return what is free to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_KEPT: dict = {}


def kept(key, make: Callable):
    """What ``make`` gives, kept in this Python worker for later tasks until another key is asked for.

    Workers outlive stages, so what one operator builds must not stay beside
    what the next one needs: there is room for one thing only.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to ``ARROW_ROWS`` rows, so that long texts fit a Python worker."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(col):
    """Lower-case A-Z only, leaving every other character (native)."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, ASCII_UPPER, ASCII_LOWER))
