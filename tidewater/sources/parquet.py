"""Parquet tables: checked registration, tuned and atomic writing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import EngineError, classify
from tidewater.plans import report

#: Accepted compressions and Spark's names.
_CODECS = {"zstd": "zstd", "lz4_raw": "lz4_raw", "snappy": "snappy", "none": "none"}


@dataclass
class WriteOptions:
    """How Parquet is written; checked before anything is touched."""

    row_group_rows: int = 262_144
    page_rows: int = 20_000
    compression: str = "zstd"
    dictionary: bool = True
    bloom_columns: list[str] = field(default_factory=list)
    bloom_fpp: float = 0.01

    def spark_options(self) -> dict[str, str]:
        if self.row_group_rows <= 0 or self.page_rows <= 0:
            raise EngineError("unsupported", "rows in a group or page must be over 0")
        if not 0 < self.bloom_fpp < 1:
            raise EngineError("unsupported", "the false positive rate must lie between 0 and 1")
        if self.compression not in _CODECS:
            raise EngineError("unsupported", f"compression {self.compression!r}; one of {', '.join(_CODECS)}")
        out = {
            "compression": _CODECS[self.compression],
            "parquet.block.row.count.limit": str(self.row_group_rows),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.enable.dictionary": str(self.dictionary).lower(),
            "parquet.writer.version": "v2",
        }
        for c in self.bloom_columns:
            out |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.fpp#{c}": str(self.bloom_fpp)}
        return out


def read_checked(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or directory whose footers could be read; a corrupt file is a format error.

    Merging schemas opens the footer of every file, in a Spark job of its own,
    so a broken one is refused before the table has a name.
    """
    try:
        return spark.read.option("mergeSchema", "true").parquet(path)
    except Exception as e:
        raise classify(e) from e


def counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Write a frame in one run; the number of rows that went out."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def write_parquet(df: DataFrame, path: str, options: WriteOptions | None = None) -> int:
    """Write to a staging directory beside ``path`` and rename it there; the number of rows.

    What stood at ``path`` is moved aside once the new files are complete, comes
    back if they cannot be renamed, and goes only when they have their name.
    """
    spark = df.sparkSession
    how = (options or WriteOptions()).spark_options()
    base, mark = path.rstrip("/"), uuid.uuid4().hex
    new = spark._jvm.org.apache.hadoop.fs.Path
    target, staging, aside = new(base), new(f"{base}.staging-{mark}"), new(f"{base}.old-{mark}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = counted(df, lambda out: out.write.options(**how).parquet(staging.toString()))
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise EngineError("io", f"cannot move {path} aside")
    if not fs.rename(staging, target):
        if had:
            fs.rename(aside, target)
        raise EngineError("io", f"cannot rename {staging} to {path}")
    if had:
        fs.delete(aside, True)
    return rows


@dataclass
class ScanSummary:
    """What the scans of a query read."""

    files: int = 0
    bytes: int = 0
    partitions: int = 0
    rows: int = 0
    listing_ms: int = 0
    reading_ms: int = 0


# Spark's names of the counters.
_SCAN = {"files": "numFiles", "bytes": "filesSize", "partitions": "numPartitions", "rows": "numOutputRows", "listing_ms": "metadataTime", "reading_ms": "scanTime"}


def scan_summary(df: DataFrame) -> ScanSummary:
    """Run ``df``, its rows staying on the executors, and sum the counters of its scans.

    Rows are those that pruning by row groups, pages and Bloom filters left.
    """
    out = ScanSummary()
    for node in report.counters(df):
        if "Scan" in node.operator:
            for name, metric in _SCAN.items():
                setattr(out, name, getattr(out, name) + node.metrics.get(metric, 0))
    return out


def rows_scanned(df: DataFrame) -> int:
    """Run ``df`` and say how many rows its scans gave: what pruning left."""
    return scan_summary(df).rows
