"""Arrow IPC files, as a Spark data source and as helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema


class _Batch(InputPartition):
    def __init__(self, path: str, index: int):
        self.path, self.index = path, index


class IpcSource(DataSource):
    """``spark.read.format("arrow_ipc").load(path)``; a partition for each record batch.

    The file is opened by path on every executor, so it must lie on a file
    system that all of them mount.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self):
        with pa.ipc.open_file(self.options["path"]) as f:
            return from_arrow_schema(f.schema)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        with pa.ipc.open_file(self.path) as f:
            return [_Batch(self.path, k) for k in range(f.num_record_batches)]

    def read(self, partition: _Batch) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_file(partition.path) as f:
            yield f.get_batch(partition.index)


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(IpcSource)
    return spark.read.format("arrow_ipc").load(path)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as the bytes of a stream of its own."""
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema) as out:
            out.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch"])


def write_ipc(df: DataFrame, path: str) -> int:
    """Write one file from the driver, which holds a partition's batches at a time; the number of rows.

    The batches are made on the executors and pass through as they are.
    """
    schema, rows = to_arrow_schema(df.schema), 0
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_file(sink, schema) as out:
        for row in df.mapInArrow(_packed, "batch binary").toLocalIterator(prefetchPartitions=True):
            for b in pa.ipc.open_stream(row["batch"]):
                if b.num_rows:
                    out.write_batch(pa.RecordBatch.from_arrays(pa.Table.from_batches([b]).cast(schema).combine_chunks().to_batches()[0].columns, schema=schema))
                    rows += b.num_rows
    return rows
