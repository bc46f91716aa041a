"""The session: tables, SQL, and what a query did."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.errors import EngineError, classify
from tidewater.frame import Frame
from tidewater.functions import predict
from tidewater.operators.profile import ColumnProfile, profile_frame
from tidewater.plans import dialect, report, typed
from tidewater.sources import parquet

log = logging.getLogger("tidewater")

#: What the dialect needs of Spark: standard errors, and names in double quotes.
_SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Settings that the caller may have changed on the session given.
_INHERITED = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.parquet.filterPushdown")


@dataclass
class SessionOptions:
    """``batch_size`` is the rows of a columnar batch; it never changes results.

    Without ``pruning`` no filter reaches the Parquet scan: slower, but files whose
    statistics leave NaN out then keep the NaN rows that a filter matches.
    With ``strict`` sums of bigints wrap instead of failing, and ``min`` and
    ``max`` of doubles follow the total order (-0.0 before 0.0, NaN last).
    """

    batch_size: int | None = None
    pruning: bool = True
    strict: bool = False

    def check(self) -> None:
        if self.batch_size is not None and self.batch_size <= 0:
            raise EngineError("plan", "batch size must be over 0")


@dataclass
class Dashboard:
    """What one query did."""

    title: str
    plan: list[report.Node]
    counters: list[report.Counter]
    profiles: dict[str, list[ColumnProfile]]


class Session:
    """Queries over registered tables, on any Spark master."""

    def __init__(self, spark: SparkSession, options: SessionOptions | None = None):
        options = options or SessionOptions()
        options.check()
        # settings and temporary functions of its own, so the caller's stay as they are
        self.spark = spark.newSession()
        for k, v in _SETTINGS.items():
            self.spark.conf.set(k, v)
        for k in _INHERITED:
            if (v := spark.conf.get(k, None)) is not None:
                self.spark.conf.set(k, v)
        if not options.pruning:
            self.spark.conf.set("spark.sql.parquet.filterPushdown", "false")
        if options.batch_size:
            self.spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(options.batch_size))
            self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(options.batch_size))
        self.tables: dict[str, str] = {}
        self.strict = options.strict

    @classmethod
    def local(cls, cores: str = "*", options: SessionOptions | None = None, **config: str) -> Session:
        (options or SessionOptions()).check()
        return cls(SparkSession.builder.master(f"local[{cores}]").config(map=config).getOrCreate(), options)

    @classmethod
    def connect(cls, master: str, options: SessionOptions | None = None, **config: str) -> Session:
        """A session on a cluster, by its master URL."""
        (options or SessionOptions()).check()
        return cls(SparkSession.builder.master(master).config(map=config).getOrCreate(), options)

    # tables

    def register_parquet(self, name: str, path: str) -> None:
        """Name a Parquet file or directory; if a footer can't be read it is refused and not named."""
        self._name(name, parquet.read_checked(self.spark, path))
        self.tables[dialect.name_of(name)] = path

    def register_frame(self, name: str, df: DataFrame) -> None:
        self._name(name, df)

    def register_arrow(self, name: str, data: pa.Table | pa.RecordBatch) -> None:
        """Name an Arrow table held by the driver."""
        t = data if isinstance(data, pa.Table) else pa.Table.from_batches([data])
        self._name(name, self.spark.createDataFrame(t))

    def _name(self, name: str, df: DataFrame) -> None:
        name = dialect.name_of(name)

        def put() -> None:
            mine = df
            if df.sparkSession is not self.spark:
                # views belong to a session; a global one carries the plan over
                bridge = f"tidewater_{uuid.uuid4().hex}"
                df.createGlobalTempView(bridge)
                mine = self.spark.table(f"global_temp.{bridge}")
            mine.createOrReplaceTempView(name if name.isidentifier() else dialect.quoted(name))

        self._try(put)

    def table(self, name: str) -> Frame:
        return Frame(self, self._try(lambda: self.spark.table(dialect.quoted(dialect.name_of(name)))))

    def read_parquet(self, path: str) -> Frame:
        return Frame(self, self._try(lambda: self.spark.read.parquet(path)))

    # queries

    def sql(self, query: str) -> DataFrame:
        """A statement's frame; nothing runs until it is asked for rows, except COPY and CREATE TABLE."""
        return self._try(lambda: self._sql(query))

    def sql_frame(self, query: str) -> Frame:
        return Frame(self, self.sql(query))

    def _sql(self, query: str) -> DataFrame:
        if copy := dialect.copy_statement(query):
            df = self._sql(copy.query)
            rows = parquet.write_parquet(df, copy.path) if copy.format == "parquet" else self._save(df, copy)
            return self.spark.range(1).select(F.lit(rows).cast("bigint").alias("count"))
        if external := dialect.external_statement(query):
            name, kind, path = external
            if kind == "parquet":
                self.register_parquet(f'"{name}"', path)
            else:
                self._name(f'"{name}"', self.spark.read.format(kind).options(header="true", inferSchema="true").load(path))
            return self.spark.createDataFrame([], "name string")
        if create := dialect.create_statement(query):
            self._name(f'"{create[0]}"', self._snapshot(self._sql(create[1])))
            return self.spark.createDataFrame([], "name string")
        query, models = dialect.predict_calls(query)
        for name, path, activation in models:
            self.spark.udf.register(name, predict.scorer(self.spark, path, activation))
        text = self._text(query, steps=not self.strict)
        if "__group0" in text:
            ranks = self._text(query, steps=False)
            # sums of sums may be of a wider type
            if [f.dataType for f in self.spark.sql(text).schema] != [f.dataType for f in self.spark.sql(ranks).schema]:
                text = ranks
        return self.spark.sql(text)

    def _text(self, query: str, steps: bool) -> str:
        return typed.by_type(self.spark, dialect.to_spark(query, steps), self.strict)

    def _save(self, df: DataFrame, copy: dialect.Copy) -> int:
        return parquet.counted(df, lambda out: out.write.mode("overwrite").format(copy.format).option("header", "true").save(copy.path))

    @staticmethod
    def _snapshot(df: DataFrame) -> DataFrame:
        """The rows as they are now: in the folder of checkpoints where the cluster names one, else in the executors' storage."""
        if df.sparkSession.sparkContext.getCheckpointDir():
            return df.checkpoint(eager=True)
        held = df.persist()
        held.count()
        return held

    def collect(self, query: str) -> pa.Table:
        """Run a query to an Arrow table on the driver; one log line says what it took."""
        began = time.monotonic()
        df = self.sql(query)
        out = self._try(df.toArrow)
        plan = report.nodes(df)
        mode = "embedded" if self.spark.sparkContext.master.startswith("local") else "cluster"
        fitting = sum(n.tag is not None for n in plan)
        log.info("query finished mode=%s rows=%d batches=%d operators=%d fitting=%d elapsed_ms=%.1f", mode, out.num_rows, len(out.to_batches()), len(plan), fitting, 1000 * (time.monotonic() - began))
        return out

    def explain(self, query: str) -> str:
        """The physical plan, and which operators fit the vectorised grammar or why not."""
        return report.explain(self.sql(query))

    def profile(self, table: str) -> list[ColumnProfile]:
        return profile_frame(self.table(table).df)

    def dashboard(self, query: str, tables: Sequence[str] = ()) -> Dashboard:
        """Run a query and give its plan's tags, each operator's counters and profiles of tables."""
        df = self.sql(query)
        return Dashboard(query, report.nodes(df), report.counters(df), {t: self.profile(t) for t in tables})

    @staticmethod
    def _try(run):
        try:
            return run()
        except EngineError:
            raise
        except Exception as e:
            raise classify(e) from e
