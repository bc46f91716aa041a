"""Fluent queries: each verb adds to a lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater import output
from tidewater.functions import predict as _predict
from tidewater.functions import vector
from tidewater.plans import report

if TYPE_CHECKING:
    from tidewater.session import Session


class Frame:
    def __init__(self, session: Session, df: DataFrame):
        self.session, self.df = session, df

    def _with(self, df: DataFrame) -> Frame:
        return Frame(self.session, df)

    def filter(self, condition: Column | str) -> Frame:
        return self._with(self.df.filter(condition))

    def select(self, *columns: str | Column) -> Frame:
        return self._with(self.df.select(*columns))

    def with_column(self, name: str, value: Column) -> Frame:
        return self._with(self.df.withColumn(name, value))

    def alias(self, name: str) -> Frame:
        return self._with(self.df.alias(name))

    def join(self, right: Frame, left_key: str, right_key: str, how: str = "inner") -> Frame:
        """Join on one key each; both key columns stay, and null keys never match."""
        return self._with(self.df.join(right.df, self._key(self.df, left_key) == self._key(right.df, right_key), how))

    @staticmethod
    def _key(df: DataFrame, name: str) -> Column:
        return F.col(name) if "." in name else df[name]

    def aggregate(self, keys: Sequence[str | Column], aggregates: Sequence[Column]) -> Frame:
        """Group by the keys, or all rows if there are none."""
        return self._with(self.df.groupBy(*keys).agg(*aggregates))

    def sort(self, *order: Column | str) -> Frame:
        """Sort; a plain name is ascending with nulls last."""
        return self._with(self.df.orderBy(*[F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]))

    def limit(self, n: int) -> Frame:
        return self._with(self.df.limit(n))

    def union(self, other: Frame) -> Frame:
        return self._with(self.df.unionAll(other.df))

    def distinct(self) -> Frame:
        return self._with(self.df.distinct())

    def vector_distance(self, column: str, query: Sequence[float], metric: str = "l2", name: str = "distance") -> Frame:
        """Add the distance of a vector column from a query vector."""
        return self._with(self.df.withColumn(name, vector.distance(metric, F.col(column), vector.query_vector(query))))

    def nearest(self, column: str, query: Sequence[float], k: int, metric: str = "l2", name: str = "distance", ties: Sequence[str] = ()) -> Frame:
        """The k rows nearest to a query vector: each task keeps k, nothing is sorted as a whole."""
        return self.vector_distance(column, query, metric, name).sort(name, *ties).limit(k)

    def predict(self, path: str, features: str, name: str = "score", activation: str | None = None) -> Frame:
        return self._with(self.df.withColumn(name, _predict.predict(self.session.spark, path, F.col(features), activation)))

    def collect(self) -> pa.Table:
        return self.df.toArrow()

    def explain(self) -> str:
        return report.explain(self.df)

    @property
    def schema(self):
        return self.df.schema

    def show(self, format: str = "table") -> None:
        """Print all rows; a reader that goes away early is no error."""
        output.print_rows(self.df, format)
