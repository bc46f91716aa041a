"""Column profiles in one aggregation per table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Quantiles that a profile has, by name.
QUANTILES = {"p25": 0.25, "p50": 0.5, "p99": 0.99}
#: Relative error of the quantiles is one in this many.
ACCURACY = 10_000


@dataclass
class ColumnProfile:
    name: str
    data_type: str
    min: str
    max: str
    null_count: int
    p25: str
    p50: str
    p99: str


def _ordered(kind: T.DataType) -> bool:
    """Whether values of the type can be compared, those within it too."""
    if isinstance(kind, T.ArrayType):
        return _ordered(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def _summary(f: T.StructField) -> Column:
    """A column's figures as one struct: texts by name, null where the type has no such figure."""
    column = F.col("`" + f.name.replace("`", "``") + "`")
    none = F.lit(None).cast("string")
    low, high = (F.min(column).cast("string"), F.max(column).cast("string")) if _ordered(f.dataType) else (none, none)
    cuts = {q: none for q in QUANTILES}
    if isinstance(f.dataType, T.NumericType):
        several = F.percentile_approx(column.cast("double"), list(QUANTILES.values()), ACCURACY)
        cuts = {q: several[k].cast("string") for k, q in enumerate(QUANTILES)}
    return F.struct(F.count_if(column.isNull()).alias("null_count"), low.alias("min"), high.alias("max"), *[c.alias(q) for q, c in cuts.items()])


def profile_frame(df: DataFrame) -> list[ColumnProfile]:
    """Null counts of all columns, least and greatest where the type has an order, quantiles of numbers."""
    if not df.columns:
        return []
    row = df.agg(*[_summary(f).alias(f"c{k}") for k, f in enumerate(df.schema.fields)]).first()
    out = []
    for f, found in zip(df.schema.fields, row, strict=True):
        texts = {c: found[c] or "" for c in ("min", "max", *QUANTILES)}
        out.append(ColumnProfile(f.name, f.dataType.simpleString(), null_count=found["null_count"], **texts))
    return out


def profile_table(df: DataFrame) -> DataFrame:
    """The same as a frame, a row for each column."""
    rows = [(p.name, p.data_type, p.min, p.max, p.null_count, p.p25, p.p50, p.p99) for p in profile_frame(df)]
    return df.sparkSession.createDataFrame(rows, "name string, data_type string, min string, max string, null_count bigint, p25 string, p50 string, p99 string")
