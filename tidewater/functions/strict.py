"""Edge semantics that Spark's own functions leave open: total order of floats, wrapping sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_order_key(value: Column) -> Column:
    """A bigint that orders doubles totally: -NaN, -inf, ..., -0.0, 0.0, ..., inf, NaN.

    Reads the raw bits by reflection, so it is for strict comparisons only.
    """
    bits = F.call_function("java_method", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), value.cast("double")).cast("bigint")
    # a negative number's magnitude bits are flipped
    flip = F.shiftrightunsigned(F.shiftright(bits, 63), 1)
    return F.when(value.isNotNull(), bits.bitwiseXOR(flip))


#: The column that ``with_total_order`` adds.
ORDER = "__total_order"


def with_total_order(df: DataFrame, column: str) -> DataFrame:
    """``df`` with the key of a column, which ``total_min`` and ``total_max`` need in an aggregation."""
    return df.withColumn(ORDER, total_order_key(F.col(column)))


def total_min(column: str) -> Column:
    return F.min_by(column, ORDER)


def total_max(column: str) -> Column:
    return F.max_by(column, ORDER)


def total_compare(value: Column, op: str, literal: float) -> Column:
    """``value op literal`` in total order, -0.0 read as 0.0; op is one of = < <= > >=."""
    plain = lambda x: F.when(x == 0.0, F.lit(0.0)).otherwise(x)
    a, b = total_order_key(plain(value)), total_order_key(plain(F.lit(literal)))
    return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def wrapping_sum(value: Column) -> Column:
    """The sum of bigints modulo 2**64, as a bigint; null for no value."""
    wide = F.sum(value.cast("decimal(38,0)"))
    low, size = F.expr("CAST('9223372036854775808' AS DECIMAL(38,0))"), F.expr("CAST('18446744073709551616' AS DECIMAL(38,0))")
    return (F.pmod(wide + low, size) - low).cast("bigint")
