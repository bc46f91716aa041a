"""Vector distances as column expressions: no Python, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metrics by name.
METRICS = ("l2", "cosine")


def query_vector(values: Sequence[float]) -> Column:
    """A literal vector; an empty one is refused."""
    if not len(values):
        raise ValueError("query vector must not be empty")
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def _sum(a: Column, b: Column, term, kind: str) -> Column:
    return F.aggregate(F.zip_with(a.cast(f"array<{kind}>"), b.cast(f"array<{kind}>"), term), F.lit(0).cast(kind), lambda s, x: s + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    """Null for a null vector; an error where the widths differ."""
    message = F.concat(F.lit("vector widths differ: "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) != F.size(b), F.raise_error(message)).otherwise(value)


def l2_distance(a: Column, b: Column, kind: str = "float") -> Column:
    """Euclidean distance; null for a null vector or element. ``kind`` is the arithmetic, float or double."""
    return _checked(a, b, F.sqrt(_sum(a, b, lambda x, y: (x - y) * (x - y), kind))).cast(kind)


def cosine_distance(a: Column, b: Column, kind: str = "float") -> Column:
    """1 - cosine; NaN if a vector has no length, null for a null vector or element."""
    dot = _sum(a, b, lambda x, y: x * y, kind)
    norms = F.sqrt(_sum(a, a, lambda x, y: x * y, kind)) * F.sqrt(_sum(b, b, lambda x, y: x * y, kind))
    value = F.when(norms == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot / norms)
    return _checked(a, b, value).cast(kind)


def distance(metric: str, a: Column, b: Column, kind: str = "float") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    return (l2_distance if metric == "l2" else cosine_distance)(a, b, kind)


_SUM = "aggregate(zip_with({a}, {b}, (x, y) -> {term}), CAST(0 AS FLOAT), (s, x) -> CAST(s + x AS FLOAT))"
_BODY = """CASE WHEN a IS NULL OR b IS NULL THEN CAST(NULL AS FLOAT)
 WHEN size(a) <> size(b) THEN CAST(raise_error(concat('vector widths differ: ', size(a), ' and ', size(b))) AS FLOAT)
 ELSE {value} END"""


def _bodies() -> dict[str, str]:
    l2 = f"CAST(sqrt({_SUM.format(a='a', b='b', term='(x - y) * (x - y)')}) AS FLOAT)"
    dot, aa, bb = (_SUM.format(a=p, b=q, term="x * y") for p, q in (("a", "b"), ("a", "a"), ("b", "b")))
    norms = f"(sqrt({aa}) * sqrt({bb}))"
    cosine = f"CASE WHEN {norms} = 0 THEN CAST('NaN' AS FLOAT) ELSE CAST(1 - {dot} / {norms} AS FLOAT) END"
    return {"l2_distance": _BODY.format(value=l2), "cosine_distance": _BODY.format(value=cosine)}


#: The distances as SQL expressions of a and b, for statements.
SQL_BODIES = _bodies()
