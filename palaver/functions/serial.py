"""Serial arithmetic on unsigned 32-bit numbers, which has no total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEQ_SPACE

HALF = SEQ_SPACE // 2


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def seq_lt(a, b) -> Column:
    """a is before b; numbers half the space apart are before each other."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return (a != b) & (F.pmod(a - b, F.lit(SEQ_SPACE)) >= HALF)


def seq_leq(a, b) -> Column:
    return (_c(a) == _c(b)) | seq_lt(a, b)


def seq_geq(a, b) -> Column:
    return seq_leq(b, a)


def record_end(seq_start, length) -> Column:
    return F.pmod(_c(seq_start).cast("bigint") + _c(length), F.lit(SEQ_SPACE))


def distance(a, b) -> Column:
    """The signed step from b to a, the shorter way round."""
    return F.pmod(_c(a).cast("bigint") - _c(b) + HALF, F.lit(SEQ_SPACE)) - HALF


def unwrapped(df: DataFrame, value: str, keys: list[str], order: list[str], out: str) -> DataFrame:
    """df with ``out``: value on a line without wrap-around, as the sum of steps; null where value is null."""
    own = Window.partitionBy(*keys).orderBy(*order)
    last = F.last(value, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col(value).isNull(), 0).when(F.col("__last").isNull(), F.col(value)).otherwise(distance(value, "__last"))
    total = F.sum("__step").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("__last", last)
        .withColumn("__step", step)
        .withColumn(out, F.when(F.col(value).isNotNull(), total))
        .drop("__last", "__step")
    )
