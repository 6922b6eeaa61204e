"""Half-open integer intervals, keyed: complement, coalescing, intersection.

One window by key and start does each; the shuffle on the keys is the only one,
and intervals of different keys never meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reach(df: DataFrame, keys: list[str], start: str = "off_start", end: str = "off_end") -> DataFrame:
    """df with ``reach``: the greatest end of the intervals before, 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("reach", F.coalesce(F.max(end).over(w), F.lit(0)))


def coalesce(df: DataFrame, keys: list[str], start: str = "off_start", end: str = "off_end") -> DataFrame:
    """Unions of intervals that overlap or touch; empty ones go."""
    full = df.where(F.col(start) < F.col(end))
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = full.withColumn("__new", F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0))
    island = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def complement(df: DataFrame, extents: DataFrame, keys: list[str], start: str = "off_start", end: str = "off_end") -> DataFrame:
    """The parts of [0, extent) that no interval covers; extents has the keys and ``extent``.  Empty intervals part nothing."""
    tail = extents.select(*keys, F.col("extent").alias(start), F.col("extent").alias(end), F.col("extent").alias("__extent"))
    known = df.join(extents.select(*keys, F.col("extent").alias("__extent")), keys).where((F.col(start) < F.col("__extent")) & (F.col(start) < F.col(end)))
    both = known.select(*keys, start, end, "__extent").unionByName(tail)
    gaps = reach(both, keys, start, end).where(F.col(start) > F.col("reach"))
    return gaps.select(*keys, F.col("reach").alias(start), F.least(start, "__extent").alias(end)).where(F.col(start) < F.col(end))


def overlay(a: DataFrame, b: DataFrame, keys: list[str], start: str = "off_start", end: str = "off_end") -> DataFrame:
    """Maximal stretches that either covers, with in_a and in_b.

    A sweep instead of a range join: over the ends of both in order, how many of
    either are open.  Work grows with the intervals, not with pairs, and overlaps
    inside a side count once.  One shuffle on the keys serves all steps.
    """
    edges = None
    for side, (x, y) in ((a, (1, 0)), (b, (0, 1))):
        both = F.array(*[F.struct(at.alias("at"), F.lit(x * sign).alias("da"), F.lit(y * sign).alias("db")) for at, sign in ((F.col(start), 1), (F.col(end), -1))])
        one = side.where(F.col(start) < F.col(end)).select(*keys, F.inline(both))
        edges = one if edges is None else edges.unionByName(one)
    w = Window.partitionBy(*keys).orderBy("at")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    # of rows at one place all but the last make an empty stretch
    open_ = edges.select(*keys, "at", F.lead("at").over(w).alias("to"), (F.sum("da").over(run) > 0).alias("in_a"), (F.sum("db").over(run) > 0).alias("in_b"))
    open_ = open_.where("at < to and (in_a or in_b)")
    same = (F.lag("to").over(w) == F.col("at")) & (F.lag("in_a").over(w) == F.col("in_a")) & (F.lag("in_b").over(w) == F.col("in_b"))
    island = open_.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(run))
    out = island.groupBy(*keys, "__island").agg(F.min("at").alias(start), F.max("to").alias(end), F.first("in_a").alias("in_a"), F.first("in_b").alias("in_b"))
    return out.drop("__island")


def intersect(a: DataFrame, b: DataFrame, keys: list[str], start: str = "off_start", end: str = "off_end") -> DataFrame:
    """The parts that both cover, each once."""
    return overlay(a, b, keys, start, end).where("in_a and in_b").select(*keys, start, end)


def subtract(a: DataFrame, b: DataFrame, keys: list[str], start: str = "off_start", end: str = "off_end") -> DataFrame:
    """The parts of a that b does not cover."""
    return overlay(a, b, keys, start, end).where("in_a and not in_b").select(*keys, start, end)


def bin_width(*sides: tuple[DataFrame, str, str]) -> int:
    """A power of two about as wide as the ranges of the side with longer ones are on the mean."""
    means = [df.agg(F.avg(F.col(end) - F.col(start))).first()[0] or 1 for df, start, end in sides]
    return 1 << max(0, math.ceil(math.log2(max(1.0, *map(float, means)))))


def in_bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """df with a row for each bin that its range meets, as ``__bin``; an empty range lies in the bin of its place."""
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end) - 1) / width))))


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], a_range: tuple[str, str], b_range: tuple[str, str], *, also: Column | None = None, width: int | None = None) -> DataFrame:
    """Pairs of rows of a and b with equal keys whose ranges overlap (or that ``also`` holds for); other names must differ.

    Ranges are put in bins and meet by key and bin, so a long key does not bring
    all pairs of its rows together.  A pair is given in the bin where the later
    of both begins.  With ``width`` b is in bins of that width already.
    """
    (a0, a1), (b0, b1) = a_range, b_range
    if width is None:
        width = bin_width((a, a0, a1), (b, b0, b1))
        b = in_bins(b, b0, b1, width)
    both = in_bins(a, a0, a1, width).join(b, [*keys, "__bin"])
    meet = (F.col(a0) < F.col(b1)) & (F.col(b0) < F.col(a1))
    meet = meet | also if also is not None else meet
    return both.where(meet & (F.col("__bin") == F.floor(F.greatest(F.col(a0), F.col(b0)) / width))).drop("__bin")
