"""Reassembly of hinted streams: segments and gaps by gaps and islands.

Each record's bytes beyond what came before it are kept (the first to arrive
wins); records that join are one segment.  Stored order is the order of work,
so a record behind a later one only adds what reaches past it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SEQ_SPACE, STREAM


def placed(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Records of stream-oriented streams that have a place and bytes, trimmed: off_start, off_end, data, gap before."""
    known = facts.where("stream_oriented").select(*STREAM, "isn", "first_seq")
    r = records.withColumnRenamed("sender_pid", "pid").join(known, STREAM).where("seq_start is not null and octet_length(payload) > 0")
    origin = F.coalesce(F.pmod(F.col("isn") + 1, F.lit(SEQ_SPACE)), F.col("first_seq"))
    r = r.withColumn("at", F.pmod(F.col("seq_start") - origin, F.lit(SEQ_SPACE))).withColumn("to", F.col("at") + F.octet_length("payload"))
    w = Window.partitionBy(*STREAM).orderBy("block_seq").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("cursor", F.coalesce(F.max("to").over(w), F.lit(0))).where(F.col("to") > F.col("cursor"))
    start = F.greatest("at", "cursor")
    data = F.substring(F.col("payload"), (start - F.col("at") + 1).cast("int"), F.octet_length("payload"))
    return r.select(*STREAM, "block_seq", "ts", start.alias("off_start"), F.col("to").alias("off_end"), data.alias("data"), (F.col("at") > F.col("cursor")).alias("after_gap"), "cursor")


def chunks(records: DataFrame, facts: DataFrame) -> DataFrame:
    """Segments (data, the latest ts) and gaps between them, a leading one included: kind, off_start, off_end, ts, data."""
    p = placed(records, facts)
    w = Window.partitionBy(*STREAM).orderBy("block_seq").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("island", F.sum(F.col("after_gap").cast("int")).over(w))
    whole = p.groupBy(*STREAM, "island").agg(
        F.min("off_start").alias("off_start"), F.max("off_end").alias("off_end"), F.max("ts").alias("ts"), F.expr("listagg(data) within group (order by off_start)").alias("data")
    )
    segments = whole.select(*STREAM, F.lit("segment").alias("kind"), "off_start", "off_end", "ts", "data")
    gaps = p.where("after_gap").select(*STREAM, F.lit("gap").alias("kind"), F.col("cursor").alias("off_start"), F.col("off_start").alias("off_end"), F.lit(None).cast("bigint").alias("ts"), F.lit(None).cast("binary").alias("data"))
    return segments.unionByName(gaps)


def segments(records: DataFrame, facts: DataFrame) -> DataFrame:
    return chunks(records, facts).where("kind = 'segment'")


def reassembled(records: DataFrame, facts: DataFrame) -> DataFrame:
    """data of each whole stream; a stream with a gap fails the job."""
    c = chunks(records, facts).groupBy(*STREAM).agg(
        F.max((F.col("kind") == "gap").cast("int")).alias("gap"), F.expr("listagg(data) within group (order by off_start)").alias("data")
    )
    return c.select(*STREAM, F.when(F.col("gap") == 0, F.col("data")).otherwise(F.raise_error(F.lit("the stream has a gap")).cast("binary")).alias("data"))


def datagrams(ranges: DataFrame) -> DataFrame:
    """One row for each record, empty ones included."""
    return ranges.select(*STREAM, "block_seq", "off_start", "off_end", "ts", F.col("payload").alias("data"))


def off_start(chunked: DataFrame) -> DataFrame:
    """The first offset at which a stream has bytes."""
    return chunked.where("kind = 'segment'").groupBy(*STREAM).agg(F.min("off_start").alias("off_start"))


def input_extent(chunked: DataFrame, ranges: DataFrame, facts: DataFrame) -> DataFrame:
    """Extent of each stream as an input: the end of its last chunk, or of its last record where it has no hints."""
    hinted = chunked.groupBy(*STREAM).agg(F.max("off_end").alias("extent"))
    packets = ranges.join(facts.where("not stream_oriented").select(*STREAM), STREAM, "left_semi").groupBy(*STREAM).agg(F.max_by("off_end", "block_seq").alias("extent"))
    found = hinted.unionByName(packets)
    return facts.select(*STREAM).join(found, STREAM, "left").withColumn("extent", F.coalesce("extent", F.lit(0)))


def cite(source_id, session_id, pid, start, end):
    """A span as a struct column."""
    return F.struct(
        F.lit(source_id).cast("int").alias("source_id") if isinstance(source_id, int) else source_id.cast("int").alias("source_id"),
        session_id.cast("bigint").alias("in_session_id"), pid.cast("int").alias("in_pid"), start.cast("bigint").alias("off_start"), end.cast("bigint").alias("off_end"),
    )


def cited_as(segment: DataFrame, start: int, end: int, source_id: int) -> DataFrame:
    """segment rows with ``span``: the relative bytes [start, end) of each; outside a segment fails the job."""
    size = F.col("off_end") - F.col("off_start")
    ok = (F.lit(start) >= 0) & (F.lit(start) <= F.lit(end)) & (F.lit(end) <= size)
    span = cite(source_id, F.col("session_id"), F.col("pid"), F.col("off_start") + start, F.col("off_start") + end)
    return segment.withColumn("span", F.when(ok, span).otherwise(F.raise_error(F.lit("outside the segment")).cast("struct<source_id:int,in_session_id:bigint,in_pid:int,off_start:bigint,off_end:bigint>")))
