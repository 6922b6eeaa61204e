"""Offset spaces of streams: layers, ranges, extents, units, breaks.

A stream is (path, session_id, pid).  Records name their sender ``sender_pid``;
here it is ``pid`` like everywhere else.  A transport stream with hints has
hole-inclusive offsets, any other positional ones, in which the declared width
of a discontinuity is a term of the sum and takes no range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DECODED, KIND_LABELS, LAYER_LABELS, SEQ_SPACE, STREAM, TRANSPORT


def before(rows: str = "block_seq") -> Window:
    return Window.partitionBy(*STREAM).orderBy(rows).rowsBetween(Window.unboundedPreceding, -1)


def layer_name(layer) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LAYER_LABELS.items() for x in kv])
    return F.coalesce(names[F.col(layer)], F.concat(F.lit("layer "), F.col(layer).cast("string")))


def with_layer(records: DataFrame, decoders: DataFrame) -> DataFrame:
    """records with ``layer``: transport without a decoder, else the decoder's; null for an undeclared one."""
    own = decoders.select("path", "decoder_id", "output_layer").dropDuplicates(["path", "decoder_id"])
    return records.join(own, ["path", "decoder_id"], "left").withColumn("layer", F.when(F.col("decoder_id").isNull(), TRANSPORT).otherwise(F.col("output_layer"))).drop("output_layer")


def stream_facts(participants: DataFrame, records: DataFrame, decoders: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each participant: layers, kinds, hints, spans, origin.

    layer is null where records disagree or a decoder is not declared; a stream
    without records is a captured transport stream.
    """
    kinds = sources.select("path", "source_id", "kind").dropDuplicates(["path", "source_id"])
    r = with_layer(records.withColumnRenamed("sender_pid", "pid"), decoders).join(kinds, ["path", "source_id"], "left")
    facts = r.groupBy(*STREAM).agg(
        F.count("*").alias("record_count"),
        F.sort_array(F.collect_set("layer")).alias("layers"),
        F.sort_array(F.collect_set("kind")).alias("kinds"),
        F.max(F.col("layer").isNull().cast("int")).alias("undeclared_decoder"),
        F.max((F.size("spans") > 0).cast("int")).alias("has_spans"),
        F.max((F.col("seq_start").isNotNull() | F.col("ack").isNotNull()).cast("int")).alias("has_hints"),
        F.min_by("seq_start", F.when(F.col("seq_start").isNotNull(), F.col("block_seq"))).alias("first_seq"),
        F.max(F.col("seq_start").isNotNull().cast("int")).alias("has_seq"),
        F.min_by(F.col("seq_start").isNotNull(), "block_seq").alias("first_has_seq"),
    )
    out = participants.select(*STREAM, "isn", "origin").join(facts, STREAM, "left")
    empty = F.col("record_count").isNull()
    return out.select(
        *STREAM, "isn", "origin", F.coalesce("record_count", F.lit(0)).alias("record_count"), F.coalesce("layers", F.array().cast("array<int>")).alias("layers"), F.coalesce("kinds", F.array().cast("array<int>")).alias("kinds"),
        F.coalesce(F.col("has_spans") > 0, F.lit(False)).alias("has_spans"), F.coalesce(F.col("has_hints") > 0, F.lit(False)).alias("has_hints"), "first_seq",
        F.when(empty, F.lit(TRANSPORT)).when((F.size("layers") == 1) & (F.col("undeclared_decoder") == 0), F.col("layers")[0]).alias("layer"),
        F.when(empty, F.lit(0)).when(F.size("kinds") == 1, F.col("kinds")[0]).alias("kind"),
        (F.col("isn").isNotNull() | F.coalesce("first_has_seq", F.lit(False))).alias("stream_oriented"),
    )


def stream_kind(facts: DataFrame) -> DataFrame:
    """(provenance, layer) of each stream as words; null where its records disagree."""
    kinds = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])
    return facts.select(*STREAM, kinds[F.col("kind")].alias("provenance"), F.when(F.col("layer").isNotNull(), layer_name("layer")).alias("layer"))


def stream_blocks(records: DataFrame, discontinuities: DataFrame) -> DataFrame:
    """Records and breaks of a stream in one table."""
    r = records.withColumnRenamed("sender_pid", "pid").withColumn("kind", F.lit("record")).withColumn("length", F.coalesce(F.octet_length("payload"), F.lit(0)).cast("bigint"))
    d = discontinuities.select("path", "block_seq", "session_id", "pid", "width", F.col("reason").alias("break_reason"), F.lit("break").alias("kind"))
    return r.unionByName(d, allowMissingColumns=True)


def positions(blocks: DataFrame) -> DataFrame:
    """Positional offsets: ``at`` is the sum of lengths and declared widths before each block."""
    return blocks.withColumn("at", F.coalesce(F.sum(F.coalesce("length", "width", F.lit(0))).over(before()), F.lit(0)).cast("bigint"))


def record_ranges(records: DataFrame, discontinuities: DataFrame, facts: DataFrame) -> DataFrame:
    """records (sender as ``pid``) with off_start and off_end in their stream's offset space.

    A stream whose layer is not one that is defined fails the job, as offsets in
    a guessed space would be wrong.
    """
    known = facts.select(*STREAM, "layer", "isn", "first_seq")
    blocks = positions(stream_blocks(records, discontinuities)).join(known, STREAM)
    guard = F.when(F.col("layer").isin(DECODED, TRANSPORT), F.col("layer")).otherwise(F.raise_error(F.lit("the stream's layer is not one that is defined")).cast("int"))
    blocks = blocks.withColumn("layer", guard)
    origin = F.when(F.col("layer") == TRANSPORT, F.coalesce(F.pmod(F.col("isn") + 1, F.lit(SEQ_SPACE)), F.col("first_seq")))
    blocks = blocks.withColumn("origin_seq", origin)
    seq = F.pmod(F.col("seq_start") - F.col("origin_seq"), F.lit(SEQ_SPACE))
    blocks = blocks.withColumn("__end", F.when(F.col("origin_seq").isNotNull() & F.col("seq_start").isNotNull(), seq + F.col("length")))
    last = F.coalesce(F.max("__end").over(before()), F.lit(0))
    hinted = F.col("origin_seq").isNotNull()
    start = F.when(~hinted, F.col("at")).when(F.col("seq_start").isNull(), last).otherwise(seq)
    end = F.when(~hinted, F.col("at") + F.col("length")).when(F.col("seq_start").isNull(), last).otherwise(F.col("__end"))
    ranged = blocks.withColumns({"off_start": start.cast("bigint"), "off_end": end.cast("bigint")}).where("kind = 'record'")
    return ranged.drop("kind", "width", "break_reason", "at", "__end", "isn", "first_seq", "origin_seq")


def stream_extent(ranges: DataFrame, participants: DataFrame) -> DataFrame:
    """extent of each participant's stream: the greatest end, 0 when empty; a break at the end adds nothing."""
    most = ranges.groupBy(*STREAM).agg(F.max("off_end").alias("extent"))
    return participants.select(*STREAM).join(most, STREAM, "left").withColumn("extent", F.coalesce("extent", F.lit(0)))


def break_positions(records: DataFrame, discontinuities: DataFrame) -> DataFrame:
    """off_start and width (0 when not declared) of each break in its stage's own output."""
    at = positions(stream_blocks(records, discontinuities)).where("kind = 'break'")
    return at.select(*STREAM, "block_seq", F.col("at").alias("off_start"), F.coalesce("width", F.lit(0)).cast("bigint").alias("width"))


def units(records: DataFrame, discontinuities: DataFrame, facts: DataFrame) -> DataFrame:
    """Datagrams and breaks in stored order: kind, off_start, off_end, width, reason, ts.

    In a hinted stream records without seq_start are left out, and a break, which
    has no place in a space of sequence numbers, stands at 0.
    """
    known = facts.select(*STREAM, "isn", "first_seq", "stream_oriented")
    blocks = positions(stream_blocks(records, discontinuities)).join(known, STREAM)
    origin = F.coalesce(F.pmod(F.col("isn") + 1, F.lit(SEQ_SPACE)), F.col("first_seq"))
    hinted = F.col("stream_oriented")
    record = F.col("kind") == "record"
    start = F.when(~hinted, F.col("at")).when(~record, F.lit(0)).otherwise(F.pmod(F.col("seq_start") - origin, F.lit(SEQ_SPACE)))
    out = blocks.where(~(hinted & record & F.col("seq_start").isNull())).withColumn("off_start", start.cast("bigint"))
    return out.select(
        *STREAM, "block_seq", "kind", "off_start", F.when(record, F.col("off_start") + F.col("length")).alias("off_end"),
        F.when(~record, F.col("width")).cast("bigint").alias("width"), F.when(~record, F.col("break_reason")).alias("reason"), "ts", "payload",
    )
