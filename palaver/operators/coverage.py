"""Coverage of input streams by spans and undecoded ranges, as findings.

An input stream is (path, source_id, in_session_id, in_pid): the ids are those
of the file that the source names.  Findings that compare ranges are made on
coalesced intervals, so overlapping citations report a stretch once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import CAPTURE, FILE_INPUT, STREAM
from . import intervals

INPUT = ["path", "source_id", "in_session_id", "in_pid"]
#: The pair's input stream, when a file is held against the file that it cites.
RAW = ["in_session_id", "in_pid"]


def spans(records: DataFrame) -> DataFrame:
    """One row for each span of a record that is not empty, with the record's own stream."""
    s = records.select("path", "block_seq", "session_id", "sender_pid", F.inline("spans"))
    return s.select("path", "block_seq", "session_id", "sender_pid", "source_id", *[F.col(c).cast("bigint").alias(c) for c in ("in_session_id", "in_pid", "off_start", "off_end")]).where("off_start < off_end")


def ledger(records: DataFrame, undecoded: DataFrame, sources: DataFrame) -> DataFrame:
    """Covered ranges of each input stream; those undecoded in a capture do not count."""
    kinds = sources.select("path", "source_id", F.col("kind").alias("__kind")).dropDuplicates(["path", "source_id"])
    u = undecoded.join(kinds, ["path", "source_id"], "left").where(f"(__kind is null or __kind <> {CAPTURE}) and off_start < off_end")
    cited = spans(records).select(*INPUT, "off_start", "off_end", F.lit(True).alias("cited"))
    return cited.unionByName(u.select(*INPUT, "off_start", "off_end", F.lit(False).alias("cited")))


def declared(session_ends: DataFrame) -> DataFrame:
    """Extents that session ends declare: the input stream, the session that declares, extent; the last of a session counts."""
    e = session_ends.select("path", "block_seq", F.col("session_id").alias("by_session"), F.posexplode("extents").alias("at", "e")).select("path", "block_seq", "by_session", "at", "e.*")
    return e.groupBy(*INPUT, "by_session").agg(F.max_by("extent", F.struct("block_seq", "at")).cast("bigint").alias("extent"))


def _finding(category: str, offset: Column, message: Column) -> list[Column]:
    return [F.lit(category).alias("category"), offset.cast("bigint").alias("offset"), message.alias("message")]


def _range(start: str, end: str) -> Column:
    return F.format_string("[%d, %d)", F.col(start).cast("bigint"), F.col(end).cast("bigint"))


def _said(category: str, offset: Column, message: Column) -> Column:
    return F.struct(*_finding(category, offset, message))


def _told(rows: DataFrame, keys: list[str], findings: list[tuple[Column, Column]]) -> DataFrame:
    """One row for each finding whose condition holds; a row may have several."""
    said = F.filter(F.array(*[F.when(holds, finding) for holds, finding in findings]), lambda x: x.isNotNull())
    return rows.select(*keys, F.inline(said))


def _gap(start: Column, end: Column) -> Column:
    what = F.concat(F.format_string("[%d, %d)", start.cast("bigint"), end.cast("bigint")), F.lit(" is neither cited nor undecoded"))
    return _said("coverage-gap", start, what)


def check_extents(records: DataFrame, undecoded: DataFrame, sources: DataFrame, session_ends: DataFrame) -> DataFrame:
    """What a file says of its own coverage: disagreeing extents, interior gaps of cited streams, extents beyond or below the reach.

    Covered ranges and declared extents of an input stream come together once, in
    order of place, and one pass over them tells all.
    """
    covered = ledger(records, undecoded, sources)
    none = F.lit(None).cast("bigint")
    rows = covered.select(*INPUT, "off_start", "off_end", "cited", none.alias("extent"))
    rows = rows.unionByName(declared(session_ends).select(*INPUT, none.alias("off_start"), none.alias("off_end"), F.lit(None).cast("boolean").alias("cited"), "extent"))
    order = Window.partitionBy(*INPUT).orderBy("off_start", "off_end")
    whole = Window.partitionBy(*INPUT)
    seen = rows.select(
        *INPUT, "off_start",
        F.coalesce(F.max("off_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("so_far"),
        F.row_number().over(order).alias("nth"),
        F.coalesce(F.max("off_end").over(whole), F.lit(0)).alias("reach"),
        F.coalesce(F.max("cited").over(whole), F.lit(False)).alias("cited"),
        F.min("extent").over(whole).alias("extent"), F.max("extent").over(whole).alias("most"),
    )
    agreed, first = ~F.coalesce(F.col("extent") != F.col("most"), F.lit(False)), F.col("nth") == 1
    return _told(
        seen,
        INPUT,
        [
            (first & ~agreed, _said("extents-disagree", F.lit(0), F.lit("sessions declare different lengths for one input stream"))),
            (agreed & F.col("cited") & (F.col("off_start") > F.col("so_far")), _gap(F.col("so_far"), F.col("off_start"))),
            (first & agreed & (F.col("extent") > F.col("reach")), _said("extent-exceeds-coverage", F.col("reach"), F.format_string("extent %d is declared, [0, %d) is accounted for", "extent", "reach"))),
            (first & agreed & (F.col("extent") < F.col("reach")), _said("extent-below-coverage", F.col("extent"), F.format_string("extent %d is declared, citations reach %d", "extent", "reach"))),
        ],
    )


def input_source(sources: DataFrame, raw_digest: str | None = None) -> DataFrame:
    """(path, source_id) of the one input file that each file cites; with several, the one of this digest, else the job fails."""
    inputs = sources.where(F.col("kind") == FILE_INPUT)
    match = F.col("digest") == raw_digest if raw_digest else F.lit(False)
    one = inputs.groupBy("path").agg(F.count("*").alias("n"), F.min("source_id").alias("only"), F.sum(match.cast("int")).alias("same"), F.min(F.when(match, F.col("source_id"))).alias("named"))
    pick = F.when(F.col("n") == 1, F.col("only")).when(F.col("same") == 1, F.col("named")).otherwise(F.raise_error(F.lit("no single input file can be told")).cast("int"))
    return one.select("path", pick.alias("source_id"))


def check_coverage(records: DataFrame, undecoded: DataFrame, session_ends: DataFrame, source: DataFrame, raw_extents: DataFrame) -> DataFrame:
    """A file against its input: overlap, gap and excess by the measured extents, and declared extents that differ.

    source: (path, source_id) of the input; raw_extents: its streams (session_id,
    pid, extent).
    """
    key = ["path", *RAW]
    number = lambda *c: [F.col(x).cast("bigint").alias(x) for x in c]
    cited = spans(records).join(source, ["path", "source_id"], "left_semi").select(*key, "off_start", "off_end")
    marked = undecoded.join(source, ["path", "source_id"], "left_semi").where("off_start < off_end").select("path", *number(*RAW, "off_start", "off_end"))
    # the input's streams stand for each file that cites it: a row with the files' paths goes to them
    citing = source.agg(F.collect_set("path").alias("paths"))
    raw = raw_extents.select(F.col("session_id").cast("bigint").alias("in_session_id"), F.col("pid").cast("bigint").alias("in_pid"), F.col("extent").cast("bigint").alias("known"))
    streams = raw.crossJoin(F.broadcast(citing)).select(F.explode("paths").alias("path"), *RAW, "known")
    told = declared(session_ends).join(source, ["path", "source_id"], "left_semi").select("path", *number(*RAW), F.col("extent").alias("said")).distinct()
    rows = cited.unionByName(marked).unionByName(streams, allowMissingColumns=True).unionByName(told, allowMissingColumns=True)
    order = Window.partitionBy(*key).orderBy("off_start", "off_end")
    whole = Window.partitionBy(*key)
    seen = rows.select(
        *key, "off_start", "off_end", "said",
        F.coalesce(F.max("off_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("so_far"),
        F.row_number().over(order).alias("nth"),
        F.coalesce(F.max("off_end").over(whole), F.lit(0)).alias("reach"),
        F.max("known").over(whole).alias("known"),
    ).withColumn("extent", F.coalesce("known", F.lit(0)))
    alone = _told(
        seen,
        key,
        [
            ((F.col("off_start") > F.col("so_far")) & (F.col("so_far") < F.col("extent")), _gap(F.col("so_far"), F.least("off_start", "extent"))),
            ((F.col("nth") == 1) & (F.col("reach") < F.col("extent")), _gap(F.col("reach"), F.col("extent"))),
            (F.col("off_end") > F.col("extent"), _said("coverage-excess", F.col("off_start"), F.concat(_range("off_start", "off_end"), F.lit(" reaches past the stream")))),
            (F.col("said") != F.col("known"), _said("extent-mismatch", F.col("said"), F.format_string("extent %d is declared, the input has %d", "said", "known"))),
        ],
    )
    overlap = intervals.intersect(cited, marked, key)
    return alone.unionByName(overlap.select(*key, *_finding("coverage-overlap", F.col("off_start"), F.concat(_range("off_start", "off_end"), F.lit(" is both cited and undecoded")))))


def check_splice(records: DataFrame, source: DataFrame, raw_breaks: DataFrame) -> DataFrame:
    """Records whose citations of an input stream have bytes on both sides of one of its breaks.

    raw_breaks: (session_id, pid, off_start, width) of the input.
    """
    key = ["path", "block_seq", "session_id", "sender_pid", *RAW]
    wide = spans(records).join(source, ["path", "source_id"], "left_semi").groupBy(*key).agg(F.min("off_start").alias("low"), F.max("off_end").alias("high"))
    breaks = raw_breaks.select(F.col("session_id").cast("bigint").alias("in_session_id"), F.col("pid").alias("in_pid"), F.col("off_start").alias("position"), "width")
    places = breaks.withColumn("after", F.col("position") + 1)
    crossed = intervals.overlapping(wide, places, RAW, ("low", "high"), ("position", "after")).where("low < position and high > position + width")
    return crossed.select(*key, *_finding("discontinuity-splice", F.col("position"), F.format_string("[%d, %d) crosses the break at %d", "low", "high", "position")))


def fill(cited: DataFrame, gaps: DataFrame, extents: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What a stage leaves uncovered, with its reason: gap inside a gap of the input, else skipped."""
    keys = keys or STREAM
    parts = intervals.overlay(intervals.complement(cited, extents, keys), gaps, keys).where("in_a")
    return parts.select(*keys, "off_start", "off_end", F.when(F.col("in_b"), "gap").otherwise("skipped").alias("reason"))


def unmarked_breaks(records: DataFrame, discontinuities: DataFrame, undecoded: DataFrame, facts: DataFrame) -> DataFrame:
    """Neighbouring records of a decoded stream without a break between whose citations of one input leave out a hole."""
    from ..functions.content import recoverability

    w = Window.partitionBy(*STREAM).orderBy("block_seq")
    blocks = records.select("path", "session_id", F.col("sender_pid").alias("pid"), "block_seq", F.lit(0).alias("is_break"))
    blocks = blocks.unionByName(discontinuities.select(*STREAM, "block_seq", F.lit(1).alias("is_break")))
    turn = blocks.withColumn("breaks", F.sum("is_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("is_break = 0")
    turn = turn.withColumns({"nth": F.row_number().over(w), "broke": F.col("breaks") - F.lag("breaks").over(w)})
    decoded = facts.where(F.array_contains("layers", 0)).select(*STREAM)
    reach = spans(records).withColumnRenamed("sender_pid", "pid").groupBy(*STREAM, "block_seq", *INPUT[1:]).agg(F.min("off_start").alias("low"), F.max("off_end").alias("high"))
    reach = reach.join(turn.select(*STREAM, "block_seq", "nth", "broke"), [*STREAM, "block_seq"]).join(decoded, STREAM, "left_semi")
    own = Window.partitionBy(*STREAM, *INPUT[1:]).orderBy("nth")
    pairs = reach.withColumns({"last_nth": F.lag("nth").over(own), "last_high": F.lag("high").over(own)})
    pairs = pairs.where("last_nth = nth - 1 and broke = 0 and last_high < low")
    explicit = F.coalesce("reason_class", recoverability("reason", "reason_class"))
    holes = undecoded.where("off_start < off_end").withColumn("class", explicit).where("class = 'hole'").select(*INPUT, "off_start", "off_end")
    hit = intervals.overlapping(pairs, holes, INPUT, ("last_high", "low"), ("off_start", "off_end"))
    return hit.select("path", "session_id", "pid", "block_seq", "last_high", "low").distinct()
