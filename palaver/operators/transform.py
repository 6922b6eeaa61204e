"""Derivations: merge of two sides, filter and reorder stages, decode stages.

Each gives tables of a new file; sources.container writes them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DECODED, STREAM
from ..stages import cut
from . import intervals, offsets
from .coverage import fill
from .order import causal_merge
from .segments import chunks, cite, input_extent

SPAN = "struct<source_id:int,in_session_id:bigint,in_pid:int,off_start:bigint,off_end:bigint>"


def merge_sides(a: dict[str, DataFrame], b: dict[str, DataFrame], path: str, session_id: int = 1) -> dict[str, DataFrame]:
    """Two files of one session with one transport participant each as one sequenced session.

    Participants get pids 0 and 1 and an origin; records keep payload and hints
    and lose their spans; the stored order is the causal merge.
    """
    out_r, out_p = None, None
    for pid, t in enumerate((a, b)):
        one = t["participants"].agg(F.count("*").alias("n"), F.count_distinct("session_id").alias("sessions"))
        n, sessions = one.first()
        if n != 1 or sessions != 1:
            raise ValueError("each side needs one session with one participant")
        p = t["participants"].select(
            F.lit(path).alias("path"), F.lit(session_id).cast("bigint").alias("session_id"), F.lit(pid).alias("pid"), "endpoints", "isn", "identity", "tcp_role",
            F.struct(F.lit(pid).alias("source_id"), F.col("session_id").cast("bigint").alias("session_id"), F.col("pid").alias("pid")).alias("origin"),
        )
        layer = offsets.with_layer(t["records"], t["decoders"]).where("layer is null or layer <> 1")
        if not layer.isEmpty():
            raise ValueError("each side needs transport records")
        r = t["records"].withColumns({
            "block_seq": F.col("block_seq") * 2 + pid, "path": F.lit(path), "session_id": F.lit(session_id).cast("bigint"), "sender_pid": F.lit(pid), "source_id": F.lit(pid), "spans": F.array().cast(f"array<{SPAN}>"), "decoder_id": F.lit(None).cast("int"),
        })
        out_p, out_r = (p, r) if out_p is None else (out_p.unionByName(p), out_r.unionByName(r))
    ha, hb = (t["headers"].select("tick_hz", F.coalesce("time_epoch", F.lit(0)).alias("epoch")).first() for t in (a, b))
    if ha != hb:
        raise ValueError("the sides' clocks differ")
    # the sides' places are kept apart by their lowest bit
    merged = causal_merge(out_r, out_p)
    return {"participants": out_p, "records": merged.withColumn("block_seq", F.col("merge_rank")).drop("merge_rank")}


def rewrite(records: DataFrame, discontinuities: DataFrame, facts: DataFrame, *, keep: Column | None = None, reorder: list[Column] | None = None, source_id: int = 0) -> dict[str, DataFrame]:
    """A filter or reorder stage over decoded streams: records, discontinuities and undecoded of its output.

    Survivors cite their input ranges.  What is dropped is undecoded ``skipped``,
    declared widths are undecoded ``gap``.  Between survivors the input's breaks
    come first, then the stage's own: ``reordered`` where ranges run backwards,
    ``records-dropped`` with the width that the input's breaks do not explain.
    ``position`` orders each output stream.
    """
    decoded = facts.where(F.col("layer") == DECODED).select(*STREAM)
    r, d = (x.join(decoded, STREAM, "left_semi") for x in (records.withColumnRenamed("sender_pid", "pid"), discontinuities))
    ranges = offsets.record_ranges(r.withColumnRenamed("pid", "sender_pid"), d, facts)
    kept = ranges.where(keep) if keep is not None else ranges
    order = [*(reorder or []), F.col("block_seq")]
    w = Window.partitionBy(*STREAM).orderBy(*order)
    kept = kept.withColumns({"position": F.row_number().over(w).cast("bigint"), "__last_end": F.lag("off_end").over(w)})
    # each break goes with the next survivor in stored order; after the last it is not carried
    brk = offsets.break_positions(records, discontinuities).join(decoded, STREAM, "left_semi")
    marks = kept.select(*STREAM, "block_seq", F.col("block_seq").alias("survivor"), F.lit(None).cast("bigint").alias("width"))
    marks = marks.unionByName(d.select(*STREAM, "block_seq", F.lit(None).cast("bigint").alias("survivor"), F.col("width").cast("bigint").alias("width")))
    ahead = Window.partitionBy(*STREAM).orderBy("block_seq").rowsBetween(1, Window.unboundedFollowing)
    carried = marks.withColumn("next", F.first("survivor", ignorenulls=True).over(ahead)).where("survivor is null and next is not null")
    carried = carried.select(*STREAM, F.col("block_seq").alias("break_seq"), F.col("next").alias("block_seq"))
    inherited = carried.join(d.select(*STREAM, F.col("block_seq").alias("break_seq"), "width", "reason"), [*STREAM, "break_seq"])
    widths = inherited.groupBy(*STREAM, "block_seq").agg(F.sum(F.coalesce("width", F.lit(0))).alias("carried"))
    at = kept.select(*STREAM, "block_seq", "position", "off_start", F.col("__last_end").alias("last_end")).join(widths, [*STREAM, "block_seq"], "left")
    withheld = F.col("off_start") - F.col("last_end") - F.coalesce("carried", F.lit(0))
    back = F.col("off_start") < F.col("last_end")
    seams = at.where(F.col("last_end").isNotNull() & (back | (withheld > 0))).select(
        *STREAM, "position", F.lit(1).alias("turn"), F.lit(None).cast("bigint").alias("break_seq"), F.when(~back, withheld).cast("bigint").alias("width"), F.when(back, "reordered").otherwise("records-dropped").alias("reason")
    )
    old = inherited.join(kept.select(*STREAM, "block_seq", "position"), [*STREAM, "block_seq"]).select(
        *STREAM, "position", F.lit(0).alias("turn"), "break_seq", F.col("width").cast("bigint").alias("width"), "reason"
    )
    holes = brk.where("width > 0").select(*STREAM, "off_start", (F.col("off_start") + F.col("width")).alias("off_end"))
    last = ranges.groupBy(*STREAM).agg(F.max_by("off_end", "block_seq").alias("extent"))
    skipped = intervals.complement(kept.select(*STREAM, "off_start", "off_end").unionByName(holes), last, STREAM)
    undecoded = holes.withColumn("reason", F.lit("gap")).unionByName(skipped.withColumn("reason", F.lit("skipped")))
    survivors = kept.withColumn("spans", F.array(cite(source_id, F.col("session_id"), F.col("pid"), F.col("off_start"), F.col("off_end"))))
    return {
        "records": survivors.select(*STREAM, "position", "block_seq", "ts", "payload", "flags", "decoder_id", "content_type", "spans"),
        "discontinuities": old.unionByName(seams),
        "undecoded": undecoded.select(*STREAM, "off_start", "off_end", "reason"),
        "extents": last,
    }


#: What a decoder's units become: a row for each span of a record, for each range that it marks, and for each break.
_UNITS = (
    "path string, session_id bigint, pid int, unit bigint, position bigint, kind string, payload binary, ts bigint, content_type string, flags int, seq_start bigint, ack bigint,"
    " width bigint, reason string, source_id int, in_session_id bigint, in_pid int, off_start bigint, off_end bigint"
)
_NAMES = [x.split()[0] for x in _UNITS.split(", ")]
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _spans(cites, own: tuple[int, int, int]) -> list[tuple]:
    """Spans (source_id, in_session_id, in_pid, off_start, off_end) of a pair of offsets, a span, or a sequence of either.

    A pair is a range of the unit's own stream; a span is a dict and may name another.
    """
    if cites is None:
        return []
    if isinstance(cites, dict):
        return [(int(cites["source_id"]), int(cites["in_session_id"]), int(cites["in_pid"]), int(cites["off_start"]), int(cites["off_end"]))]
    if isinstance(cites, tuple) and len(cites) == 2 and all(isinstance(x, int) for x in cites):
        return [(*own, *cites)]
    return [span for one in cites for span in _spans(tuple(one) if isinstance(one, list) else one, own)]


def _run_decoder(decoder, key: tuple, units: list[dict], source_id: int) -> list[dict]:
    """The rows of one stream; a record that cites nothing is refused."""
    path, session, pid = key
    own, out, position, emitted = (source_id, session, pid), [], 0, False

    def add(unit: int, kind: str, **values) -> None:
        out.append({"path": path, "session_id": session, "pid": pid, "unit": unit, "position": position, "kind": kind, **values})

    for i, u in enumerate(decoder(units)):
        if "discontinuity" in u:
            position += 1
            add(i, "break", **{k: u["discontinuity"].get(k) for k in ("width", "reason")})
        if u.get("payload") is not None:
            spans = _spans(u.get("cites"), own)
            if not spans:
                raise ValueError(f"session {session}, pid {pid}: a decoded record has to cite the input that it was made from")
            # a first record has no seam before it
            if u.get("seam") is not None and emitted:
                position += 1
                add(i, "break", **{k: u["seam"].get(k) for k in ("width", "reason")})
            emitted = True
            position += 1
            hints = u.get("hints") or {}
            record = {"payload": u["payload"], "ts": u["ts"], "content_type": u.get("content_type"), "flags": int(u.get("flags") or 0), "seq_start": hints.get("seq_start"), "ack": hints.get("ack")}
            for span in spans:
                add(i, "record", **record, **dict(zip(_NAMES[-5:], span, strict=True)))
        elif u.get("cites") is not None or u.get("seam") is not None:
            raise ValueError(f"session {session}, pid {pid}: a unit without payload cites nothing and has no seam")
        for start, end, reason in u.get("undecoded", ()):
            add(i, "mark", reason=reason, **dict(zip(_NAMES[-5:], (*own, start, end), strict=True)))
    return out


def decode_stage(records: DataFrame, discontinuities: DataFrame, facts: DataFrame, decoder: Callable[[list[dict]], list[dict]], *, source_id: int = 0) -> dict[str, DataFrame]:
    """Runs a decoder over each input stream and accounts for all of its bytes.

    The decoder gets a stream's units in order (dicts with data, off_start,
    off_end, ts; segments where the stream has hints, else datagrams) and returns
    dicts, each with any of

    payload, ts, cites    a record.  cites is a pair of offsets, a span (a dict that
                          may name another stream), or a sequence of either; a
                          record without any is refused.  Beside it content_type,
                          flags, hints (seq_start, ack; of a transport layer) and
                          seam (width, reason; a break before this record, unless
                          it is the stream's first)
    discontinuity         a break of the output (width, reason) at this place
    undecoded             triples (start, end, reason) that the decoder declines

    What it neither cites nor marks is filled in; what it does both with fails.
    ``position`` orders records and breaks of a stream.  One stream is a task's
    group: its size is the unit of memory.
    """
    chunked = cut(chunks(records, facts))
    ranges = offsets.record_ranges(records, discontinuities, facts)
    packets = ranges.join(facts.where("not stream_oriented").select(*STREAM), STREAM, "left_semi").select(*STREAM, "off_start", "off_end", "ts", F.col("payload").alias("data"), "block_seq")
    input_units = chunked.where("kind = 'segment'").select(*STREAM, "off_start", "off_end", "ts", "data", F.col("off_start").alias("block_seq")).unionByName(packets)

    def run(key, table):
        units = table.sort_by([("block_seq", "ascending")]).select(["off_start", "off_end", "ts", "data"]).to_pylist()
        rows = _run_decoder(decoder, tuple(k.as_py() for k in key), units, source_id)
        return pa.table({n: pa.array([r.get(n) for r in rows], _KINDS[x.split()[1]]) for n, x in zip(_NAMES, _UNITS.split(", "), strict=True)})

    lean = input_units.withColumn("session_id", F.col("session_id").cast("bigint"))
    made = cut(lean.groupBy(*STREAM).applyInArrow(run, _UNITS))  # the decoder runs once
    # what is covered is counted by input stream, whichever output stream cites it
    of_input = [F.col("path"), F.col("in_session_id").alias("session_id"), F.col("in_pid").alias("pid"), "off_start", "off_end"]
    cited, marked = (made.where((F.col("kind") == k) & (F.col("source_id") == source_id) & (F.col("off_start") < F.col("off_end"))) for k in ("record", "mark"))
    twice = intervals.intersect(cited.select(*of_input), marked.select(*of_input), STREAM).limit(1).collect()
    if twice:
        x = twice[0]
        raise ValueError(f"session {x.session_id}, pid {x.pid}: [{x.off_start}, {x.off_end}) is both decoded and marked undecoded")
    both = cited.select(*of_input).unionByName(marked.select(*of_input))
    extents = input_extent(chunked, ranges, facts)
    gaps = chunked.where("kind = 'gap'").select(*STREAM, "off_start", "off_end")
    filled = fill(both, gaps, extents.select(*STREAM, F.col("extent").cast("bigint").alias("extent")))
    span = F.struct(*_NAMES[-5:])
    values = [F.first(c).alias(c) for c in ("position", "payload", "ts", "content_type", "flags", "seq_start", "ack")]
    out = made.where("kind = 'record'").groupBy(*STREAM, "unit").agg(*values, F.sort_array(F.collect_list(span)).alias("spans"))
    return {
        "records": out,
        "discontinuities": made.where("kind = 'break'").select(*STREAM, "unit", "position", "width", "reason"),
        "undecoded": made.where("kind = 'mark'").select(*of_input, "reason").unionByName(filled.select(*STREAM, "off_start", "off_end", "reason")),
        "extents": extents,
    }


def linearize(records: DataFrame, participants: DataFrame | None = None) -> DataFrame:
    """records of sessions that were written side by side, each side in its own order, with block_seq in causal order.

    A session that no causal order can be given fails the job.  Breaks stand
    between records of one side and are not moved, so sessions with breaks are
    not for this.
    """
    ranked = causal_merge(records, participants)
    place = F.row_number().over(Window.partitionBy("path").orderBy("session_id", "merge_rank")).cast("bigint")
    return ranked.withColumn("block_seq", place).drop("merge_rank")
