"""Where records come from: spans, followed through files that only preserve.

A record with spans says itself; one without is looked up by its own range in
the stream its participant's origin names, in the file that source's uri names,
and so on up the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import STREAM
from ..stages import cut
from . import intervals

#: Longer chains are refused; a file that leads back to itself would never end.
MOST_HOPS = 32
#: Chains of at most so many files are one plan, without tables between the hops; each file more makes the plan read all before it once more.
PLANNED_HOPS = 4
#: STREAM for joins: rows are sorted by session first, as few paths differ and comparing them is slow.
_KEYS = ["session_id", "pid", "path"]
#: Records are picked out by the names of a hop's files where these are no more.
NAMED = 100


def _levels(wanted: DataFrame, opens: DataFrame, most: int) -> list[list[str]] | None:
    """Paths of the files that each hop can meet, by what files name as inputs; None if there are more hops than ``most``."""
    above: dict[str, set[str]] = {}
    for path, up in opens.select("path", "up_path").distinct().collect():
        above.setdefault(path, set()).add(up)
    level, out = {r[0] for r in wanted.select("path").distinct().collect()} - {None}, []
    while level:
        if len(out) == most:
            return None
        out.append(sorted(level))
        level = set().union(*[above.get(p, set()) for p in level]) - {None}
    return out


def _of(df: DataFrame, paths: list[str]) -> DataFrame:
    return df.where(F.col("path").isin(paths)) if len(paths) <= NAMED else df


def resolve_spans(wanted: DataFrame, ranges: DataFrame, participants: DataFrame, sources: DataFrame, files: DataFrame, *, ids: tuple[str, ...] = ("id",), width: int | None = None) -> DataFrame:
    """Spans behind wanted ranges.

    wanted: (id, path, session_id, pid, off_start, off_end); ranges: records of
    all files with off_start, off_end, spans; files: (uri, path), the catalogue
    that opens inputs.  Returns id, the file whose spans they are, and the span.
    Overlapping records of a parent give all their spans.  ``ids`` are the columns
    of wanted that come back in place of id; ``width`` is that of the bins in
    which ranges meet, which is measured where it is not given.

    Inputs that are dealt by session already, and parents' sessions that are
    known to be dealt like those of their children, need no other shuffle if the
    result is written by ``stages.dealt``.
    """
    step = wanted.select(*ids, *STREAM, F.col("off_start").alias("lo"), F.col("off_end").alias("hi"))
    records = ranges.select(*STREAM, "block_seq", "off_start", "off_end", "spans")
    opens = sources.select("path", "source_id", "uri").join(F.broadcast(files.select("uri", F.col("path").alias("up_path"))), "uri").drop("uri")
    up = (
        participants.where("origin is not null")
        .select(*STREAM, F.col("origin.source_id").alias("source_id"), F.col("origin.session_id").cast("bigint").alias("up_session"), F.col("origin.pid").alias("up_pid"))
        .join(F.broadcast(opens), ["path", "source_id"])
        .select(*STREAM, "up_path", "up_session", "up_pid")
    )
    levels = _levels(wanted, opens, PLANNED_HOPS)
    if width is None:
        width = intervals.bin_width((records, "off_start", "off_end"), (step, "lo", "hi"))
    records = intervals.in_bins(records, "off_start", "off_end", width)
    if levels is None:
        # each hop reads them: they are dealt to their bins once
        records = cut(records.repartition(*_KEYS, "__bin"))
    place = F.expr("lo = hi and off_start = lo and off_end = hi")
    out = None
    for hop in range(MOST_HOPS if levels is None else max(1, len(levels))):
        here = records if levels is None else _of(records, levels[hop] if levels else [])
        hit = intervals.overlapping(step, here, _KEYS, ("lo", "hi"), ("off_start", "off_end"), also=place, width=width)
        if levels is None:
            # a chain of many files, or one that may lead back; each hop is cut so that plans stay small
            hit = cut(hit)
        found = hit.where("size(spans) > 0").select(*ids, F.col("path").alias("file"), "block_seq", F.explode("spans").alias("__span")).select(*ids, "file", "block_seq", "__span.*")
        out = found if out is None else out.unionByName(found)
        if levels is not None and hop + 1 >= len(levels):
            return out
        deeper = hit.where("coalesce(size(spans), 0) <= 0").join(up if levels is None else _of(up, levels[hop]), _KEYS)
        step = deeper.select(*ids, F.col("up_path").alias("path"), F.col("up_session").alias("session_id"), F.col("up_pid").alias("pid"), F.col("off_start").alias("lo"), F.col("off_end").alias("hi"))
        if levels is None and step.isEmpty():
            return out
    raise ValueError("the chain of files is too long, or leads back to itself")
