"""Structured Streaming over containers.

Blocks have no event time that orders them, so there are no watermarks: a
session's state lives from its declaration to its end block.  An ended session
keeps its id for ``ENDED`` and one that never ends its state for ``OPEN``
milliseconds of processing time after its last block; what comes later is told
as a block of an undeclared session.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..operators.order import _merged
from ..sources import datasource

HALF = S.SEQ_SPACE // 2
ENDED, OPEN = 3600 * 1000, 24 * 3600 * 1000
_OUT = "path string, session_id bigint, block_seq bigint, rule string, message string"
_STATE = "declared boolean, ended boolean, pids string, seqs string, origins string, promised boolean, hinted boolean"


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Wide rows of containers of either face as they grow; a block or line is read when it is whole."""
    datasource.register(spark)
    return spark.readStream.format(datasource.NAME).option("path", path).load()


def _before(a: int, b: int) -> bool:
    return a != b and (a - b) % S.SEQ_SPACE >= HALF


def _check(key, frames, state: GroupState):
    """Rules on sessions, participants, provenance, sequence numbers and promised order of one session, in stored order."""
    path, session = key
    if state.hasTimedOut:
        state.remove()
        return
    declared, ended, pids, seqs, origins, promised, hinted = state.get if state.exists else (False, False, "", "", "", False, False)
    people = set(map(int, pids.split(","))) if pids else set()
    given = set(map(int, origins.split(","))) if origins else set()
    last = dict(tuple(map(int, x.split(":"))) for x in seqs.split(",")) if seqs else {}
    rows = pd.concat(list(frames)).sort_values("block_seq")
    out = []
    for r in rows.itertuples(index=False):
        say = lambda rule, text: out.append((path, session, int(r.block_seq), rule, text))  # noqa: B023, E731
        kind = int(r.block_type)
        if kind == S.SESSION:
            if declared:
                say("C2", "session id declared twice")
            elif not ended:
                promised = bool(r.promised)
            declared = True
            continue
        if not declared or ended:
            say("C3", "session behind the session's end" if ended else "undeclared session")
            continue
        if kind == S.PARTICIPANT:
            if int(r.pid) in people:
                say("C2", "participant id declared twice")
            people.add(int(r.pid))
            if r.has_origin:
                given.add(int(r.pid))
        elif kind == S.SESSION_END:
            if promised and not hinted:
                say("C11", "sequenced without hints or a basis")
            ended, people, last, given = True, set(), {}, set()
        else:
            if int(r.pid) not in people:
                say("C3", "undeclared participant")
                continue
            if kind == S.RECORD and r.has_spans and int(r.pid) in given:
                say("C7", "both origin and spans")
            hinted |= kind == S.RECORD and bool(r.has_hints)
            if kind == S.RECORD and pd.notna(r.seq_start):
                seq = int(r.seq_start)
                if int(r.pid) in last and _before(seq, last[int(r.pid)]) and not _before(last[int(r.pid)], seq):
                    say("C4", "seq_start before that of the record before")
                    continue
                last[int(r.pid)] = seq
    state.update((declared, ended, ",".join(map(str, sorted(people))), ",".join(f"{p}:{s}" for p, s in sorted(last.items())), ",".join(map(str, sorted(given))), promised, hinted))
    state.setTimeoutDuration(ENDED if ended else OPEN)
    if out:
        yield pd.DataFrame(out, columns=["path", "session_id", "block_seq", "rule", "message"])


def check_sessions(stream: DataFrame) -> DataFrame:
    """Findings of rules C2, C3, C4, C7 (origin and spans) and C11 on sessions as blocks arrive.

    What a session alone can tell is told at the block that breaks the rule, C11
    at the session's end.  An ended session keeps its id for a while and nothing
    else.
    """
    kinds = [S.SESSION, S.PARTICIPANT, S.SESSION_END, S.RECORD, S.DISCONTINUITY, S.NAME]
    lean = stream.where(F.col("block_type").isin(kinds) & F.col("parse_error").isNull()).select("path", F.col("session_id").cast("bigint").alias("session_id"), "block_seq", "block_type", "pid", F.col("seq_start").cast("double").alias("seq_start"),
        F.col("origin").isNotNull().alias("has_origin"), (F.coalesce(F.size("spans"), F.lit(0)) > 0).alias("has_spans"), (F.col("seq_start").isNotNull() | F.col("ack").isNotNull()).alias("has_hints"),
        ((F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(1)) == 1) & F.col("sequenced_basis").isNull()).alias("promised"),
    )
    return lean.groupBy("path", "session_id").applyInPandasWithState(_check, _OUT, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def session_counts(stream: DataFrame) -> DataFrame:
    """Records and bytes of each session so far."""
    return stream.where(F.col("block_type") == S.RECORD).groupBy("path", "session_id").agg(F.count("*").alias("record_count"), F.sum(F.octet_length("payload")).alias("bytes"))


_HELD = ["block_seq", "sender_pid", "ts", "seq_start", "ack", "length"]


def _rank(key, frames, state: GroupState):
    """Ranks of a session's records once it has ended, or has been let go; until then their numbers are held, payloads are not."""
    path, session = key
    held, ended = [[] for _ in _HELD], state.hasTimedOut
    if state.exists:
        held = [list(c) for c in state.get]
    if not state.hasTimedOut:
        rows = pd.concat(list(frames)).sort_values("block_seq")
        ends = rows.loc[rows["block_type"] == S.SESSION_END, "block_seq"]
        ended = len(ends) > 0
        rows = rows[rows["block_type"] == S.RECORD]
        if ended:  # what stands behind the end is none of the session's
            rows = rows[rows["block_seq"] < ends.min()]
        for column, name in zip(held, _HELD, strict=True):
            column += [None if pd.isna(x) else int(x) for x in rows[name]]
    if not ended:
        state.update(tuple(held))
        state.setTimeoutDuration(OPEN)
        return
    if state.exists:
        state.remove()
    if held[0]:
        yield pd.DataFrame({"path": path, "session_id": session, "block_seq": held[0], "merge_rank": pd.array(_merged(*held), dtype="Int64")})


def merge_sessions(stream: DataFrame) -> DataFrame:
    """(path, session_id, block_seq, merge_rank): the causal order of each session's records, when its end block arrives."""
    lean = stream.where(F.col("block_type").isin(S.RECORD, S.SESSION_END) & F.col("parse_error").isNull()).select(
        "path", F.col("session_id").cast("bigint").alias("session_id"), "block_seq", "block_type", F.col("pid").alias("sender_pid"), "ts", "seq_start", "ack", F.coalesce(F.octet_length("payload"), F.lit(0)).alias("length")
    )
    kinds = ", ".join(f"{c} array<bigint>" for c in _HELD)
    return lean.groupBy("path", "session_id").applyInPandasWithState(_rank, "path string, session_id bigint, block_seq bigint, merge_rank bigint", kinds, "append", GroupStateTimeout.ProcessingTimeTimeout)
