"""Building containers: from the tables of operators to checked, ordered blocks.

``build`` puts tables in declare-first order, gives dense ids where none are,
checks every rule and writes nothing while an error stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import conformance
from ..stages import cut
from . import container

_ORDER = ["headers", "sources", "decoders", "sessions", "participants", "stored", "undecoded", "session_ends", "custom_blocks"]
_KIND = {name: kind for name, (kind, _) in S.TABLES.items()}
_BACK = {name: {v: k for k, v in renamed.items()} for name, renamed in S.RENAMED.items()}


class Invalid(ValueError):
    """A rule is broken; ``findings`` are the first of them."""

    def __init__(self, findings):
        self.findings = findings
        super().__init__("; ".join(f"{f.path} {f.rule}: {f.message}" for f in findings))


def header(spark: SparkSession, path: str, *, tick_hz: int = 1000, time_epoch: int | None = None, creator: str | None = None, produced_by: str | None = None, produced_at: int | None = None, transform_params_digest: str | None = None, single_clock: bool = False) -> DataFrame:
    kinds = "path string, block_seq bigint, tick_hz bigint, time_epoch bigint, creator string, produced_by string, produced_at bigint, transform_params_digest string, flags int"
    return spark.createDataFrame([(path, 0, tick_hz, time_epoch, creator, produced_by, produced_at, transform_params_digest, int(single_clock))], kinds)


def dense_ids(df: DataFrame, key: str, out: str, scope: str = "path") -> DataFrame:
    """df with ids from 0 in each file, by the order of key."""
    ids = df.select(scope, key).distinct().withColumn(out, F.row_number().over(Window.partitionBy(scope).orderBy(key)) - 1)
    return df.join(ids, [scope, key])


def stored(records: DataFrame, discontinuities: DataFrame | None = None, names: DataFrame | None = None, order: list[str | Column] | None = None) -> DataFrame:
    """Records, breaks and names as one part in stored order: that of ``order``, else of block_seq."""
    out = None
    for name, df in (("records", records), ("discontinuities", discontinuities), ("names", names)):
        if df is not None:
            one = _wide(name, df)
            out = one if out is None else out.unionByName(one)
    if order:
        out = out.withColumn("block_seq", F.row_number().over(Window.partitionBy("path").orderBy(*order)).cast("bigint"))
    return out


def _wide(name: str, df: DataFrame) -> DataFrame:
    back = _BACK.get(name, {})
    out = df.withColumnsRenamed({c: back[c] for c in df.columns if c in back})
    if "block_seq" not in out.columns:
        out = out.withColumn("block_seq", F.lit(0).cast("bigint"))
    kinds = dict(out.dtypes)
    if "flags" in S.TABLES[name][1]:
        out = out.withColumn("flags", F.coalesce(F.col("flags") if "flags" in kinds else F.lit(None), F.lit(0)).cast("int"))
    return container.wide(out.withColumn("block_type", F.lit(_KIND[name])).drop("content"))


def build(t: dict[str, DataFrame], *, check: bool = True, close: bool = True) -> DataFrame:
    """Wide rows of whole files from tables (records, discontinuities and names by block_seq)."""
    parts = []
    for name in _ORDER:
        if name == "stored":
            if "records" in t:
                parts.append(stored(t["records"], t.get("discontinuities"), t.get("names")))
        elif name in t:
            parts.append(_wide(name, t[name]))
    if close:
        parts.append(container.wide(t["headers"].select("path", F.lit(0).cast("bigint").alias("block_seq"), F.lit(S.END).alias("block_type"))))
    blocks = cut(container.union(parts))  # every rule reads it
    if check:
        own = container.tables(blocks)
        found = conformance.findings(own, blocks).where("severity = 'error'").unionByName(_sequenced_order(own)).limit(20).collect()
        if found:
            raise Invalid(found)
    return blocks


def _sequenced_order(t: dict[str, DataFrame]) -> DataFrame:
    """What a session that is flagged sequenced must not do: acknowledge what was acknowledged before, or go back."""
    from ..operators import order

    flagged = t["sessions"].where(F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(1)) == 1).select("path", "session_id")
    bad = order.verify_sequenced(t["records"].join(flagged, ["path", "session_id"], "left_semi")).where("rule = 'already-acked'")
    none = F.lit(None)
    return bad.select("path", "block_seq", F.lit("error").alias("severity"), F.lit("O8").alias("rule"), F.lit("sequenced-order").alias("category"), none.cast("bigint").alias("offset"), F.lit("a record behind the acknowledgement of its bytes").alias("message"))


def derive(t: dict[str, DataFrame], path: str, *, uri: str, digest: str | None, produced_by: str, produced_at: int, sequenced: str | None = None) -> dict[str, DataFrame]:
    """Header, source, sessions and participants of a file derived from the one in t: same clock and ids, no isn.

    With ``sequenced`` (what the order rests on) sessions promise that their stored order is causal; ``transform.linearize`` gives it.
    """
    spark = t["headers"].sparkSession
    h = t["headers"].select("tick_hz", "time_epoch").first()
    return {
        "headers": header(spark, path, tick_hz=int(h.tick_hz), time_epoch=h.time_epoch, produced_by=produced_by, produced_at=produced_at),
        "sources": spark.createDataFrame([(path, 0, 0, S.FILE_INPUT, uri, digest)], "path string, block_seq bigint, source_id int, kind int, uri string, digest string"),
        "sessions": t["sessions"].select(F.lit(path).alias("path"), "block_seq", "session_id", "proto", "flow_key", F.lit(int(sequenced is not None)).alias("flags"), F.lit(sequenced).cast("string").alias("sequenced_basis")),
        "participants": t["participants"].select(F.lit(path).alias("path"), "block_seq", "session_id", "pid", "endpoints", "identity", "tcp_role"),
    }


def extents_of(extents: DataFrame, path: str, source_id: int = 0) -> DataFrame:
    """session_ends that declare the input's extents (session_id, pid, extent)."""
    entry = F.struct(F.lit(source_id).alias("source_id"), F.col("session_id").cast("bigint").alias("in_session_id"), F.col("pid").cast("int").alias("in_pid"), F.col("extent").cast("bigint").alias("extent"))
    ends = extents.groupBy("session_id").agg(F.sort_array(F.collect_list(entry)).alias("extents"))
    return ends.select(F.lit(path).alias("path"), F.lit(0).cast("bigint").alias("block_seq"), "session_id", "extents")


def rewritten(t: dict[str, DataFrame], path: str, *, uri: str, digest: str | None = None, produced_by: str, produced_at: int, keep: Column | None = None, reorder: list[Column] | None = None) -> dict[str, DataFrame]:
    """Tables of a filter or reorder stage over the decoded streams of a file; decoders keep their layer, extents are declared."""
    from ..operators import offsets, transform

    if t["decoders"].isEmpty():
        raise ValueError("the file has no decoded layer")
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"])
    out = transform.rewrite(t["records"], t["discontinuities"], facts, keep=keep, reorder=reorder)
    base = derive(t, path, uri=uri, digest=digest, produced_by=produced_by, produced_at=produced_at)
    here = F.lit(path).alias("path")
    # breaks stand before the survivor that they belong to
    rec = out["records"].select(here, "session_id", F.col("pid").alias("sender_pid"), F.lit(0).alias("source_id"), "ts", "payload", "flags", "decoder_id", "content_type", "spans", "position", F.lit(2).alias("turn"), F.lit(0).cast("bigint").alias("break_seq"))
    brk = out["discontinuities"].select(here, "session_id", "pid", "width", "reason", "position", "turn", F.coalesce("break_seq", F.lit(0)).alias("break_seq"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("session_id", "pid", "position", "turn", "break_seq")).cast("bigint")
    both = rec.withColumnRenamed("sender_pid", "pid").withColumn("is_record", F.lit(True)).unionByName(brk.withColumn("is_record", F.lit(False)), allowMissingColumns=True).withColumn("block_seq", place)
    base["records"] = both.where("is_record").withColumnRenamed("pid", "sender_pid").drop("is_record", "width", "reason", "position", "turn", "break_seq")
    base["discontinuities"] = both.where("not is_record").select("path", "block_seq", "session_id", "pid", "width", "reason")
    base["decoders"] = t["decoders"].select(here, "block_seq", "decoder_id", "output_layer", "name", "version", "params_digest")
    base["undecoded"] = out["undecoded"].select(here, F.lit(0).cast("bigint").alias("block_seq"), F.lit(0).alias("source_id"), F.col("session_id").alias("in_session_id"), F.col("pid").alias("in_pid"), "off_start", "off_end", "reason")
    base["session_ends"] = extents_of(out["extents"], path)
    return base


def merged(a: dict[str, DataFrame], b: dict[str, DataFrame], path: str, *, uris: tuple[str, str], digests: tuple[str | None, str | None] = (None, None), produced_by: str, produced_at: int) -> dict[str, DataFrame]:
    """Tables of one sequenced session from two one-sided files; its basis is named where no record carries hints."""
    from ..operators import order, transform

    out = transform.merge_sides(a, b, path)
    spark = a["headers"].sparkSession
    h = a["headers"].select("tick_hz", "time_epoch").first()
    clocks = [x["headers"].select("flags").first().flags or 0 for x in (a, b)]
    out["headers"] = header(spark, path, tick_hz=int(h.tick_hz), time_epoch=h.time_epoch, produced_by=produced_by, produced_at=produced_at, single_clock=all(c & 1 for c in clocks))
    out["sources"] = spark.createDataFrame([(path, 0, i, S.FILE_INPUT, uris[i], digests[i]) for i in (0, 1)], "path string, block_seq bigint, source_id int, kind int, uri string, digest string")
    session = spark.createDataFrame([(path, 0, 1, 1)], "path string, block_seq bigint, session_id bigint, flags int")
    basis = order.sequenced_basis(session.withColumn("sequenced_basis", F.lit(None).cast("string")), out["participants"], out["records"], out["headers"]).first().basis
    if basis is None:
        raise ValueError("nothing says what the order of records without hints rests on")
    out["sessions"] = session.withColumn("sequenced_basis", F.lit(None if basis == "protocol" else basis).cast("string"))
    return out
