"""Payload tables from the driver's tables.

conversations  sessions of three hint-less decoded streams (by role); system turns can stand for breaks
events         hint-less sessions (by user) with clocks, a stream for each kind of event
lineitem       hinted streams (by order) of up to 50 bytes at part number modulo 50, with holes and overlaps
documents      decoded streams by source and language
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EXTRA
from ..stages import cut

ROLES = ["system", "user", "assistant"]
LANGS = ["de", "en", "es", "fr"]
SPANS = "array<struct<source_id:int,in_session_id:bigint,in_pid:int,off_start:bigint,off_end:bigint>>"
ORIGIN = "struct<source_id:int,session_id:bigint,pid:int>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(column: str, names: list[str]) -> Column:
    return (F.array_position(F.array(*map(F.lit, names)), F.col(column)) - 1).cast("int")


_DEFAULTS = {"source_id": ("int", 0), "ts": ("bigint", 0), "payload": ("binary", None), "flags": ("int", 0), "seq_start": ("bigint", None), "ack": ("bigint", None), "ts_first": ("bigint", None), "decoder_id": ("int", None), "content_type": ("string", None), "spans": (SPANS, None)}


def records(df: DataFrame, path: str, **columns: Column) -> DataFrame:
    """A records table; what is not given has its default."""
    out = {"path": F.lit(path), **columns}
    for name, (kind, value) in _DEFAULTS.items():
        empty = F.array().cast(kind) if name == "spans" else F.lit(value).cast(kind)
        out[name] = out[name].cast(kind) if name in out else empty
    return df.select(*[c.alias(n) for n, c in out.items()])


def participants(rec: DataFrame, isn: Column | None = None) -> DataFrame:
    """Those that records name; their block_seq is below all records'."""
    p = rec.select("path", "session_id", F.col("sender_pid").alias("pid")).distinct()
    return p.select("path", F.lit(-1).cast("bigint").alias("block_seq"), "session_id", "pid", (isn if isn is not None else F.lit(None)).cast("bigint").alias("isn"), F.lit(None).cast(ORIGIN).alias("origin"))


def sources(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (path, source_id, kind, uri)."""
    return spark.createDataFrame([(p, -10, s, k, u, None) for p, s, k, u in rows], "path string, block_seq bigint, source_id int, kind int, uri string, digest string")


def decoders(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (path, decoder_id, output_layer)."""
    return spark.createDataFrame([(p, -9, d, o, f"decoder {d}") for p, d, o in rows], "path string, block_seq bigint, decoder_id int, output_layer int, name string")


def no_breaks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "path string, block_seq bigint, session_id bigint, pid int, width bigint, reason string")


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return records(
        c, "conversations", block_seq=F.col("turn").cast("bigint"), session_id=F.col("conv_id").cast("bigint"), sender_pid=code("role", ROLES),
        ts=F.col("turn"), payload=F.encode("text", "utf-8"), decoder_id=F.lit(1), content_type=F.concat(F.lit("dec:"), F.col("role")),
    )


def conversation_breaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One stream for each conversation: user and assistant turns are records, system turns breaks of ten times the turn."""
    rec = conversation_records(spark, sf_dir)
    brk = rec.where("sender_pid = 0").select("path", "block_seq", "session_id", F.lit(0).alias("pid"), (F.col("block_seq") * 10).alias("width"), F.lit("system").alias("reason"))
    return rec.where("sender_pid > 0").withColumn("sender_pid", F.lit(0)), brk


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid is a hash of the kind, so that any kinds will do; it is below 2**16 like any pid."""
    e = table(spark, sf_dir, "events")
    return records(
        e, "events", block_seq=F.col("event_id").cast("bigint"), session_id=F.col("user_id").cast("bigint"), sender_pid=F.conv(F.substring(F.md5("event_type"), 1, 4), 16, 10).cast("int"),
        ts=F.unix_micros(F.col("ts").cast("timestamp")), payload=F.encode("props", "utf-8"), content_type=F.lit("mime:application/json"),
    )


LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


#: Lines of the query that runs now, by folder: it reads them in several places and makes them once.
_LINES: dict[str, DataFrame] = {}


def forget() -> None:
    """A query begins: nothing is kept from the one before."""
    _LINES.clear()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k (stream), seq (place in it), [a, b) and flags of each line."""
    if sf_dir not in _LINES:
        _LINES[sf_dir] = cut(_lines(spark, sf_dir))
    return _LINES[sf_dir]


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, seq, a and b of each line, dealt by k.  Lines that agree in all that is sorted by here have equal ranges, so it does not matter which of them stands first."""
    a, by = (F.col("l_partkey") % 50).cast("bigint"), LINE_ORDER[:4]
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), *by)
    seq = F.row_number().over(Window.partitionBy("k").orderBy(*by)).cast("bigint")
    return line.select("k", seq.alias("seq"), a.alias("a"), (a + F.col("l_quantity").cast("bigint")).alias("b"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    a = (F.col("l_partkey") % 50).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.row_number().over(w).cast("bigint").alias("seq"), a.alias("a"), (a + F.col("l_quantity").cast("bigint")).alias("b"),
        F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("sk"),
    )


def hinted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured streams in order of offset; every byte of a payload is an x."""
    w = Window.partitionBy("k").orderBy("a", "b", "seq")
    return records(
        lines(spark, sf_dir).withColumn("place", F.row_number().over(w)), "lines", block_seq=F.col("place").cast("bigint"), session_id=F.col("k"), sender_pid=F.lit(0), ts=F.col("seq"),
        payload=F.encode(F.expr("repeat('x', cast(b - a as int))"), "utf-8"), seq_start=F.col("a"),
    )


def spanned_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were not returned as decoded records that cite [a, b) of input stream k; block_seq is twice the place."""
    span = F.array(F.struct(F.lit(1).alias("source_id"), F.col("k").alias("in_session_id"), F.lit(0).alias("in_pid"), F.col("a").alias("off_start"), F.col("b").alias("off_end")))
    return records(
        lines(spark, sf_dir).where("f <> 'R'"), "derived", block_seq=F.col("seq") * 2, session_id=F.col("k"), sender_pid=F.lit(0), source_id=F.lit(1), ts=F.col("seq"),
        payload=F.encode(F.expr("repeat('y', cast(b - a as int))"), "utf-8"), decoder_id=F.lit(1), spans=span,
    )


def returned_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as undecoded ranges: gap where the line is finished, else skipped."""
    return lines(spark, sf_dir).where("f = 'R'").select(
        F.lit("derived").alias("path"), (F.col("seq") * 2).alias("block_seq"), F.lit(1).alias("source_id"), F.col("k").alias("in_session_id"), F.lit(0).alias("in_pid"), F.col("a").alias("off_start"), F.col("b").alias("off_end"),
        F.when(F.col("s") == "F", "gap").otherwise("skipped").alias("reason"), F.lit(None).cast("string").alias("reason_class"), F.lit(None).cast("int").alias("decoder_id"),
    )


def declared_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third stream's extent is declared 70; every other third's by two sessions that disagree."""
    k = lines(spark, sf_dir).select("k").distinct()
    extent = lambda x: F.array(F.struct(F.lit(1).alias("source_id"), F.col("k").alias("in_session_id"), F.lit(0).alias("in_pid"), F.lit(x).cast("bigint").alias("extent")))
    one = k.where("k % 3 <> 2").select(F.lit("derived").alias("path"), F.lit(10**9).alias("block_seq"), F.col("k").alias("session_id"), extent(70).alias("extents"))
    two = k.where("k % 3 = 1").select(F.lit("derived").alias("path"), F.lit(10**9 + 1).alias("block_seq"), (F.col("k") + 10**9).alias("session_id"), extent(80).alias("extents"))
    return one.unionByName(two)


def document_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decoded streams with the label ``quality``, and breaks behind every tenth document, some without width."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    session, pid = F.regexp_replace("source", "[^0-9]", "").cast("bigint"), code("lang", LANGS)
    rec = records(
        d, "documents", block_seq=F.col("doc_id") * 2, session_id=session, sender_pid=pid, ts=F.col("doc_id"), payload=F.encode("text", "utf-8"), decoder_id=F.lit(1),
        content_type=F.lit("mime:text/plain"), quality=F.coalesce("quality", F.lit(0)), n_chars=F.col("n_chars"),
    )
    brk = d.where("doc_id % 10 = 7").select(
        F.lit("documents").alias("path"), (F.col("doc_id") * 2 + 1).alias("block_seq"), session.alias("session_id"), pid.alias("pid"),
        F.when(F.col("doc_id") % 20 == 7, F.col("doc_id") % 50).cast("bigint").alias("width"), F.lit("cut").alias("reason"),
    )
    return rec, brk


def extra() -> Column:
    return F.array().cast(EXTRA)
