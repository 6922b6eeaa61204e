"""Queries over containers that are written to files and scanned again, over planted faults, and over streams; each with its SQL.

Containers are made from nations and customers: a file for each region, a session
for each nation, a record for each customer, and every other kind of block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import content
from ..operators import conformance, offsets, order, transform
from ..sources import container
from ..stages import folder
from . import synth
from .queries import CONV, LINES, query

PLACE = "CAST(n_nationkey AS BIGINT)"
#: Parts of a file in order: block type, table, its order in the file, and columns; expressions are those of either engine.
PARTS: list[tuple[int, str, str, dict[str, str]]] = [
    (S.FILE_HEADER, "region", "0", {"version_major": "0", "version_minor": "16", "tick_hz": "1000 + r_regionkey", "time_epoch": "-r_regionkey", "creator": "r_name", "produced_by": "'stage'", "produced_at": "7", "flags": "r_regionkey % 2"}),
    (S.SOURCE, "region", "0", {"source_id": "0", "kind": "0", "uri": "'capture'", "link_type": "1"}),
    (S.SOURCE, "region", "0", {"source_id": "1", "kind": "1", "uri": "concat('in-', r_name)", "digest": "'sha256:00'"}),
    (S.DECODER, "region", "0", {"decoder_id": "1", "output_layer": "0", "name": "'d'", "version": "'1'"}),
    (S.SESSION, "nation", PLACE, {"session_id": "n_nationkey", "proto": "n_name", "flags": "n_nationkey % 2", "sequenced_basis": "CASE WHEN n_nationkey % 2 = 1 THEN 'clock' END"}),
    (S.PARTICIPANT, "nation", PLACE, {"session_id": "n_nationkey", "pid": "0", "identity": "n_name"}),
    (S.RECORD, "customer JOIN nation ON c_nationkey = n_nationkey", "c_custkey", {"session_id": "n_nationkey", "pid": "0", "source_id": "1", "ts": "c_custkey * 3 - 5", "payload_text": "c_name", "flags": "c_custkey % 3", "ts_first": "CASE WHEN c_custkey % 4 = 0 THEN c_custkey END", "decoder_id": "1", "content_type": "concat('dec:', c_mktsegment)", "span_from": "c_custkey * 20"}),
    (S.UNDECODED, "nation", PLACE, {"source_id": "1", "session_id": "n_nationkey", "pid": "0", "off_start": "n_nationkey", "off_end": "n_nationkey * 2 + 1", "reason": "'skipped'"}),
    (S.DISCONTINUITY, "nation", PLACE, {"session_id": "n_nationkey", "pid": "0", "width": "CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END", "reason": "'cut'"}),
    (S.NAME, "nation", PLACE, {"session_id": "n_nationkey", "pid": "0", "label": "n_name", "label_kind": "'dns'"}),
    (S.CUSTOM, "nation", PLACE, {"pen": "n_nationkey * 1000", "subtype": "n_nationkey", "payload_text": "'four'"}),
    (0x77, "region", "0", {"content_text": "'blob'"}),
    (S.SESSION_END, "nation", PLACE, {"session_id": "n_nationkey", "reason": "'done'"}),
    (S.END, "region", "0", {}),
]
TEXT = ["creator", "produced_by", "uri", "digest", "name", "version", "proto", "sequenced_basis", "identity", "reason", "content_type", "label", "label_kind"]
NUMBERS = ["version_major", "version_minor", "tick_hz", "time_epoch", "produced_at", "flags", "source_id", "kind", "link_type", "decoder_id", "output_layer", "session_id", "pid", "ts", "ts_first", "off_start", "off_end", "width", "pen", "subtype"]
LOOSE = ["payload_text", "content_text", "span_from"]


def _file(table: str) -> str:
    return f"concat('file-', {'r_regionkey' if table == 'region' else 'n_regionkey'})"


def _sql() -> str:
    """Every block as the scan has to give it: place, type, texts, numbers, payload, content, first span."""
    parts = []
    for turn, (kind, table, place, columns) in enumerate(PARTS):
        # flags are there, as 0, in blocks that have them in a fixed place or leave them out when 0
        words = " || '|' || ".join(f"coalesce(CAST({columns.get(c, 'NULL')} AS VARCHAR), '-')" for c in TEXT)
        numbers = " || ',' || ".join(f"coalesce(CAST({columns.get(c, 'NULL')} AS VARCHAR), '-')" for c in NUMBERS)
        loose = ", ".join(f"CAST({columns.get(c, 'NULL')} AS VARCHAR) AS {c}" for c in LOOSE)
        parts.append(f"SELECT {_file(table)} AS file, {turn} AS turn, {place} AS place, {kind} AS block_type, {words} AS words, {numbers} AS numbers, {loose} FROM {table}")
    return f"SELECT file, row_number() OVER (PARTITION BY file ORDER BY turn, place) - 1 AS block_seq, block_type, words, numbers, payload_text, content_text, span_from FROM ({' UNION ALL '.join(parts)}) q"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as wide rows of containers."""
    for name in ("region", "nation", "customer"):
        synth.table(spark, sf_dir, name).createOrReplaceTempView(f"palaver_{name}")
    parts = []
    for kind, table, place, columns in PARTS:
        named = " ".join(f"palaver_{w}" if w in ("region", "nation", "customer") else w for w in table.split())
        own = {c: x for c, x in columns.items() if c not in LOOSE}
        own |= {"payload": f"CAST({columns['payload_text']} AS BINARY)"} if "payload_text" in columns else {}
        own |= {"content": f"CAST({columns['content_text']} AS BINARY)"} if "content_text" in columns else {}
        if "span_from" in columns:
            start = columns["span_from"]
            own["spans"] = f"array(named_struct('source_id', 1, 'in_session_id', CAST(n_nationkey AS DECIMAL(20, 0)), 'in_pid', 0, 'off_start', CAST({start} AS DECIMAL(20, 0)), 'off_end', CAST({start} + 18 AS DECIMAL(20, 0))))"
        picked = ", ".join(f"{x} AS {c}" for c, x in {"path": _file(table), "block_seq": place, "block_type": str(kind), **own}.items())
        parts.append(spark.sql(f"SELECT {picked} FROM {named}"))
    return container.union(parts)


def _shown(blocks: DataFrame) -> DataFrame:
    """What SQL says of each block, from the scan's columns."""
    dash = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return blocks.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "block_seq", "block_type", F.concat_ws("|", *map(dash, TEXT)).alias("words"), F.concat_ws(",", *map(dash, NUMBERS)).alias("numbers"),
        F.decode("payload", "utf-8").alias("payload_text"), F.when(~F.col("block_type").isin([k for k, _ in S.TABLES.values()]), F.decode("content", "utf-8")).alias("content_text"), F.try_element_at("spans", F.lit(1))["off_start"].cast("string").alias("span_from"),
    )


def _written(spark: SparkSession, sf_dir: str, face: str) -> str:
    where = folder(spark)
    container.write(_blocks(spark, sf_dir), where, face=face).write.format("noop").mode("overwrite").save()
    return where


@query(_sql())
def binary_scan(spark, sf_dir):
    """Every kind of block written to binary files and scanned, all columns."""
    return _shown(container.read(spark, _written(spark, sf_dir, "binary")))


@query(_sql())
def jsonl_scan(spark, sf_dir):
    """The same through files of JSON lines."""
    return _shown(container.read(spark, _written(spark, sf_dir, "jsonl")))


@query(_sql())
def converted_scan(spark, sf_dir):
    """Binary files converted to lines, and these to binary files."""
    lines, again = folder(spark), folder(spark)
    for source, target, face in ((_written(spark, sf_dir, "binary"), lines, "jsonl"), (lines, again, "binary")):
        container.convert(spark, source, target, face=face)[0].write.format("noop").mode("overwrite").save()
    return _shown(container.read(spark, again))


@query(_sql())
def split_scan(spark, sf_dir):
    """Binary files read in parts of some thousand bytes."""
    return _shown(container.read(spark, _written(spark, sf_dir, "binary"), split=4096))


@query(_sql())
def split_lines_scan(spark, sf_dir):
    """Files of JSON lines read in parts of some thousand bytes."""
    return _shown(container.read(spark, _written(spark, sf_dir, "jsonl"), split=4096))


@query("SELECT concat('file-', r_regionkey) AS file, face FROM region, (SELECT unnest(['binary', 'jsonl']) AS face) f")
def face_sniffing(spark, sf_dir):
    """S15."""
    found = [container.faces(spark, _written(spark, sf_dir, face)) for face in ("binary", "jsonl")]
    return found[0].unionByName(found[1]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "face")


@query("SELECT concat('file-', n_regionkey) AS file, n_nationkey AS session_id, count(c_custkey) AS records FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def pruned_scan(spark, sf_dir):
    """Sessions and records only, without payloads."""
    b = container.read(spark, _written(spark, sf_dir, "binary"), kinds=[S.SESSION, S.RECORD], payload=False)
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    return b.groupBy(file, F.col("session_id").cast("int").alias("session_id")).agg(F.sum((F.col("block_type") == S.RECORD).cast("int")).alias("records"))


@query("""WITH s AS (SELECT concat('file-', r_regionkey) AS file, k FROM region, (SELECT unnest(['cut', 'tail', 'other']) AS k) f)
 SELECT concat(k, '-', file) AS file, CASE k WHEN 'cut' THEN 'truncated' WHEN 'tail' THEN 'trailing-bytes' ELSE 'broken-file' END AS category FROM s""")
def scan_diagnostics(spark, sf_dir):
    """Files that are cut, that go on behind their end, and that are none; each leaves the others alone."""
    source, target = _written(spark, sf_dir, "binary"), folder(spark)

    def spoil(batches):
        from ..sources import datasource

        system, root = datasource.filesystem(target)
        system.create_dir(root, recursive=True)
        old, _ = datasource.filesystem(source)
        for b in batches:
            for path in b.column(0).to_pylist():
                with old.open_input_file(path) as f:
                    data = f.read()
                for kind, spoilt in (("cut", data[:-6]), ("tail", data + b"more bytes"), ("other", data[4:])):
                    with system.open_output_stream(f"{root}/{kind}-{path.rsplit('/', 1)[-1]}") as out:
                        out.write(spoilt)
            yield b.select(["path"])

    container.faces(spark, source).select("path").mapInArrow(spoil, "path string").write.format("noop").mode("overwrite").save()
    return container.diagnostics(container.read(spark, target)).select(F.element_at(F.split("path", "/"), -1).alias("file"), "category")


@query("SELECT n_nationkey AS session_id, count(c_custkey) AS record_count, coalesce(sum(octet_length(encode(c_name))), 0)::BIGINT AS bytes FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def tailed_counts(spark, sf_dir):
    """Streaming: files of both faces tailed to their ends, blocks kept as they come."""
    from ..streaming import tail

    source, kept, at = _written(spark, sf_dir, "binary"), folder(spark), folder(spark)
    q = tail.blocks(spark, source).writeStream.format("parquet").option("path", kept).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    b = spark.read.parquet(kept)
    return tail.session_counts(b).select(F.col("session_id").cast("int").alias("session_id"), "record_count", F.col("bytes").cast("bigint").alias("bytes"))


@query("SELECT n_nationkey AS session_id, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS merge_rank, c_custkey * 3 - 5 AS ts FROM nation JOIN customer ON c_nationkey = n_nationkey")
def tailed_ranks(spark, sf_dir):
    """Streaming: the causal order of sessions, as their end blocks arrive."""
    from ..streaming import tail

    source, kept, at = _written(spark, sf_dir, "jsonl"), folder(spark), folder(spark)
    q = tail.merge_sessions(tail.blocks(spark, source)).writeStream.format("parquet").option("path", kept).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    ranks = spark.read.parquet(kept)
    records = container.tables(container.read(spark, source, kinds=[S.RECORD], payload=False))["records"]
    return ranks.join(records.select("path", "session_id", "block_seq", "ts"), ["path", "session_id", "block_seq"]).select(F.col("session_id").cast("int").alias("session_id"), "merge_rank", "ts")


@query("SELECT n_nationkey AS session_id, 'C3' AS rule, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 4 = 1 GROUP BY ALL UNION ALL SELECT n_nationkey, 'C2', 1 FROM nation WHERE n_nationkey % 4 = 2 UNION ALL SELECT n_nationkey, 'C11', 1 FROM nation WHERE n_nationkey % 10 = 7 UNION ALL SELECT n_nationkey, 'C7', count(*) FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey % 8 = 3 GROUP BY ALL")
def tailed_findings(spark, sf_dir):
    """Streaming: rules C2, C3, C7 and C11 on open sessions: nations without a participant, with two, with an origin beside spans, and in an order that rests on nothing."""
    from ..streaming import tail

    b = _blocks(spark, sf_dir)
    person = (F.col("block_type") == S.PARTICIPANT) & (F.col("session_id") % 4 == 1)
    twice = b.where((F.col("block_type") == S.PARTICIPANT) & (F.col("session_id") % 4 == 2))
    spoilt = {"sequenced_basis": F.when(F.col("session_id") % 10 != 7, F.col("sequenced_basis"))}
    origin = F.struct(F.lit(1).alias("source_id"), F.col("session_id"), F.lit(0).alias("pid"))
    spoilt["origin"] = F.when((F.col("block_type") == S.PARTICIPANT) & (F.col("session_id") % 8 == 3), origin).otherwise(F.col("origin")).cast(S.ORIGIN)
    b, twice = b.withColumns(spoilt), twice.withColumns(spoilt)
    b = b.where(F.col("block_type").isin(S.FILE_HEADER, S.SESSION, S.PARTICIPANT, S.RECORD, S.SESSION_END) & ~person).unionByName(twice)
    source, kept, at = folder(spark), folder(spark), folder(spark)
    container.write(b, source).write.format("noop").mode("overwrite").save()
    q = tail.check_sessions(tail.blocks(spark, source)).writeStream.format("parquet").option("path", kept).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(kept).groupBy(F.col("session_id").cast("int").alias("session_id"), "rule").agg(F.count("*").alias("n"))


# ---- rules, one for each query; an order's lines are the blocks of a file

_SEEN = "b AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS seq, CASE WHEN o_orderkey % 7 = 0 THEN 1 WHEN o_orderkey % 11 = 0 THEN 65 ELSE 32 END AS t FROM orders)"


@query(f"""WITH {_SEEN}, e AS (SELECT k, min(seq) AS stop FROM b WHERE t = 65 GROUP BY k) SELECT k, seq, 'the first block is not a file header' AS message FROM b WHERE seq = 0 AND t <> 1
 UNION ALL SELECT k, seq, 'a second file header' FROM b WHERE seq > 0 AND t = 1 UNION ALL SELECT b.k, seq, 'a block behind the end' FROM b JOIN e USING (k) WHERE seq > stop""")
def rule_header(spark, sf_dir):
    """C1."""
    from pyspark.sql import Window

    at = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint")
    kind = F.when(F.col("o_orderkey") % 7 == 0, S.FILE_HEADER).when(F.col("o_orderkey") % 11 == 0, S.END).otherwise(S.RECORD)
    b = synth.table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), at.alias("block_seq"), kind.alias("block_type"))
    return _of_file(conformance.header_rules(b))


def _of_file(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").cast("bigint").alias("k"), F.col("block_seq").alias("seq"), "message")


def _lines_as_files(spark, sf_dir) -> dict[str, DataFrame]:
    """Records of files (orders): source n % 4 of kinds 0, 1, 5 and 1; a span names source seq % 3; every third line has no span."""
    l = synth.lines(spark, sf_dir).withColumn("path", F.col("k").cast("string"))
    span = F.array(F.struct((F.col("seq") % 3).cast("int").alias("source_id"), F.lit(0).cast("bigint").alias("in_session_id"), F.lit(0).alias("in_pid"), F.col("a").alias("off_start"), F.col("b").alias("off_end")))
    rec = synth.records(
        l.where("f <> 'R'"), "x", block_seq=F.col("seq"), session_id=F.col("k"), sender_pid=F.lit(0), source_id=(F.col("n") % 4).cast("int"), ts=F.col("seq"), payload=F.encode(F.expr("repeat('x', cast(b - a as int))"), "utf-8"),
        spans=F.when(F.col("seq") % 3 < 2, span).otherwise(F.array().cast(synth.SPANS)), decoder_id=F.when(F.col("sk") % 2 == 0, F.lit(1)), content_type=F.when(F.col("n") % 2 == 0, F.concat(F.lit("prim:u"), (F.col("n") * 8).cast("string"))),
    ).withColumn("path", F.col("session_id").cast("string"))
    src = l.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, range(4)))).alias("source_id")).withColumns({"block_seq": F.lit(-10).cast("bigint"), "kind": F.element_at(F.array(F.lit(0), F.lit(1), F.lit(5), F.lit(1)), F.col("source_id") + 1)})
    und = l.where("f = 'R'").select("path", F.col("seq").alias("block_seq"), (F.col("n") % 4).cast("int").alias("source_id"))
    dec = l.select("path").distinct().select("path", F.lit(-9).cast("bigint").alias("block_seq"), F.lit(1).alias("decoder_id"), F.lit(0).alias("output_layer"))
    people = l.select("path", F.col("k").alias("session_id")).distinct()
    origin = F.when(F.col("session_id") % 5 == 0, F.struct((F.col("session_id") % 4).cast("int").alias("source_id"), F.lit(0).cast("bigint").alias("session_id"), F.lit(0).alias("pid")))
    people = people.select("path", F.lit(-5).cast("bigint").alias("block_seq"), "session_id", F.lit(0).alias("pid"), F.lit(None).cast("bigint").alias("isn"), origin.alias("origin"))
    return {"records": rec, "sources": src, "undecoded": und, "decoders": dec, "participants": people}


_KIND_SQL = "CASE n % 4 WHEN 0 THEN 0 WHEN 2 THEN 5 ELSE 1 END"


@query(f"""WITH {LINES} SELECT k, seq, 'source of unknown kind' AS message FROM l WHERE {_KIND_SQL} = 5
 UNION ALL SELECT k, seq, 'a span names a source that is no input file' FROM l WHERE f <> 'R' AND seq % 3 = 0
 UNION ALL SELECT DISTINCT k, -5, 'an origin names a source that is no input file' FROM l WHERE k % 5 = 0 AND k % 4 IN (0, 2)""")
def rule_source_kinds(spark, sf_dir):
    """C5, C6, and C7 of origins."""
    return _of_file(conformance.source_kinds(_lines_as_files(spark, sf_dir)))


@query(f"""WITH {LINES}, i AS (SELECT k, seq FROM l WHERE n % 4 IN (1, 3)), e AS (SELECT DISTINCT k FROM l), m AS (SELECT * FROM i UNION ALL SELECT k, -5 FROM e WHERE k % 5 = 0 AND k % 4 IN (1, 3) UNION ALL SELECT k, 99 FROM e WHERE k % 2 = 0)
 SELECT k, seq, 'the header lacks produced_by or produced_at' AS message FROM m WHERE k % 3 <> 0""")
def rule_derived_header(spark, sf_dir):
    """Every third file says by what and when it was made."""
    t = _lines_as_files(spark, sf_dir)
    k = t["participants"].select("path", F.col("session_id").alias("k"))
    t["headers"] = k.select("path", F.when(F.col("k") % 3 != 1, "stage").alias("produced_by"), F.when(F.col("k") % 3 != 2, 5).alias("produced_at"))
    extent = F.array(F.struct(F.lit(1).alias("source_id"), F.lit(0).alias("in_session_id"), F.lit(0).alias("in_pid"), F.lit(9).alias("extent")))
    t["session_ends"] = k.select("path", F.lit(99).cast("bigint").alias("block_seq"), F.when(F.col("k") % 2 == 0, extent).otherwise(F.slice(extent, 1, 0)).alias("extents"))
    return _of_file(conformance.derived_header(t))


@query(f"""WITH {LINES}, w AS (SELECT k, max(CASE WHEN sk % 2 = 0 THEN 1 ELSE 0 END) AS decoded FROM l WHERE f <> 'R' GROUP BY k) SELECT l.k, max(seq) * 2 + 1 AS seq, 'a break in a transport stream' AS message
 FROM l LEFT JOIN w ON w.k = l.k WHERE n % 3 = 0 AND coalesce(decoded, 0) = 0 GROUP BY l.k""")
def rule_breaks(spark, sf_dir):
    """Breaks behind every line number that three divides, in streams without a decoder."""
    t = _lines_as_files(spark, sf_dir)
    t["discontinuities"] = synth.lines(spark, sf_dir).where("n % 3 = 0").select(F.col("k").cast("string").alias("path"), (F.col("seq") * 2 + 1).alias("block_seq"), F.col("k").alias("session_id"), F.lit(0).alias("pid"))
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"])
    return _of_file(conformance.streams(t, facts).where("rule = 'C10'"))


@query("SELECT o_orderkey AS k, 0 AS seq, 'sequenced without hints or a basis' AS message FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 4)")
def rule_basis(spark, sf_dir):
    """C11: odd orders are sequenced, every third says what by, and a fourth line has a hint."""
    o = synth.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.lit("f").alias("path"))
    s = o.select("path", "session_id", F.lit(0).cast("bigint").alias("block_seq"), (F.col("session_id") % 2).cast("int").alias("flags"), F.when(F.col("session_id") % 3 == 0, "clock").alias("sequenced_basis"))
    r = synth.table(spark, sf_dir, "lineitem").select(F.lit("f").alias("path"), F.col("l_orderkey").alias("session_id"), F.when(F.col("l_linenumber") == 4, 1).cast("bigint").alias("seq_start"), F.lit(None).cast("bigint").alias("ack"))
    found = conformance.basis({"sessions": s.withColumn("path", F.concat("path", F.col("session_id"))), "records": r.withColumn("path", F.concat("path", F.col("session_id")))})
    return found.select(F.substring("path", 2, 30).cast("bigint").alias("k"), F.col("block_seq").cast("int").alias("seq"), "message")


@query(f"""WITH {LINES}, e AS (SELECT k, max(CASE WHEN f <> 'R' AND n % 4 IN (1, 3) THEN 1 ELSE 0 END) AS derived FROM l GROUP BY k)
 SELECT k, 0 AS seq, 'parameters of a transform in a captured file' AS message FROM e WHERE k % 7 = 0 AND derived = 0 AND k % 5 <> 0""")
def rule_params_digest(spark, sf_dir):
    """C14: every seventh file tells the parameters of a transform."""
    t = _lines_as_files(spark, sf_dir)
    t["headers"] = t["participants"].select("path", F.lit(0).cast("bigint").alias("block_seq"), F.when(F.col("session_id") % 7 == 0, "sha256:00").alias("transform_params_digest"))
    return _of_file(conformance.params_digest(t)).withColumn("seq", F.col("seq").cast("int"))


@query(f"""WITH {LINES}, x AS (SELECT k, seq, n, b - a AS len, sk FROM l WHERE f <> 'R' AND n % 2 = 0)
 SELECT k, seq, 'A1' AS rule FROM x WHERE n NOT IN (2, 4) OR len <> n UNION ALL SELECT k, seq, 'A2' FROM x WHERE sk % 2 <> 0""")
def rule_labels(spark, sf_dir):
    """A1, A2: labels prim:u16, u32 and ones that are none, on payloads of up to 50 bytes, and on transport records."""
    return conformance.advisories(_lines_as_files(spark, sf_dir)).select(F.col("path").cast("bigint").alias("k"), F.col("block_seq").alias("seq"), "rule")


# ---- decoders, contents, orders


def _conversations(spark, sf_dir):
    rec = synth.conversation_records(spark, sf_dir)
    facts = offsets.stream_facts(synth.participants(rec), rec, synth.decoders(spark, [("conversations", 1, 0)]), synth.sources(spark, [("conversations", 0, 0, "x")]))
    return rec, facts


_TURNS = f"WITH {CONV}, u AS (SELECT *, row_number() OVER w - 1 AS unit, CAST(sum(n) OVER w AS BIGINT) AS e FROM conv WINDOW w AS (PARTITION BY session_id, pid ORDER BY block_seq))"


@query(_TURNS + """, s AS (SELECT *, CASE WHEN unit > 0 AND unit % 2 = 1 THEN 1 ELSE 0 END AS seam, CASE WHEN unit % 3 = 2 THEN 1 ELSE 0 END AS brk FROM u),
 p AS (SELECT *, sum(1 + seam + brk) OVER (PARTITION BY session_id, pid ORDER BY unit) AS position FROM s)
 SELECT session_id, pid, CAST(position AS BIGINT) AS position, 'record' AS what, CAST(NULL AS BIGINT) AS width, CAST(NULL AS VARCHAR) AS reason FROM p
 UNION ALL SELECT session_id, pid, position - 1, 'break', n, 'hole' FROM p WHERE seam = 1 UNION ALL SELECT session_id, pid, position - 1 - seam, 'break', NULL, 'lost' FROM p WHERE brk = 1""")
def decode_seams(spark, sf_dir):
    """Every second unit does not join the one before; every third has a break of its own ahead."""
    rec, facts = _conversations(spark, sf_dir)

    def decoder(units):
        for i, u in enumerate(units):
            out = {"payload": u["data"], "ts": u["ts"], "cites": (u["off_start"], u["off_end"])}
            out |= {"seam": {"width": len(u["data"]), "reason": "hole"}} if i % 2 else {}
            yield out | ({"discontinuity": {"reason": "lost"}} if i % 3 == 2 else {})

    out = transform.decode_stage(rec, synth.no_breaks(spark), facts, decoder)
    none = F.lit(None)
    records = out["records"].select("session_id", "pid", "position", F.lit("record").alias("what"), none.cast("bigint").alias("width"), none.cast("string").alias("reason"))
    return records.unionByName(out["discontinuities"].select("session_id", "pid", "position", F.lit("break").alias("what"), "width", "reason"))


@query(_TURNS + """ SELECT session_id, pid, unit, e - n + 100 AS seq_start, unit * 7 AS ack, CAST(unit % 4 AS INTEGER) AS flags, CASE WHEN n > 4 THEN 2 ELSE 1 END AS spans, CASE WHEN n > 4 THEN e - 2 ELSE e END AS last_end FROM u""")
def decode_hints(spark, sf_dir):
    """A transport layer's hints and flags, and cites as a pair, as spans, and as a sequence of both."""
    rec, facts = _conversations(spark, sf_dir)

    def decoder(units):
        for i, u in enumerate(units):
            a, b = u["off_start"], u["off_end"]
            cites = [(a, a + 1), [b - 3, b - 2]] if b - a > 4 else [(a, b)] if i % 2 else (a, b)
            yield {"payload": u["data"], "ts": u["ts"], "cites": cites, "flags": i % 4, "hints": {"seq_start": a + 100, "ack": i * 7}}

    out = transform.decode_stage(rec, synth.no_breaks(spark), facts, decoder)["records"]
    return out.select("session_id", "pid", "unit", "seq_start", "ack", "flags", F.size("spans").alias("spans"), F.element_at("spans", -1)["off_end"].alias("last_end"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(CAST('0x' || substr(hex(encode(text)), 1, 2) AS INTEGER) AS VARCHAR) WHEN 1 THEN upper(substr(text, 1, 1)) ELSE substr(text, 1, 1) END AS value
 FROM documents WHERE octet_length(encode(text)) >= 1 AND ascii(substr(text, 1, 1)) < 128""")
def content_values(spark, sf_dir):
    """a primitive, a handler's answer, and the payload itself where neither reads it."""
    registry = content.ContentRegistry()
    registry.register_mime("text/plain", lambda p: F.upper(F.decode(p, "utf-8")))
    d = synth.table(spark, sf_dir, "documents").where("octet_length(text) >= 1 and ascii(text) < 128")
    label = F.element_at(F.array(F.lit("prim:u8"), F.lit("mime:text/plain; q=1"), F.lit("prim:u32"), F.lit("dec:none")), (F.col("doc_id") % 4 + 1).cast("int"))
    read = registry.content(F.encode(F.substring("text", 1, 1), "utf-8"), label)
    return d.select("doc_id", F.decode(read, "utf-8").alias("value"))


@query(f"""WITH {LINES}, d AS (SELECT *, seq % 2 AS pid FROM l) SELECT k, seq, row_number() OVER (ORDER BY k, seq) AS block_seq FROM d""")
def linearized(spark, sf_dir):
    """Dialogues written side by side, each side in its own order, put in causal order for the file."""
    from .queries import _two_sided

    rec = _two_sided(spark, sf_dir).withColumn("ts_first", F.col("block_seq"))
    apart = rec.withColumn("block_seq", F.col("sender_pid") * 1_000_000 + F.col("block_seq"))
    return transform.linearize(apart).select(F.col("session_id").alias("k"), F.col("ts_first").alias("seq"), "block_seq")


@query(f"""WITH {LINES}, d AS (SELECT *, seq % 2 AS pid, b - a AS len FROM l) SELECT k, seq AS block_seq, seq AS merge_rank FROM d""")
def merge_without_payload(spark, sf_dir):
    """The ranks alone."""
    from .queries import _two_sided

    return order.merge_ranks(_two_sided(spark, sf_dir)).select(F.col("session_id").alias("k"), "block_seq", "merge_rank")
