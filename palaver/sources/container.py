"""Containers as tables: reading, building, writing, converting."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..stages import cut
from . import codec, datasource, jsonl


def read(spark: SparkSession, path: str, *, strict: bool = False, split: int = datasource.SPLIT, kinds: list[int] | None = None, payload: bool = True) -> DataFrame:
    """Wide rows of all containers below a path, of either face; a diagnostic is a row without block type.

    A file that cannot be read on ends in a diagnostic ``broken-file`` and leaves
    the others alone; with ``strict`` it fails the job.  ``kinds`` (block types)
    and ``payload`` leave out what a question does not need.
    """
    return datasource.scan(spark, path, strict=strict, split=split, kinds=None if kinds is None else frozenset(kinds), payload=payload)


def load(spark: SparkSession, path: str, **how) -> DataFrame:
    """read(), parsed once: what many rules and operators look at is kept in the checkpoint folder."""
    return cut(read(spark, path, **how))


def _signed(x: Column) -> Column:
    """Ids as BIGINT with the same 64 bits, so that ids from 2**63 on are negative and none is lost."""
    top = F.lit(str(1 << 63)).cast("decimal(20,0)")
    whole = F.lit(str(1 << 64)).cast("decimal(20,0)")
    wide_ = x.cast("decimal(20,0)")
    return F.when(wide_ >= top, wide_ - whole).otherwise(wide_).cast("bigint")


def unsigned(x: Column) -> Column:
    """The id that such a BIGINT stands for."""
    wide_ = x.cast("decimal(20,0)")
    return F.when(wide_ < 0, wide_ + F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(wide_).cast("decimal(20,0)")


#: Ids of sessions, alone and inside structs.
_IDS = {"session_id": None, "origin": "session_id", "spans": "in_session_id", "extents": "in_session_id"}


def _with_ids(column: str, how) -> Column:
    x, inner = F.col(column), _IDS.get(column)
    if column == "session_id":
        return how(x)
    if column == "origin":
        return F.when(x.isNotNull(), x.withField(inner, how(x[inner])))
    if column in ("spans", "extents"):
        return F.transform(x, lambda e: e.withField(inner, how(e[inner])))
    return x


def _narrow(column: str) -> Column:
    """BIGINT for unsigned 64-bit numbers: ids keep their 64 bits, larger offsets and rates fail the cast."""
    if column == "session_id":
        return _signed(F.col(column))
    if S.BLOCK_COLUMNS[column] == "decimal(20,0)":
        return F.col(column).cast("bigint")
    x = _with_ids(column, _signed)
    if column == "spans":
        return x.cast("array<struct<source_id:int,in_session_id:bigint,in_pid:int,off_start:bigint,off_end:bigint>>")
    if column == "extents":
        return x.cast("array<struct<source_id:int,in_session_id:bigint,in_pid:int,extent:bigint>>")
    if column == "origin":
        return x.cast("struct<source_id:int,session_id:bigint,pid:int>")
    return x


def tables(blocks: DataFrame, *, narrow: bool = True) -> dict[str, DataFrame]:
    """All tables of schema.TABLES; headers know whether their file is complete or truncated."""
    good = blocks.where("parse_error is null")
    out = {}
    for name, (kind, columns) in S.TABLES.items():
        renamed = S.RENAMED.get(name, {})
        rest = ["comment", "extra_options"] if name != "custom_blocks" else []
        picked = [(_narrow(c) if narrow else F.col(c)).alias(renamed.get(c, c)) for c in columns]
        out[name] = good.where(F.col("block_type") == kind).select("path", "block_seq", *picked, *rest)
    known = [k for k, _ in S.TABLES.values()]
    out["unknown_blocks"] = good.where(F.col("block_type").isNotNull() & ~F.col("block_type").isin(known)).select("path", "block_seq", "block_type", "content")
    state = blocks.groupBy("path").agg(
        F.max((F.col("block_type") == S.END).cast("int")).alias("complete"), F.max(F.coalesce(F.col("parse_error").startswith("truncated"), F.lit(False)).cast("int")).alias("truncated")
    )
    flags = state.select("path", F.coalesce(F.col("complete") == 1, F.lit(False)).alias("complete"), (F.col("truncated") == 1).alias("truncated"))
    out["headers"] = out["headers"].join(flags, "path", "left")
    return out


def diagnostics(blocks: DataFrame) -> DataFrame:
    """(path, offset, category, message) of what could not be read."""
    text = F.col("parse_error")
    return blocks.where("parse_error is not null").select("path", "offset", F.substring_index(text, ": ", 1).alias("category"), F.expr("substring(parse_error, instr(parse_error, ': ') + 2)").alias("message"))


def wide(df: DataFrame) -> DataFrame:
    """df with every column of the wide schema, those it lacks null; ids are unsigned again."""
    kinds = dict(df.dtypes)
    again = lambda c: _with_ids(c, unsigned) if c in _IDS and kinds[c] != "void" else F.col(c)
    return df.select(*[(again(c) if c in kinds else F.lit(None)).cast(t).alias(c) for c, t in S.BLOCK_COLUMNS.items()])


def union(parts: list[DataFrame]) -> DataFrame:
    """Blocks in the order of (path, turn, block_seq): block_seq becomes their place in the file."""
    all_ = None
    for turn, df in enumerate(parts):
        one = wide(df).withColumn("__turn", F.lit(turn))
        all_ = one if all_ is None else all_.unionByName(one)
    place = F.row_number().over(Window.partitionBy("path").orderBy("__turn", "block_seq", "session_id", "pid")) - 1
    return all_.withColumn("block_seq", place.cast("bigint")).drop("__turn")


def from_payloads(df: DataFrame, *, session: str, sender: Column, order: str, payload: Column, label: Column | None = None, tick_hz: int = 1000, produced_by: str = "palaver", files: int = 8) -> DataFrame:
    """Wide rows of well-formed containers, ``files`` of them, made from rows of payloads.

    One capture source and one decoder in each; sessions by the hash of their id;
    declarations first, an end for each session, and the end block.
    """
    path = F.concat(F.lit("file-"), F.pmod(F.xxhash64(session), F.lit(files)).cast("string"))
    rec = df.select(
        path.alias("path"), F.col(session).cast("decimal(20,0)").alias("session_id"), sender.cast("int").alias("pid"), F.col(order).cast("bigint").alias("block_seq"), F.col(order).cast("bigint").alias("ts"),
        payload.alias("payload"), (label if label is not None else F.lit(None)).cast("string").alias("content_type"), F.lit(0).alias("source_id"), F.lit(1).alias("decoder_id"), F.lit(0).alias("flags"), F.lit(S.RECORD).alias("block_type"),
    )
    one = rec.select("path").distinct()
    first = one.withColumns({"block_type": F.lit(S.FILE_HEADER), "version_major": F.lit(S.VERSION[0]), "version_minor": F.lit(S.VERSION[1]), "tick_hz": F.lit(tick_hz).cast("decimal(20,0)"), "creator": F.lit(produced_by), "flags": F.lit(0)})
    source = one.withColumns({"block_type": F.lit(S.SOURCE), "source_id": F.lit(0), "kind": F.lit(S.CAPTURE), "uri": F.lit("rows")})
    decoder = one.withColumns({"block_type": F.lit(S.DECODER), "decoder_id": F.lit(1), "output_layer": F.lit(S.DECODED), "name": F.lit("rows")})
    sessions = rec.select("path", "session_id").distinct()
    begin = sessions.withColumns({"block_type": F.lit(S.SESSION), "flags": F.lit(0)})
    people = rec.select("path", "session_id", "pid").distinct().withColumn("block_type", F.lit(S.PARTICIPANT))
    ends = sessions.withColumn("block_type", F.lit(S.SESSION_END))
    last = one.withColumn("block_type", F.lit(S.END))
    return union([first, source, decoder, begin, people, rec, ends, last])


def write(blocks: DataFrame, folder: str, *, face: str = "binary") -> DataFrame:
    """Writes each path of wide rows as one file of that name in folder; one row for each: path, file, bytes, blocks.

    A file is one task's: its blocks are streamed in order, under a name of the
    attempt's own, renamed when whole.
    """
    lines = face == "jsonl"
    frames = (jsonl.encode(blocks) if lines else codec.encode(blocks)).toDF("path", "block_seq", "data")
    dealt = frames.repartition("path").sortWithinPartitions("path", "block_seq")

    def run(batches):
        import uuid

        system, root = datasource.filesystem(folder)
        system.create_dir(root, recursive=True)
        sink = now = own = None
        size = count = 0

        def close():
            sink.close()
            system.move(own, f"{root}/{now}")
            return pa.RecordBatch.from_pydict({"path": [now], "file": [f"{folder.rstrip('/')}/{now}"], "bytes": pa.array([size], pa.int64()), "blocks": pa.array([count], pa.int64())})

        for b in batches:
            for path, data in zip(b.column("path").to_pylist(), b.column("data").to_pylist(), strict=True):
                if path != now:
                    if sink is not None:
                        yield close()
                    now, own, size, count = path, f"{root}/.{path}.{uuid.uuid4().hex}", 0, 0
                    sink = system.open_output_stream(own)
                data = f"{data}\n".encode() if lines else data
                sink.write(data)
                size, count = size + len(data), count + 1
        if sink is not None:
            yield close()

    return dealt.mapInArrow(run, "path string, file string, bytes bigint, blocks bigint")


def convert(spark: SparkSession, source: str, folder: str, *, face: str) -> tuple[DataFrame, DataFrame]:
    """Files of one face written as the other; what was written, and what could not be carried over."""
    blocks = read(spark, source)
    named = blocks.withColumn("path", F.element_at(F.split("path", "/"), -1))
    return write(named, folder, face=face), diagnostics(blocks)


def _each_file(spark: SparkSession, path: str, look, column: str) -> DataFrame:
    """(path, column): what ``look`` says of each open file below path; files are dealt to tasks and listed on the driver."""

    def run(batches):
        system, _ = datasource.filesystem(path)
        for batch in batches:
            out = []
            for name in batch.column(0).to_pylist():
                with system.open_input_file(name) as source:
                    out.append(look(source))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["path", column])

    found = datasource.files(path)
    listing = spark.createDataFrame([(f,) for f in found], "path string")
    return listing.repartition(max(1, min(len(found), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, f"path string, {column} string")


def digests(spark: SparkSession, path: str, algorithm: str = "sha256") -> DataFrame:
    """(path, digest) of whole files, read piece by piece."""
    import hashlib

    hashlib.new(algorithm)  # fails here for unknown ones, not on executors

    def look(source):
        h = hashlib.new(algorithm)
        while piece := source.read(8 << 20):
            h.update(piece)
        return f"{algorithm}:{h.hexdigest()}"

    return _each_file(spark, path, look, "digest")


def faces(spark: SparkSession, path: str) -> DataFrame:
    """(path, face): binary by its magic, else jsonl by its first character, else null; the first bytes of each file are read."""

    def look(source):
        head = source.read(64)
        return "binary" if head[8:12] == S.MAGIC.to_bytes(4, "little") else "jsonl" if head.lstrip()[:1] == b"{" else None

    return _each_file(spark, path, look, "face")


def self_inputs(t: dict[str, DataFrame]) -> DataFrame:
    """Files whose input is the file itself."""
    inputs = t["sources"].where(F.col("kind") == S.FILE_INPUT)
    name = F.element_at(F.split("path", "/"), -1)
    here = F.regexp_replace("uri", r"^(\./)+", "")
    return inputs.where((here == name) | (F.col("uri") == F.col("path"))).select("path", "block_seq", "source_id", "uri")


#: Longer chains of inputs are refused; a file that leads back to itself would never end.
MOST_HOPS = 32


def open_inputs(spark: SparkSession, path: str, *, resolve=None) -> tuple[DataFrame, DataFrame]:
    """(blocks, files): a container with all that its sources name, and theirs, and the catalogue (uri, path) that opened them.

    ``resolve`` (uri, path of the file that names it) gives the path of an input, or
    None for one that cannot be opened; by default a relative uri is next to the
    file that names it.  What one file names is bounded by its ids, and comes to
    the driver file by file up the chain.
    """
    resolve = resolve or (lambda uri, near: uri if "/" in uri and (uri.startswith("/") or "://" in uri) else f"{near.rsplit('/', 1)[0]}/{uri}")
    blocks = load(spark, path)
    seen, todo, files = {r.path for r in blocks.select("path").distinct().collect()}, blocks, set()
    for _ in range(MOST_HOPS):
        named = todo.where((F.col("block_type") == S.SOURCE) & (F.col("kind") == S.FILE_INPUT) & F.col("uri").isNotNull()).select("uri", "path").distinct()
        new, todo = set(), None
        for uri, near in ((r.uri, r.path) for r in named.collect()):
            target = resolve(uri, near)
            if target is not None:
                files.add((uri, target))
                new.add(target)
        for target in sorted(new - seen):
            one = load(spark, target)
            todo = one if todo is None else todo.unionByName(one)
        seen |= new
        if todo is None:
            return blocks, spark.createDataFrame(sorted(files), "uri string, path string")
        blocks = blocks.unionByName(todo)
    raise ValueError("the chain of files is too long")
