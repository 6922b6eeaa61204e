"""Scans of containers: batch, and tailing of files that grow.

A batch scan lists files on the driver and no more.  Tasks walk the block headers
or the lines of files above ``split`` bytes and cut them into parts of whole
blocks, each of which is read by a task of its own.  The data source of the same name reads a file in a task.  A stream's offset is, for
each file, the byte behind its last whole block or line, and how many there are
before it, so a cut tail waits for the next micro-batch.
"""

from __future__ import annotations

import io
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schema as S
from . import codec, jsonl

NAME = "payload_blocks"
ROWS = 1000
#: Larger binary files are read by several tasks.
SPLIT = 256 << 20


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def files(uri: str) -> list[str]:
    """The file, or the files below the folder; names that begin with . or _ are not data."""
    from pyarrow import fs

    system, path = filesystem(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [path]
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def face_of(head: bytes) -> str:
    if head[8:12] == S.MAGIC.to_bytes(4, "little"):
        return "binary"
    if head.lstrip()[:1] == b"{":
        return "jsonl"
    raise codec.Broken("neither face of a container")


def rows_of(source, *, strict: bool = False, kinds: frozenset[int] | None = None):
    """Wide rows of an open file of either face."""
    face = face_of(source.read(12))
    source.seek(0)
    if face == "binary":
        yield from codec.scan(source, strict=strict, kinds=kinds)
    else:
        text = io.TextIOWrapper(source, encoding="utf-8", errors="strict", newline="\n")
        for row in jsonl.scan(iter(text.readline, ""), strict=strict):
            if kinds is None or row["block_type"] is None or row["block_type"] in kinds:
                yield row


def _safe(rows, strict: bool):
    """rows; where a file cannot be read on, a diagnostic of that file ends them, unless ``strict``."""
    try:
        yield from rows
    except codec.Broken as e:
        if strict:
            raise
        yield codec.diagnostic("broken-file", str(e), None)


def _batches(rows, path: str, payload: bool = True):
    held = []
    for r in rows:
        r = r | {"path": path} if payload else r | {"path": path, "payload": None}
        held.append(r)
        if len(held) == ROWS or len(r.get("payload") or b"") > 1 << 20:
            yield codec.batch(held)
            held = []
    if held:
        yield codec.batch(held)


def parts_of(source, size: int, split: int):
    """(first byte, lines and blocks before it, end or None) of parts of whole blocks, found by their lengths or ends alone."""
    if size <= split:
        return [(0, 0, 0, None)]
    head = source.read(12)
    if head.lstrip()[:1] == b"{":
        source.seek(0)
        return _line_parts(source, size, split)
    if head[8:12] != S.MAGIC.to_bytes(4, "little"):
        return [(0, 0, 0, None)]
    out, begin, first, at, seq = [], 0, 0, 0, 0
    while at + 8 <= size:
        source.seek(at)
        kind, _, n = codec.FRAME.unpack(source.read(8))
        if at - begin >= split:
            out.append((begin, 0, first, at))
            begin, first = at, seq
        if kind == S.END or n % 4 or at + 8 + n > size:
            break  # what stands here and behind is judged by the last part
        at, seq = at + 8 + n, seq + 1
    return [*out, (begin, 0, first, None)]


def _line_parts(source, size: int, split: int):
    out, begin, before, at, lines, seq = [], 0, (0, 0), 0, 0, 0
    for line in _lines(source, size):
        if at - begin >= split:
            out.append((begin, *before, at))
            begin, before = at, (lines, seq)
        if b'"end"' in line and _ends(line):
            break  # what stands behind is judged by the last part
        at, lines, seq = at + len(line), lines + 1, seq + bool(line.strip())
    return [*out, (begin, *before, None)]


def _ends(line: bytes) -> bool:
    try:
        return jsonl.loads(line.decode())[0]["block_type"] == S.END
    except ValueError:
        return False


def read_part(system, path: str, at: int, lines: int, seq: int, end: int | None, strict: bool, kinds=None):
    with system.open_input_file(path) as source:
        if not at and end is None:
            yield from rows_of(source, strict=strict, kinds=kinds)
            return
        binary = face_of(source.read(12)) == "binary"
        source.seek(at)
        if not binary:
            size = (end if end is not None else source.size()) - at
            text = (line.decode() for line in _lines(source, size, rest=end is None))
            for row in jsonl.scan(text, strict=strict, number=lines, seq=seq, last=end is None):
                if kinds is None or row["block_type"] is None or row["block_type"] in kinds:
                    yield row
            return
        rows = codec.scan(source, strict=strict, at=at, seq=seq, kinds=kinds)
        # a diagnostic without a place belongs to the part that met it
        yield from rows if end is None else itertools.takewhile(lambda r: r["offset"] is None or r["offset"] < end, rows)


def scan(spark: SparkSession, uri: str, *, strict: bool = False, split: int = SPLIT, kinds: frozenset[int] | None = None, payload: bool = True) -> DataFrame:
    """Wide rows of all containers below ``uri``.

    ``kinds`` are the block types wanted: others are passed over unparsed, and
    what is wrong in them is not told; without ``payload`` payloads stay behind.
    """
    system, _ = filesystem(uri)
    found = [(path, system.get_file_info(path).size) for path in files(uri)]
    if not found:
        return spark.createDataFrame([], S.BLOCK_SCHEMA)

    def walk(batches):
        system, _ = filesystem(uri)
        for batch in batches:
            out = []
            for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(path) as source:
                    out += [(path, *part) for part in parts_of(source, size, split)]
            if out:
                names = ["path", "begin", "lines", "first", "stop"]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i else pa.string()) for i, v in enumerate(zip(*out, strict=True))], names=names)

    def read(batches):
        system, _ = filesystem(uri)
        for batch in batches:
            for path, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from _batches(_safe(read_part(system, path, *part, strict, kinds), strict), path, payload)

    here = 4 * spark.sparkContext.defaultParallelism
    listing = spark.createDataFrame(found, "path string, size long").repartition(min(len(found), max(here, len(found) // 1000)))
    tasks = max(min(len(found), here), sum(size for _, size in found) // split + 1)
    return listing.mapInArrow(walk, "path string, begin long, lines long, first long, stop long").repartition(tasks, "path", "begin").mapInArrow(read, S.BLOCK_SCHEMA)


class BlockSource(DataSource):
    """Option ``path``: a file or folder; ``strict``: a violation fails the job instead of becoming a diagnostic."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return S.BLOCK_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options):
        self.uri, self.strict = options["path"], options.get("strict", "false").lower() == "true"

    def partitions(self):
        return [InputPartition(path) for path in files(self.uri)]

    def read(self, partition):
        system, _ = filesystem(self.uri)
        yield from _batches(_safe(read_part(system, partition.value, 0, 0, 0, None, self.strict), self.strict), partition.value)


class _Tail(DataSourceStreamReader):
    """Files of both faces; what is behind the last whole block or line waits."""

    def __init__(self, options):
        self.uri = options["path"]
        self.last: dict[str, list[int]] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        system, _ = filesystem(self.uri)
        out = {}
        for path in files(self.uri):
            at, seq = self.last.get(path, [0, 0])
            size = system.get_file_info(path).size
            with system.open_input_file(path) as source:
                if size < 12 or face_of(source.read(12)) == "binary":
                    while at + 8 <= size:
                        source.seek(at)
                        _, _, n = codec.FRAME.unpack(source.read(8))
                        if at + 8 + n > size:
                            break
                        at, seq = at + 8 + n, seq + 1
                else:
                    source.seek(at)
                    for line in _lines(source, size - at):
                        at, seq = at + len(line), seq + 1
            out[path] = [at, seq]
        self.last = out
        return out

    def partitions(self, start, end):
        return [InputPartition((p, *start.get(p, [0, 0]), to)) for p, (to, _) in end.items() if to > start.get(p, [0, 0])[0]]

    def read(self, partition):
        path, at, seq, end = partition.value
        system, _ = filesystem(self.uri)

        def blocks(source):
            nonlocal at, seq
            while at < end:
                kind, _, n = codec.FRAME.unpack(source.read(8))
                content = source.read(n)
                try:
                    row = codec.parse_content(kind, content)
                except ValueError as e:
                    row = {"block_type": kind, "content": content, "parse_error": f"invalid-block: {e}"}
                yield row | {"offset": at, "block_seq": seq}
                at, seq = at + 8 + n, seq + 1

        def lines(source):
            for i, line in enumerate(_lines(source, end - at), start=seq):
                if line.strip():
                    try:
                        yield jsonl.loads(line.decode())[0] | {"offset": i + 1, "block_seq": i}
                    except ValueError as e:
                        yield codec.diagnostic("invalid-line", str(e), i + 1)

        def rows():
            with system.open_input_file(path) as source:
                binary = face_of(source.read(12)) == "binary"
                source.seek(at)
                yield from blocks(source) if binary else lines(source)

        yield from _batches(rows(), path)

    def commit(self, end):
        pass


def _lines(source, size: int, *, rest: bool = False):
    """The whole lines, with their ends, of the next ``size`` bytes; with ``rest`` also what stands behind the last end."""
    held = []
    while size > 0:
        piece = source.read(min(size, 1 << 20))
        if not piece:
            break
        size -= len(piece)
        first, *more = piece.split(b"\n")
        held.append(first)
        if more:
            yield b"".join(held) + b"\n"
            for line in more[:-1]:
                yield line + b"\n"
            held = [more[-1]]
    if rest and any(held):
        yield b"".join(held)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockSource)
