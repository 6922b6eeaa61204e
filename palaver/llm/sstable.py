"""Operator 4 - token ids in sorted-string-table shards.

A shard holds documents in ascending order of id::

    block*  : entries; an entry is  u8 shared, u8 rest, key[rest], u32 n, ids[n]
    index   : for each block its first key (9 bytes), u64 offset, u32 bytes, u32 crc32
    bloom   : bits, 10 for a key, 7 probes
    footer  : fixed size, see FOOTER; ends with the magic

A key is 9 bytes: 0 and the id, big-endian with the sign bit flipped, so that
bytes sort as ids do; a null id is a 1 and zeros and comes last.  ``shared``
bytes are those of the entry before; a block's first entry shares none.  Ids
take 2 bytes where the vocabulary allows, else 4.  All numbers else are
little-endian.

Documents are dealt by ranges of ids, rows that repeat an id by ranges of their
text's hash and of their place in the input, so neither one id nor the null ids
gather in a task.  A task streams its range to one file, under a name of its own
attempt that is renamed when whole, so a lost task or a second attempt leaves
the same file.  Blocks are the unit of memory.  Where a shard's ids stand among
all ids is read from the footers of the files, of which one row each comes to
the driver.

Cases: null text is empty (the end id alone); rows that repeat an id are all
kept, next to each other; null ids come last; an empty table gives no files and
no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import groups_for, shared_folder
from .tokens import SLICE, closed, default_vocabulary, encoder

END = 2
#: Stored bytes of documents in a shard, more where there would be over MOST_SHARDS, whose rows the driver lists; and bytes of a block.
SHARD_BYTES, MOST_SHARDS, BLOCK_BYTES = 8 << 20, 200_000, 64 << 10
BITS, PROBES = 10, 7
MAGIC = b"PALSST01"
FOOTER = struct.Struct("<QQQQQQBI8s")  # documents, ids, index at, index bytes, bloom at, bloom bytes, width, crc32 of index, bloom and these, magic
_INDEX = struct.Struct("<9sQII")
NULL_KEY = b"\x01" + bytes(8)


def key_of(doc_id: int | None) -> bytes:
    return NULL_KEY if doc_id is None else b"\x00" + ((doc_id + (1 << 63)) & (1 << 64) - 1).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 9)
        x = np.ascontiguousarray(raw[:, 1:]).view("<u8").ravel() ^ (raw[:, 0].astype(np.uint64) << np.uint64(32))
        one, two = tk.mix(x + np.uint64(1)), tk.mix(x ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        return np.stack([(one + np.uint64(i) * two) % np.uint64(bits) for i in range(PROBES)])


class ShardWriter:
    def __init__(self, sink, width: int):
        self.sink, self.kind, self.width = sink, "<u2" if width == 2 else "<u4", width
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.at, self.index, self.keys, self.ids = 0, [], [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.last > key:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        body = ids.astype(self.kind).tobytes()
        self.block += [bytes((shared, 9 - shared)) + key[shared:] + struct.pack("<I", len(ids)), body]
        self.size += len(body) + 15 - shared
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.sink.write(data)
            self.index.append(_INDEX.pack(self.first, self.at, len(data), zlib.crc32(data)))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BITS * len(self.keys) + 7 & ~7)
        bloom = np.zeros(bits, bool)
        if self.keys:
            bloom[_probes(self.keys, bits).astype(np.int64)] = True
        bloom = np.packbits(bloom, bitorder="little").tobytes()
        self.sink.write(index + bloom)
        fields = (len(self.keys), self.ids, self.at, len(index), self.at + len(index), len(bloom), self.width)
        crc = zlib.crc32(index + bloom + FOOTER.pack(*fields, 0, MAGIC))
        self.sink.write(FOOTER.pack(*fields, crc, MAGIC))


class ShardReader:
    """Random access to one shard file (anything with read, seek and size)."""

    def __init__(self, source, size: int):
        self.source = source
        foot = self._read(size - FOOTER.size, FOOTER.size)
        *fields, crc, magic = FOOTER.unpack(foot)
        self.documents, self.ids, at, n, _, bloom_n, width = fields
        if magic != MAGIC or at + n + bloom_n + FOOTER.size != size:
            raise ValueError("not a whole shard")
        tail = self._read(at, n + bloom_n)
        if zlib.crc32(tail + FOOTER.pack(*fields, 0, MAGIC)) != crc:
            raise ValueError("not a whole shard")
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.index = [_INDEX.unpack_from(tail, i) for i in range(0, n, _INDEX.size)]
        self.bloom = np.frombuffer(tail[n:], np.uint8)

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def may_hold(self, key: bytes) -> bool:
        p = _probes([key], len(self.bloom) * 8).ravel().astype(np.int64)
        return bool((self.bloom[p >> 3] >> (p & 7) & 1).all())

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, crc = self.index[i]
        data = self._read(at, n)
        if zlib.crc32(data) != crc:
            raise ValueError("broken block")
        p, key = 0, b""
        while p < n:
            shared, rest = data[p], data[p + 1]
            key = key[:shared] + data[p + 2 : p + 2 + rest]
            p += 2 + rest
            (count,) = struct.unpack_from("<I", data, p)
            yield key, np.frombuffer(data, self.kind, count, p + 4)
            p += 4 + count * self.kind.itemsize

    def __iter__(self):
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all rows of this document: Bloom filter, binary search over the index, then blocks."""
        key = key_of(doc_id)
        if not self.documents or not self.may_hold(key):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block that begins at the key or beyond
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        out = []
        for i in range(max(0, lo - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            out += [ids for k, ids in self.block(i) if k == key]
        return out


def filesystem(uri: str):
    """The file system of a folder and the path in it: any that pyarrow reaches (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class Shards:
    folder: str
    table: list[tuple[str, int, int]]  # name, documents, ids, as the footers say; in ascending order of document ids

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Shards:
        """The shards of a folder, by their names and footers."""
        from pyarrow import fs

        system, root = filesystem(folder)
        if system.get_file_info(root).type == fs.FileType.NotFound:
            return Shards(folder, [])
        names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".sst") and f.base_name[0] != ".")
        if not names:
            return Shards(folder, [])
        files = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(len(names), 256))
        rows = files.mapInArrow(_footers(folder), "name string, documents long, ids long").collect()
        return Shards(folder, sorted(tuple(r) for r in rows))

    def base(self) -> dict[str, int]:
        """Ids in all shards before."""
        out, total = {}, 0
        for name, _, ids in self.table:
            out[name] = total
            total += ids
        return out


def _footers(folder: str):
    def run(batches):
        system, root = filesystem(folder)
        for batch in batches:
            names, documents, ids = batch.column(0).to_pylist(), [], []
            for name in names:
                with system.open_input_file(f"{root}/{name}") as source:
                    shard = ShardReader(source, source.size())
                documents.append(shard.documents)
                ids.append(shard.ids)
            yield pa.RecordBatch.from_pydict({"name": names, "documents": pa.array(documents, pa.int64()), "ids": pa.array(ids, pa.int64())})

    return run


def _write(folder: str, vocabulary: str, end: int):
    def run(batches):
        task = encoder(vocabulary)
        width = 2 if max(task.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        number, writer, sink = TaskContext.get().partitionId(), None, None
        system, root = filesystem(folder)
        name = f"shard-{number:06d}.sst"
        own = f"{root}/.{name}.{uuid.uuid4().hex}"
        for batch in batches:
            keys = [key_of(x) for x in batch.column(0).to_pylist()]
            raw, offsets = tk.string_buffers(batch.column(1))
            for i, j in tk.slices(offsets, SLICE):
                if writer is None:
                    system.create_dir(root, recursive=True)
                    sink = system.open_output_stream(own)
                    writer = ShardWriter(sink, width)
                ids, first = closed(*task.encode(*tk.part(raw, offsets, i, j)), end)
                for k in range(j - i):
                    writer.add(keys[i + k], ids[first[k] : first[k + 1]])
        if writer is not None:
            writer.close()
            sink.close()
            system.move(own, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    return run


def write_shards(docs: DataFrame, *, folder: str | None = None, vocabulary: str | None = None, end: int = END, shard_bytes: int = SHARD_BYTES) -> Shards:
    """Encodes all documents into shards in ascending order of id."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = min(groups_for(plain, shard_bytes), MOST_SHARDS)
    order = [F.col("doc_id").asc_nulls_last(), F.col("hash"), F.col("place")]
    placed = plain.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    dealt = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_write(folder, vocabulary or default_vocabulary(), end), "name string").write.format("noop").mode("overwrite").save()
    return Shards.open(spark, folder)


def _scan(folder: str, base: dict[str, int]):
    def run(batches):
        system, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path, at = f"{root}/{name}", base[name]
                with system.open_input_file(path) as source:
                    shard = ShardReader(source, source.size())
                    for b in range(len(shard.index)):
                        doc, start, count, crc = [], [], [], []
                        for key, ids in shard.block(b):
                            doc.append(id_of(key))
                            start.append(at)
                            count.append(len(ids))
                            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                            at += len(ids)
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(count, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def scan_shards(spark: SparkSession, shards: Shards) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, read from the files."""
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards.table:
        return spark.createDataFrame([], kinds)
    files = spark.createDataFrame([(name,) for name, _, _ in shards.table], "name string")
    return files.repartition(len(shards.table)).mapInArrow(_scan(shards.folder, shards.base()), kinds)
