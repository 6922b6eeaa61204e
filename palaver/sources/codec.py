"""Blocks as bytes: frames, bodies and options.

A frame is u16 type, u16 0, u32 length, then the content, a multiple of four
long.  A content is a fixed body and options (u16 id, u16 length, the value,
zeros up to a multiple of four).  What cannot be understood is kept: options
that are unknown, malformed or one too many in ``extra_options``, unknown blocks
by their content.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame

from .. import schema as S

FRAME = struct.Struct("<HHI")
_OPTION = struct.Struct("<HH")
_SPAN, _EXTENT, _ORIGIN = struct.Struct("<HHQQQ"), struct.Struct("<HHQQ"), struct.Struct("<HHQ")
_NUMBERS = {"u8": "<B", "u16": "<H", "u32": "<I", "u64": "<Q", "i64": "<q"}
MOST = 0xFFFF

# Fixed values of the format: bodies, and options by id with the kind of their value.
BODIES = {
    S.FILE_HEADER: ("<IHHQ", ["magic", "version_major", "version_minor", "tick_hz"]),
    S.SOURCE: ("<HBB", ["source_id", "kind", "_"]),
    S.DECODER: ("<HBB", ["decoder_id", "output_layer", "_"]),
    S.SESSION: ("<Q", ["session_id"]),
    S.PARTICIPANT: ("<QHH", ["session_id", "pid", "_"]),
    S.SESSION_END: ("<Q", ["session_id"]),
    S.RECORD: ("<QHHqHHI", ["session_id", "pid", "source_id", "ts", "_", "flags", "payload_len"]),
    S.UNDECODED: ("<HHQQQ", ["source_id", "pid", "session_id", "off_start", "off_end"]),
    S.DISCONTINUITY: ("<QHH", ["session_id", "pid", "_"]),
    S.NAME: ("<QHH", ["session_id", "pid", "_"]),
    S.END: ("<I", ["magic"]),
    S.CUSTOM: ("<IHH", ["pen", "subtype", "_"]),
}
OPTIONS = {
    S.FILE_HEADER: {0x10: ("time_epoch", "i64"), 0x11: ("creator", "str"), 0x12: ("produced_by", "str"), 0x13: ("produced_at", "i64"), 0x14: ("flags", "u16"), 0x15: ("transform_params_digest", "str")},
    S.SOURCE: {0x20: ("uri", "str"), 0x21: ("digest", "str"), 0x22: ("link_type", "u16")},
    S.DECODER: {0x41: ("name", "str"), 0x42: ("version", "str"), 0x43: ("params_digest", "str")},
    S.SESSION: {0x50: ("proto", "str"), 0x51: ("flow_key", "str"), 0x52: ("flags", "u16"), 0x53: ("sequenced_basis", "str"), 0x54: ("external_session_id", "bytes")},
    S.PARTICIPANT: {0x60: ("endpoints", "strs"), 0x61: ("isn", "u32"), 0x62: ("identity", "str"), 0x63: ("tcp_role", "u8"), 0x64: ("origin", "origin")},
    S.SESSION_END: {0xC0: ("reason", "str"), 0xC1: ("extents", "extents")},
    S.RECORD: {0x70: ("seq_start", "u32"), 0x72: ("ack", "u32"), 0x73: ("ts_first", "i64"), 0x80: ("spans", "spans"), 0x90: ("decoder_id", "u16"), 0x91: ("content_type", "str")},
    S.UNDECODED: {0x90: ("decoder_id", "u16"), 0xA0: ("reason", "str"), 0xA1: ("reason_class", "str")},
    S.DISCONTINUITY: {0xD0: ("width", "u64"), 0xD1: ("reason", "str")},
    S.NAME: {0xB0: ("label", "str"), 0xB1: ("label_kind", "str")},
    S.END: {},
}
COMMENT = 0x01
# End of fixed values.

#: Flags that are not written when zero, and are zero when not there.
_FLAG_BLOCKS = (S.FILE_HEADER, S.SESSION)
_DECIMALS = {c for c, t in S.BLOCK_COLUMNS.items() if t == "decimal(20,0)"}


class Broken(ValueError):
    """The container's structure is broken; nothing behind can be read."""


def padding(n: int) -> int:
    return -n % 4


def options(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("an option's head is cut")
        key, size = _OPTION.unpack_from(data, at)
        end = at + 4 + size
        if end + padding(size) > len(data):
            raise ValueError("an option runs past its block")
        yield key, data[at + 4 : end]
        at = end + padding(size)


def _value(kind: str, raw: bytes):
    if kind in _NUMBERS:
        return struct.unpack(_NUMBERS[kind], raw)[0]
    if kind in ("str", "strs"):
        return raw.decode("utf-8")
    if kind == "bytes":
        return raw
    if kind == "origin":
        s, p, i = _ORIGIN.unpack(raw)
        return {"source_id": s, "session_id": i, "pid": p}
    row = _SPAN if kind == "spans" else _EXTENT
    if len(raw) % row.size:
        raise ValueError("a list's entry is cut")
    if kind == "spans":
        out = [{"source_id": s, "in_session_id": i, "in_pid": p, "off_start": a, "off_end": b} for s, p, i, a, b in row.iter_unpack(raw)]
        if any(x["off_end"] < x["off_start"] for x in out):
            raise ValueError("a span ends before it begins")
        return out
    return [{"source_id": s, "in_session_id": i, "in_pid": p, "extent": e} for s, p, i, e in row.iter_unpack(raw)]


def parse_content(kind: int, content: bytes) -> dict:
    """Columns of a block's wide row; ValueError where its meaning is broken."""
    out: dict = {"block_type": kind, "content": content}
    if kind not in BODIES:
        return out
    form, names = BODIES[kind]
    size = struct.calcsize(form)
    if len(content) < size:
        raise ValueError("the body is cut")
    out.update(zip(names, struct.unpack_from(form, content), strict=True))
    if kind == S.FILE_HEADER and out["magic"] != S.MAGIC or kind == S.END and out["magic"] != S.END_MAGIC:
        raise ValueError("wrong magic")
    if kind == S.CUSTOM:
        return out | {"payload": content[size:]}
    if kind == S.RECORD:
        n = out["payload_len"]
        if size + n + padding(n) > len(content):
            raise ValueError("the payload runs past its block")
        out["payload"] = content[size : size + n]
        size += n + padding(n)
    if kind == S.UNDECODED and out["off_end"] < out["off_start"]:
        raise ValueError("a range ends before it begins")
    known = OPTIONS[kind] | {COMMENT: ("comment", "str")}
    lists: dict[str, list] = {name: [] for name, k in known.values() if k in ("strs", "spans", "extents")}
    extra = []
    for key, raw in options(content[size:]):
        name, k = known.get(key, (None, None))
        try:
            if name is None or name in out and name not in lists:
                raise ValueError
            value = _value(k, raw)
        except (ValueError, struct.error):
            extra.append({"option_id": key, "value": raw})
            continue
        if k == "strs":
            lists[name].append(value)
        elif name in lists:
            lists[name] += value
        else:
            out[name] = value
    out |= lists | {"extra_options": extra}
    if kind in _FLAG_BLOCKS:
        out.setdefault("flags", 0)
    return out


def _option(key: int, raw: bytes) -> bytes:
    if len(raw) > MOST:
        raise ValueError(f"option {key:#x} is too long")
    return _OPTION.pack(key, len(raw)) + raw + bytes(padding(len(raw)))


def _raws(kind: str, value) -> list[bytes]:
    if kind in _NUMBERS:
        return [struct.pack(_NUMBERS[kind], int(value))]
    if kind == "str":
        return [value.encode("utf-8")]
    if kind == "strs":
        return [v.encode("utf-8") for v in value]
    if kind == "bytes":
        return [bytes(value)]
    if kind == "origin":
        return [_ORIGIN.pack(value["source_id"], value["pid"], int(value["session_id"]))]
    row = _SPAN if kind == "spans" else _EXTENT
    each = [
        row.pack(v["source_id"], v["in_pid"], int(v["in_session_id"]), *([int(v["off_start"]), int(v["off_end"])] if kind == "spans" else [int(v["extent"])])) for v in value
    ]
    most = MOST // row.size
    return [b"".join(each[i : i + most]) for i in range(0, len(each), most)]


def build_content(row: dict) -> bytes:
    """The canonical content of a wide row: options by id, then the extra ones."""
    kind = row["block_type"]
    if kind not in BODIES:
        return bytes(row["content"])
    form, names = BODIES[kind]
    payload = bytes(row.get("payload") or b"")
    fixed = {"magic": S.MAGIC if kind == S.FILE_HEADER else S.END_MAGIC, "_": 0, "payload_len": len(payload)}
    if kind == S.FILE_HEADER:
        fixed |= {k: v for k, v in zip(("version_major", "version_minor"), S.VERSION, strict=True) if row.get(k) is None}
    try:
        out = struct.pack(form, *(int(fixed[n] if n in fixed else row.get(n) or 0) for n in names))
    except struct.error as e:
        raise ValueError(f"a number does not fit: {e}") from None
    if kind == S.CUSTOM:
        if len(payload) % 4:
            raise ValueError("a custom payload is a multiple of four bytes")
        return out + payload
    if kind == S.RECORD:
        out += payload + bytes(padding(len(payload)))
    for key, (name, k) in sorted((OPTIONS[kind] | {COMMENT: ("comment", "str")}).items()):
        value = row.get(name)
        if value is None or name == "flags" and kind in _FLAG_BLOCKS and not value:
            continue
        out += b"".join(_option(key, raw) for raw in _raws(k, value))
    return out + b"".join(_option(o["option_id"], bytes(o["value"])) for o in row.get("extra_options") or ())


def frame(kind: int, content: bytes) -> bytes:
    if len(content) % 4 or len(content) > 0xFFFFFFFF:
        raise ValueError("a block's content is a multiple of four bytes, below 4 GiB")
    return FRAME.pack(kind, 0, len(content)) + content


def parse_frame(data: bytes) -> dict:
    """The wide row of a whole frame; a broken body comes with parse_error."""
    kind, _, size = FRAME.unpack_from(data)
    content = data[8 : 8 + size]
    try:
        return parse_content(kind, content)
    except ValueError as e:
        return {"block_type": kind, "content": content, "parse_error": f"invalid-block: {e}"}


def check_version(row: dict) -> None:
    version = row["version_major"], row["version_minor"]
    if version != S.VERSION and (version[0] == 0 or version[0] != S.VERSION[0]):
        raise Broken("version {}.{} is not supported".format(*version))


def diagnostic(category: str, message: str, offset: int | None) -> dict:
    """A row without block type."""
    return {"block_type": None, "offset": offset, "parse_error": f"{category}: {message}"}


def scan(source, *, strict: bool = False, at: int = 0, seq: int = 0, kinds: frozenset[int] | None = None) -> Iterator[dict]:
    """Wide rows of a binary stream, with offset and block_seq; needs only read().

    A stream that begins at a later block is told that block's place.  Blocks of
    other than the wanted ``kinds`` are passed over unparsed.

    Broken bodies come with parse_error and their content, a cut end and bytes
    behind the end as diagnostics.
    """
    ended = False
    while True:
        head = source.read(8)
        if not head and seq:
            return
        if ended and head:
            if strict:
                raise ValueError("bytes behind the end block")
            yield diagnostic("trailing-bytes", "bytes behind the end block", at)
            return
        if len(head) == 8:
            kind, _, size = FRAME.unpack(head)
            if size % 4:
                raise Broken(f"the block at {at} has a length that is no multiple of four")
            content = source.read(size)
        if len(head) < 8 or len(content) < size:
            if not seq:
                raise Broken("no file header")
            if strict:
                raise ValueError("the stream ends inside a block")
            yield diagnostic("truncated", "the stream ends inside a block", at)
            return
        if (seq == 0) != (kind == S.FILE_HEADER):
            raise Broken("the first block is not a file header" if seq == 0 else "a second file header")
        wanted = kinds is None or kind in kinds
        if wanted or seq == 0:
            try:
                row = parse_content(kind, content)
            except ValueError as e:
                if seq == 0:
                    raise Broken(str(e)) from None
                if strict:
                    raise
                row = {"block_type": kind, "content": content, "parse_error": f"invalid-block: {e}"}
            if seq == 0:
                check_version(row)
            if wanted:
                yield row | {"offset": at, "block_seq": seq}
        ended = kind == S.END
        at, seq = at + 8 + size, seq + 1


def _clean(name: str, value):
    if name in _DECIMALS and value is not None:
        return Decimal(int(value))
    if name == "origin" and value:
        return value | {"session_id": Decimal(int(value["session_id"]))}
    if name in ("spans", "extents") and value:
        return [{k: Decimal(int(v)) if k in ("in_session_id", "off_start", "off_end", "extent") else v for k, v in x.items()} for x in value]
    return value


_U64 = pa.decimal128(20, 0)
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "decimal(20,0)": _U64, "array<string>": pa.list_(pa.string()),
    S.ORIGIN: pa.struct([("source_id", pa.int32()), ("session_id", _U64), ("pid", pa.int32())]),
    S.SPANS: pa.list_(pa.struct([("source_id", pa.int32()), ("in_session_id", _U64), ("in_pid", pa.int32()), ("off_start", _U64), ("off_end", _U64)])),
    S.EXTENTS: pa.list_(pa.struct([("source_id", pa.int32()), ("in_session_id", _U64), ("in_pid", pa.int32()), ("extent", _U64)])),
    S.EXTRA: pa.list_(pa.struct([("option_id", pa.int32()), ("value", pa.binary())])),
}


def wide_schema() -> pa.Schema:
    return pa.schema([(c, _ARROW[t]) for c, t in S.BLOCK_COLUMNS.items()])


def batch(rows: list[dict]) -> pa.RecordBatch:
    """Wide rows as Arrow."""
    form = wide_schema()
    return pa.RecordBatch.from_arrays([pa.array([_clean(f.name, r.get(f.name)) for r in rows], f.type) for f in form], schema=form)


def encode(blocks: DataFrame) -> DataFrame:
    """(path, block_seq, frame) of wide rows; content, where it is there, is taken as it is."""

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            frames = [frame(r["block_type"], bytes(r["content"]) if r["content"] is not None else build_content(r)) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("block_seq"), pa.array(frames, pa.binary())], names=["path", "block_seq", "frame"])

    return blocks.where("block_type is not null").mapInArrow(run, "path string, block_seq bigint, frame binary")


def parse(frames: DataFrame) -> DataFrame:
    """Wide rows of frames."""

    def run(batches):
        for b in batches:
            out = []
            for path, seq, data in zip(*(b.column(c).to_pylist() for c in ("path", "block_seq", "frame")), strict=True):
                out.append(parse_frame(data) | {"path": path, "block_seq": seq})
            yield batch(out)

    return frames.select("path", "block_seq", "frame").mapInArrow(run, S.BLOCK_SCHEMA)
