"""Tables of a payload container, and the fixed values of its format.

A container is a sequence of blocks; each kind of block is a table here.  Every
key is prefixed with ``path``, as ids are unique in one file only, and every
block-derived table keeps ``block_seq``, the place of the block in its file.
Unsigned 64-bit numbers are DECIMAL(20,0) in the codec and BIGINT in the
operators: ids with the same 64 bits, other values as they are, and one that does
not fit fails the cast.
"""

from __future__ import annotations

# Fixed values of the format: magics, block types, option ids, labels.
MAGIC, END_MAGIC = 0x5A495046, 0x5A454E44
FORMAT_PREFIX = "zipline-payload/"
VERSION = (0, 16)

FILE_HEADER, SOURCE, DECODER = 0x01, 0x02, 0x03
SESSION, PARTICIPANT, SESSION_END = 0x10, 0x11, 0x12
RECORD, UNDECODED, DISCONTINUITY = 0x20, 0x21, 0x22
NAME, END, CUSTOM = 0x30, 0x41, 0xFF

KIND_LABELS = {0: "capture", 1: "zpf-input"}
LAYER_LABELS = {0: "decoded", 1: "transport"}
ROLE_LABELS = {1: "initiator", 2: "responder"}
CAPTURE, FILE_INPUT = 0, 1
DECODED, TRANSPORT = 0, 1
RECORD_FLAGS = {"psh": 0x01, "fin": 0x02, "rst": 0x04, "syn": 0x08, "urg": 0x10, "retransmit": 0x40, "message": 0x80}
SINGLE_CLOCK, SEQUENCED = 0x01, 0x01
REASONS = {"undecodable": "bytes", "skipped": "bytes", "gap": "hole", "truncated": "hole"}
REASON_CLASSES = ("bytes", "hole")
BASES = ("clock", "protocol", "external", "trivial")
PRIM_WIDTHS = {"u8": 1, "u16": 2, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8}
# End of fixed values.

SEQ_SPACE = 1 << 32

_U64 = "decimal(20,0)"
SPANS = f"array<struct<source_id:int,in_session_id:{_U64},in_pid:int,off_start:{_U64},off_end:{_U64}>>"
EXTENTS = f"array<struct<source_id:int,in_session_id:{_U64},in_pid:int,extent:{_U64}>>"
ORIGIN = f"struct<source_id:int,session_id:{_U64},pid:int>"
EXTRA = "array<struct<option_id:int,value:binary>>"

#: One wide row for each block, as the sources give it; columns a kind lacks are null.
BLOCK_COLUMNS = {
    "path": "string", "block_seq": "bigint", "offset": "bigint", "block_type": "int", "content": "binary", "parse_error": "string",
    "version_major": "int", "version_minor": "int", "tick_hz": _U64, "time_epoch": "bigint", "creator": "string", "produced_by": "string", "produced_at": "bigint",
    "transform_params_digest": "string", "flags": "int", "source_id": "int", "kind": "int", "uri": "string", "digest": "string", "link_type": "int",
    "decoder_id": "int", "output_layer": "int", "name": "string", "version": "string", "params_digest": "string",
    "session_id": _U64, "proto": "string", "flow_key": "string", "sequenced_basis": "string", "external_session_id": "binary",
    "pid": "int", "endpoints": "array<string>", "isn": "bigint", "identity": "string", "tcp_role": "int", "origin": ORIGIN,
    "reason": "string", "extents": EXTENTS, "ts": "bigint", "payload": "binary", "seq_start": "bigint", "ack": "bigint", "ts_first": "bigint", "spans": SPANS,
    "content_type": "string", "off_start": _U64, "off_end": _U64, "reason_class": "string", "width": _U64, "label": "string", "label_kind": "string",
    "pen": "bigint", "subtype": "int", "comment": "string", "extra_options": EXTRA,
}
BLOCK_SCHEMA = ", ".join(f"{c} {t}" for c, t in BLOCK_COLUMNS.items())

_OWN = ["path", "block_seq"]
_REST = ["comment", "extra_options"]
#: Table -> (block type, {column: column of the wide row}).
TABLES = {
    "headers": (FILE_HEADER, ["version_major", "version_minor", "tick_hz", "time_epoch", "creator", "produced_by", "produced_at", "transform_params_digest", "flags"]),
    "sources": (SOURCE, ["source_id", "kind", "uri", "digest", "link_type"]),
    "decoders": (DECODER, ["decoder_id", "output_layer", "name", "version", "params_digest"]),
    "sessions": (SESSION, ["session_id", "proto", "flow_key", "flags", "sequenced_basis", "external_session_id"]),
    "participants": (PARTICIPANT, ["session_id", "pid", "endpoints", "isn", "identity", "tcp_role", "origin"]),
    "records": (RECORD, ["session_id", "pid", "source_id", "ts", "payload", "flags", "seq_start", "ack", "ts_first", "decoder_id", "content_type", "spans"]),
    "undecoded": (UNDECODED, ["source_id", "session_id", "pid", "off_start", "off_end", "reason", "reason_class", "decoder_id"]),
    "discontinuities": (DISCONTINUITY, ["session_id", "pid", "width", "reason"]),
    "session_ends": (SESSION_END, ["session_id", "reason", "extents"]),
    "names": (NAME, ["session_id", "pid", "label", "label_kind"]),
    "custom_blocks": (CUSTOM, ["pen", "subtype", "payload"]),
    "ends": (END, []),
}
#: Ids in undecoded blocks are those of the input, so they cannot be joined to this file's by accident.
RENAMED = {"undecoded": {"session_id": "in_session_id", "pid": "in_pid"}, "records": {"pid": "sender_pid"}, "names": {"label_kind": "kind"}}
STREAM = ["path", "session_id", "pid"]
FINDINGS = "path string, block_seq bigint, severity string, rule string, category string, offset bigint, message string"
