import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from model import decoded_file, frames, header, raw_file, row, span

from palaver import schema as S
from palaver.sources import codec, jsonl


def scan(data, **how):
    return list(codec.scan(io.BytesIO(data), **how))


def test_a_file_by_hand():
    rows = [
        header(tick_hz=48000),
        row(S.SESSION, session_id=300, proto="dns"),
        row(S.PARTICIPANT, session_id=300, pid=2, identity="ns"),
        row(S.DISCONTINUITY, session_id=300, pid=2, width=6),
        row(S.NAME, session_id=300, pid=2, label="ab"),
        row(S.CUSTOM, pen=258, subtype=9, payload=b"xyzw"),
        row(S.END),
    ]
    want = (
        "0100 0000 10000000  4650495a 0000 1000 80bb000000000000"  # magic, version, 48000 ticks
        "1000 0000 10000000  2c01000000000000  5000 0300 646e73 00"  # protocol, padded
        "1100 0000 14000000  2c01000000000000 0200 0000  6200 0200 6e73 0000"
        "2200 0000 18000000  2c01000000000000 0200 0000  d000 0800 0600000000000000"
        "3000 0000 14000000  2c01000000000000 0200 0000  b000 0200 6162 0000"
        "ff00 0000 0c000000  02010000 0900 0000 78797a77"
        "4100 0000 04000000  444e455a"
    ).replace(" ", "")
    assert frames(rows) == bytes.fromhex(want)
    got = scan(frames(rows))
    assert [r["offset"] for r in got] == [0, 24, 48, 76, 108, 136, 156] and got[3]["width"] == 6 and got[5]["payload"] == b"xyzw"
    assert [r["block_type"] for r in codec.scan(io.BytesIO(frames(rows)), kinds=frozenset([S.NAME, S.SESSION]))] == [S.SESSION, S.NAME]


U64, I64, U32, U16, U8 = (st.integers(a, b) for a, b in ((0, 2**64 - 1), (-(2**63), 2**63 - 1), (0, 2**32 - 1), (0, 2**16 - 1), (0, 255)))
TEXT, BYTES = st.text(st.characters(exclude_categories=["Cs"]), max_size=20), st.binary(max_size=40)


def opt(s):
    return st.one_of(st.none(), s)


SPAN = st.builds(lambda s, i, p, a, n: {"source_id": s, "in_session_id": i, "in_pid": p, "off_start": min(a, a + n), "off_end": min(a + n, 2**64 - 1)}, U16, U64, U16, U64, U32)
KINDS = {"str": TEXT, "strs": st.lists(TEXT, max_size=3), "i64": I64, "u8": U8, "u16": U16, "u32": U32, "u64": U64, "bytes": BYTES}
KINDS["spans"] = st.lists(SPAN, max_size=3)
KINDS["extents"] = st.lists(st.fixed_dictionaries({"source_id": U16, "in_session_id": U64, "in_pid": U16, "extent": U64}), max_size=3)
KINDS["origin"] = st.fixed_dictionaries({"source_id": U16, "session_id": U64, "pid": U16})
BODY = {"session_id": U64, "pid": U16, "source_id": U16, "decoder_id": U16, "kind": U8, "output_layer": U8, "tick_hz": U64, "ts": I64, "flags": U16, "off_start": U32, "off_end": st.integers(2**32, 2**64 - 1), "pen": U32, "subtype": U16}


@st.composite
def blocks(draw):
    kind = draw(st.sampled_from([k for k in codec.BODIES if k not in (S.FILE_HEADER, S.END)]))
    out = {"block_type": kind}
    for name in codec.BODIES[kind][1]:
        if name in BODY:
            out[name] = draw(BODY[name])
    for name, form in codec.OPTIONS.get(kind, {}).values():
        value = draw(opt(KINDS[form]) if form not in ("strs", "spans", "extents") else KINDS[form])
        if value is not None:
            out[name] = value
    if kind == S.CUSTOM:
        return out | {"payload": draw(st.binary(max_size=8).map(lambda b: b + bytes(-len(b) % 4)))}
    if kind == S.RECORD:
        out["payload"] = draw(BYTES)
    if kind in (S.SESSION,):
        out["flags"] = out.get("flags") or 0
    if (c := draw(opt(TEXT))) is not None:
        out["comment"] = c
    out["extra_options"] = draw(st.lists(st.fixed_dictionaries({"option_id": st.integers(0x300, 0xFFFF), "value": BYTES}), max_size=2))
    return out


def shown(r):
    return {k: v for k, v in r.items() if k not in ("content", "_", "payload_len", "magic") and v is not None}


@settings(max_examples=300, deadline=None)
@given(blocks())
def test_bytes_and_lines_lose_nothing(r):
    content = codec.build_content(r)
    back = codec.parse_content(r["block_type"], content)
    assert shown(back) == r
    assert codec.build_content(back) == content
    line = jsonl.dumps(back)
    again, issues = jsonl.loads(line)
    assert not issues and "\n" not in line
    if r["block_type"] == S.SESSION:
        assert again.pop("flags") == r["flags"] & 1
        assert shown(again) == {k: v for k, v in r.items() if k != "flags"}
    elif r["block_type"] == S.PARTICIPANT and r.get("tcp_role") == 0:
        assert shown(again) == {k: v for k, v in r.items() if k != "tcp_role"}
    else:
        assert shown(again) == r


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=200))
def test_noise_only_breaks_in_the_known_way(noise):
    data = frames(raw_file())
    for d in (noise, data[:30] + noise, data + noise):
        try:
            scan(d)
        except codec.Broken:
            pass


def test_unknown_things_are_kept():
    r = row(S.SOURCE, source_id=1, kind=0)
    content = codec.build_content(r) + codec._option(0x20, b"\xff\xfe") + codec._option(0x22, b"\x01\x00\x02") + codec._option(0x20, b"u") + codec._option(0x20, b"second") + codec._option(0x7777, b"abc")
    got = codec.parse_content(S.SOURCE, content)
    assert got["uri"] == "u" and "link_type" not in got
    assert [(o["option_id"], o["value"]) for o in got["extra_options"]] == [(0x20, b"\xff\xfe"), (0x22, b"\x01\x00\x02"), (0x20, b"second"), (0x7777, b"abc")]
    data = frames([header(), {"block_type": 0x99, "content": b"12345678"}])
    assert scan(data)[1]["content"] == b"12345678" and frames(scan(data)) == data
    assert jsonl.to_object(scan(data)[1]) == {"type": "0x0099", "content": "MTIzNDU2Nzg="}


def test_long_lists_take_several_options():
    many = [span(i, i + 1) for i in range(5000)]
    r = row(S.RECORD, session_id=1, pid=0, source_id=0, ts=0, payload=b"", spans=many)
    assert codec.parse_content(S.RECORD, codec.build_content(r))["spans"] == many
    with pytest.raises(ValueError):
        codec.build_content(row(S.SOURCE, source_id=1, kind=0, uri="u" * 70000))
    with pytest.raises(ValueError):
        codec.build_content(row(S.SOURCE, source_id=70000, kind=0))


def test_cut_and_trailing_and_broken():
    data = frames(decoded_file())
    for n in range(25, len(data) - 1):
        try:
            got = scan(data[:n])
        except codec.Broken:
            assert n < len(frames(decoded_file()[:1]))
            continue
        whole = len(frames([r for r in got if r["block_type"] is not None])) == n
        assert whole or got[-1]["parse_error"].startswith("truncated")
    assert scan(data + b"more")[-1]["parse_error"].startswith("trailing-bytes")
    with pytest.raises(ValueError):
        scan(data + b"more", strict=True)
    with pytest.raises(ValueError):
        scan(data[:-2], strict=True)
    bad = frames([header(), {"block_type": S.SESSION, "content": b"1234"}, row(S.END)])
    assert [r.get("parse_error", "")[:13] for r in scan(bad)] == ["", "invalid-block", ""]
    for broken in (b"", b"\x01", frames([row(S.END)]), frames([header(), header()]), frames([header(version_minor=15)]), frames([header(version_major=1)]), data[:8] + b"XXXX" + data[12:]):
        with pytest.raises(codec.Broken):
            scan(broken)


def test_lines():
    rows = [header(), row(S.SOURCE, source_id=1, kind=9), row(S.DECODER, decoder_id=1, output_layer=0), row(S.RECORD, session_id=2**60, pid=0, source_id=1, ts=-5, payload=b"\x00\xff", flags=0x8142), row(S.DISCONTINUITY, session_id=1, pid=0), row(S.END, comment="é")]
    lines = [jsonl.dumps(r) for r in rows]
    assert lines[1] == '{"type":"source","source_id":1,"kind":9}' and '"decoded"' in lines[2]
    assert lines[3] == '{"type":"record","session_id":"1152921504606846976","sender_pid":0,"source_id":1,"ts":-5,"flags":["fin","retransmit","0x0100","0x8000"],"payload":"AP8="}'
    assert "width" not in lines[4] and lines[5] == '{"type":"end","comment":"é"}'
    text = lines[:1] + ["  \n"] + lines[1:]
    got = list(jsonl.scan(iter(text)))
    assert [r["block_type"] for r in got] == [r["block_type"] for r in rows] and got[1]["offset"] == 3
    assert list(jsonl.scan(iter([*lines, "{}"])))[-1]["parse_error"].startswith("trailing-lines")
    assert list(jsonl.scan(iter([*lines[:3], '{"type":"se'])))[-1]["parse_error"].startswith("truncated")
    assert list(jsonl.scan(iter([*lines[:2], '{"type":"session"}', lines[2]])))[2]["parse_error"].startswith("invalid-line")
    edge = list(jsonl.scan(iter([*lines[:2], '{"type":"session","session_id":1,"new":2}'])))
    assert edge[2]["session_id"] == 1 and edge[3]["parse_error"].startswith("jsonl-edge")
    for broken in ([], ["{"], ["[]"], [lines[1]], [lines[0], lines[0]], [lines[0], "{", lines[1]], ['{"type":"file","format":"other/0.16","tick_hz":1}'], [f'{{"type":"file","format":"{S.FORMAT_PREFIX}0.16"}}']):
        with pytest.raises(codec.Broken):
            list(jsonl.scan(iter(broken)))
    with pytest.raises(ValueError):
        list(jsonl.scan(iter([lines[0], '{"type":"session","session_id":1,"new":2}']), strict=True))
