"""Files of both faces, conformance by planted faults, derivations end to end, tailing and the command line."""

import json
import os

import model
import pytest
from model import decoded_file, frames, header, raw_file, row, span
from pyspark.sql import functions as F

from palaver import cli, schema as S
from palaver.operators import conformance, coverage, offsets, order, provenance, transform
from palaver.sources import build, codec, container, datasource, jsonl
from palaver.streaming import tail


def put(folder, name, rows):
    path = os.path.join(str(folder), name)
    with open(path, "wb") as f:
        f.write(frames(rows))
    return path


def test_both_faces_and_tables(spark, tmp_path):
    files = {"a.bin": decoded_file(((0, 5), (9, 12)), [(5, 9, "skipped")], 12), "b.bin": raw_file(((1001, 10), (1050, 10))), "c.bin": [header(comment="é"), {"block_type": 0x77, "content": b"abcd"}, row(S.CUSTOM, pen=1, subtype=2, payload=b"12345678")]}
    (tmp_path / "in").mkdir()
    for name, rows in files.items():
        put(tmp_path / "in", name, rows)
    (tmp_path / "in" / "_hidden").write_text("no container")
    blocks = container.read(spark, str(tmp_path / "in"))
    assert blocks.count() == sum(map(len, files.values())) and container.diagnostics(blocks).isEmpty()
    t = container.tables(blocks)
    counts = {name: df.count() for name, df in t.items()}
    assert counts == {"headers": 3, "sources": 2, "decoders": 1, "sessions": 2, "participants": 2, "records": 4, "undecoded": 1, "discontinuities": 0, "session_ends": 2, "names": 0, "custom_blocks": 1, "ends": 2, "unknown_blocks": 1}
    assert {(os.path.basename(r.path), r.complete, r.truncated) for r in t["headers"].collect()} == {("a.bin", True, False), ("b.bin", True, False), ("c.bin", False, False)}
    # to lines and back: the same bytes
    wrote, lost = container.convert(spark, str(tmp_path / "in"), str(tmp_path / "lines"), face="jsonl")
    assert {r.path: r.blocks for r in wrote.collect()} == {n: len(r) for n, r in files.items()} and lost.isEmpty()
    first = json.loads((tmp_path / "lines" / "c.bin").read_text().splitlines()[0])
    assert first == {"type": "file", "format": S.FORMAT_PREFIX + "0.16", "tick_hz": 1000, "comment": "é"}
    container.convert(spark, str(tmp_path / "lines"), str(tmp_path / "back"), face="binary")[0].collect()
    for name, rows in files.items():
        assert (tmp_path / "back" / name).read_bytes() == frames(rows)
    assert {r.face for r in container.faces(spark, str(tmp_path / "lines")).collect()} == {"jsonl"} and {r.face for r in container.faces(spark, str(tmp_path / "in" / "a.bin")).collect()} == {"binary"}
    import hashlib

    assert container.digests(spark, str(tmp_path / "in" / "a.bin")).first().digest == "sha256:" + hashlib.sha256(frames(files["a.bin"])).hexdigest()


def test_cut_and_strict(spark, tmp_path):
    data = frames(raw_file())
    (tmp_path / "cut.bin").write_bytes(data[:-2])
    blocks = container.read(spark, str(tmp_path / "cut.bin"))
    assert [d.category for d in container.diagnostics(blocks).collect()] == ["truncated"]
    assert container.tables(blocks)["headers"].first().truncated
    with pytest.raises(Exception, match="ends inside a block"):
        container.read(spark, str(tmp_path / "cut.bin"), strict=True).collect()
    (tmp_path / "other").write_bytes(b"something else")
    with pytest.raises(Exception, match="neither face"):
        container.read(spark, str(tmp_path / "other"), strict=True).collect()


def test_a_broken_file_leaves_the_others(spark, tmp_path):
    (tmp_path / "other").write_bytes(b"something else")
    rows = raw_file()
    (tmp_path / "late").write_bytes(frames(rows[:-1]) + b"\x20\0\0\0\x03\0\0\0abc")
    put(tmp_path, "whole", rows)
    blocks = container.read(spark, str(tmp_path))
    bad = {os.path.basename(d.path): d for d in container.diagnostics(blocks).collect()}
    assert set(bad) == {"other", "late"} and {d.category for d in bad.values()} == {"broken-file"} and "multiple of four" in bad["late"].message
    assert {os.path.basename(r.path): r.n for r in blocks.where("parse_error is null").groupBy("path").agg(F.count("*").alias("n")).collect()} == {"whole": len(rows), "late": len(rows) - 1}
    with pytest.raises(Exception, match="multiple of four"):
        container.read(spark, str(tmp_path / "late"), strict=True).collect()
    assert cli.info(spark, str(tmp_path / "other"), lambda x: None) == 2


def test_only_what_is_asked_for(spark, tmp_path):
    put(tmp_path, "a", raw_file(((1001, 10), (1011, 10))))
    container.convert(spark, str(tmp_path / "a"), str(tmp_path / "l"), face="jsonl")[0].collect()
    for path in (str(tmp_path / "a"), str(tmp_path / "l")):
        some = container.read(spark, path, kinds=[S.SESSION, S.RECORD], payload=False).collect()
        whole = container.read(spark, path).where(F.col("block_type").isin(S.SESSION, S.RECORD)).collect()
        assert [r.block_seq for r in some] == [r.block_seq for r in whole] and all(r.payload is None for r in some) and any(r.payload for r in whole)
        assert [r.seq_start for r in some] == [r.seq_start for r in whole]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    rows = raw_file([(1001 + 10 * i, 10) for i in range(20)])
    data = frames(rows)
    datasource.register(spark)
    for name, body in (("whole", data), ("cut", data[:-3]), ("more", data + b"tail")):
        (tmp_path / name).write_bytes(body)
        one = container.read(spark, str(tmp_path / name))
        many = container.read(spark, str(tmp_path / name), split=150)
        plain = spark.read.format("payload_blocks").load(str(tmp_path / name))
        assert many.select(F.spark_partition_id()).distinct().count() > 2 and plain.rdd.getNumPartitions() == 1
        key = lambda r: (r.offset, r.block_seq is None)
        assert sorted(one.collect(), key=key) == sorted(many.collect(), key=key) == sorted(plain.collect(), key=key)


def test_long_lines_are_read_by_several_tasks(spark, tmp_path):
    """Blank lines, an invalid line, a cut end, lines behind the end, and a line in the middle that is no JSON: as in one piece."""
    put(tmp_path, "raw", raw_file([(1001 + 10 * i, 10) for i in range(20)]))
    container.convert(spark, str(tmp_path / "raw"), str(tmp_path / "l"), face="jsonl")[0].collect()
    (whole,) = [p for p in (tmp_path / "l").iterdir() if p.name[0] not in "._"]
    lines = whole.read_bytes().splitlines(keepends=True)
    odd = [*lines[:6], b"\n", b" \n", b'{"type": "record", "session_id": "x"}\n', *lines[6:]]
    for name, body in (("whole", lines), ("odd", odd), ("cut", [*odd[:-3], odd[-3][:9]]), ("more", [*odd, b"{}\n", *lines[5:9]]), ("broken", [*lines[:9], b"{no json\n", *lines[9:]]), ("open", [*lines[:-1], lines[-1].rstrip()])):
        (tmp_path / name).write_bytes(b"".join(body))
        one = container.read(spark, str(tmp_path / name)).collect()
        for split in (100, 700):
            key = lambda r: (r.offset or 1 << 40, r.block_seq is None)
            got = container.read(spark, str(tmp_path / name), split=split)
            if name != "broken":
                assert sorted(got.collect(), key=key) == sorted(one, key=key), (name, split)
            else:
                assert [d.category for d in container.diagnostics(got).collect()] == ["broken-file"]


def test_numbers_beyond_bigint(spark, tmp_path):
    rows = [header(), row(S.SESSION, session_id=2**64 - 1)]
    blocks = container.read(spark, put(tmp_path, "x", rows))
    assert int(container.tables(blocks, narrow=False)["sessions"].first().session_id) == 2**64 - 1
    # ids keep their 64 bits as BIGINT and come back; offsets that large fail
    t = container.tables(blocks)
    assert t["sessions"].first().session_id == -1
    assert int(container.wide(t["sessions"]).first().session_id) == 2**64 - 1
    far = put(tmp_path, "far", [*rows, row(S.RECORD, session_id=2**64 - 1, pid=0, source_id=0, ts=0, payload=b"", spans=[span(0, 5, session=2**63)]), row(S.UNDECODED, source_id=0, session_id=0, pid=0, off_start=2**63, off_end=2**64 - 1)])
    t = container.tables(container.read(spark, far))
    assert t["records"].first().spans[0].in_session_id == -(2**63) and int(container.wide(t["records"].withColumnRenamed("sender_pid", "pid")).first().spans[0].in_session_id) == 2**63
    with pytest.raises(Exception, match="OVERFLOW|overflow|out of range"):
        t["undecoded"].collect()


RAW, DEC = raw_file(), decoded_file()


def swap(rows, block_type, /, **more):
    return [r | more if r["block_type"] == block_type else r for r in rows]


def add(rows, at, *new):
    return rows[:at] + list(new) + rows[at:]


BREAK = row(S.DISCONTINUITY, session_id=7, pid=0)
FAULTS = [
    ([], RAW),
    ([], DEC),
    ([], decoded_file(((0, 60), (60, 100)), [(100, 120, "gap")], 120)),
    (["C2"], add(RAW, 2, RAW[1])),
    (["C2"], add(RAW, 3, RAW[2])),
    (["C2"], add(RAW, 4, RAW[3])),
    (["C2"], add(DEC, 3, DEC[2])),
    (["C3"], add(RAW, 4, row(S.RECORD, session_id=8, pid=0, source_id=0, ts=0, payload=b""))),
    (["C3"], add(RAW, 4, row(S.RECORD, session_id=7, pid=3, source_id=0, ts=0, payload=b""))),
    (["C3"], add(RAW, 4, row(S.RECORD, session_id=7, pid=0, source_id=5, ts=0, payload=b""))),
    (["C3"], add(RAW, 4, row(S.RECORD, session_id=7, pid=0, source_id=0, ts=0, payload=b"", decoder_id=4))),
    (["C3"], add(RAW, 6, row(S.NAME, session_id=7, pid=0, label="late"))),
    (["C3"], add(RAW, 3, row(S.NAME, session_id=7, pid=0, label="early"))),
    ([], RAW[:5]),
    (["C4"], raw_file(((1101, 5), (1001, 5)))),
    ([], raw_file(((2**32 - 5, 5), (0, 5)), isn=2**32 - 6)),
    (["C5"], swap(RAW, S.SOURCE, kind=7)),
    (["C6", "C8"], swap(swap(DEC, S.SOURCE, kind=0), S.FILE_HEADER, produced_by=None)[:-2] + [row(S.SESSION_END, session_id=7, extents=[{"source_id": 1, "in_session_id": 7, "in_pid": 0, "extent": 100}]), row(S.END)]),
    (["C7"], swap(RAW, S.PARTICIPANT, origin={"source_id": 0, "session_id": 1, "pid": 0})),
    (["C7"], swap(DEC, S.RECORD, spans=[])),
    (["C7"], swap(DEC, S.PARTICIPANT, origin={"source_id": 1, "session_id": 1, "pid": 0})),
    (["C8"], swap(DEC, S.FILE_HEADER, produced_at=None)),
    (["C9"], add(DEC, 6, row(S.RECORD, session_id=7, pid=0, source_id=1, ts=9, payload=b"", spans=[span(3, 4)]))),
    (["C9"], swap(DEC, S.DECODER, output_layer=5)),
    (["C10"], add(RAW, 5, BREAK)),
    (["C10"], add(raw_file(()), 4, BREAK)),
    (["C11"], swap(DEC, S.SESSION, flags=1)),
    ([], swap(DEC, S.SESSION, flags=1, sequenced_basis="trivial")),
    ([], swap(RAW, S.SESSION, flags=1)),
    (["C12"], add(RAW, 5, row(S.UNDECODED, source_id=0, session_id=7, pid=0, off_start=0, off_end=1, reason="skipped"))),
    (["C12"], add(RAW, 5, row(S.UNDECODED, source_id=0, session_id=0, pid=0, off_start=0, off_end=1, reason="gap"))),
    ([], add(RAW, 5, row(S.UNDECODED, source_id=0, session_id=0, pid=0, off_start=0, off_end=1, reason="skipped"))),
    (["C13"], decoded_file(((0, 5),), [(5, 9, "made-up")])),
    (["C13"], swap(decoded_file(((0, 5),), [(5, 9, "gap")]), S.UNDECODED, reason_class="bytes")),
    (["C13"], swap(decoded_file(((0, 5),), [(5, 9, "made-up")]), S.UNDECODED, reason_class="none")),
    ([], swap(decoded_file(((0, 5),), [(5, 9, "made-up")]), S.UNDECODED, reason_class="hole")),
    (["C14"], swap(RAW, S.FILE_HEADER, transform_params_digest="sha256:00")),
    ([], swap(DEC, S.FILE_HEADER, transform_params_digest="sha256:00")),
    (["C15"], decoded_file(((0, 50), (75, 100)), [(50, 75, "gap")])),
    ([], add(decoded_file(((0, 50), (75, 100)), [(50, 75, "gap")]), 6, BREAK)),
    ([], decoded_file(((0, 50), (75, 100)), [(50, 75, "skipped")])),
    ([], decoded_file(((75, 100), (0, 50)), [(50, 75, "gap")])),
    ([("C16", "coverage-gap")], decoded_file(((0, 50), (75, 100)))),
    ([("C16", "extent-exceeds-coverage")], decoded_file(((0, 20),), extent=40)),
    ([("C16", "extent-below-coverage")], decoded_file(((0, 20),), extent=10)),
    ([("C16", "extents-disagree")], add(decoded_file(((0, 20),), extent=40), 4, row(S.SESSION, session_id=8), row(S.SESSION_END, session_id=8, extents=[{"source_id": 1, "in_session_id": 7, "in_pid": 0, "extent": 30}]))),
    (["A1"], swap(DEC, S.RECORD, content_type="prim:u16")),
    ([], swap(DEC, S.RECORD, content_type="prim:bytes")),
    (["A2"], swap(RAW, S.RECORD, content_type="mime:text/plain")),
]


def test_every_rule_on_planted_faults(spark, tmp_path):
    """All files are read at once; each has exactly its own faults."""
    folder = tmp_path / "faults"
    folder.mkdir()
    for i, (_, rows) in enumerate(FAULTS):
        put(folder, f"{i:03d}", rows)
    blocks = container.load(spark, str(folder))
    got = {i: set() for i in range(len(FAULTS))}
    for f in conformance.findings(container.tables(blocks), blocks).collect():
        got[int(os.path.basename(f.path))].add((f.rule, f.category) if f.rule == "C16" else f.rule)
        assert f.severity == ("advisory" if f.rule[0] == "A" else "error")
    assert not [(i, want, got[i]) for i, (want, _) in enumerate(FAULTS) if got[i] != set(want)]


def test_place_of_headers_and_ends(spark):
    rows = [("a", 0, 1), ("a", 1, 2), ("a", 2, 65), ("b", 0, 2), ("b", 1, 1), ("c", 0, 1), ("c", 1, 1), ("d", 0, 1), ("d", 1, 65), ("d", 2, 16)]
    found = conformance.header_rules(spark.createDataFrame(rows, "path string, block_seq bigint, block_type int")).collect()
    assert sorted((f.path, f.block_seq) for f in found) == [("b", 0), ("b", 1), ("c", 1), ("d", 2)]


def test_isolation_feeds_on_itself(spark, tmp_path):
    """A source of an unknown kind stays; a session declared twice goes; what a dropped block declared is missing."""
    bad = row(S.PARTICIPANT, session_id=7, pid=1, origin={"source_id": 0, "session_id": 1, "pid": 0})
    late = row(S.RECORD, session_id=7, pid=1, source_id=0, ts=0, payload=b"z")
    rows = add(RAW, 4, bad, late, row(S.RECORD, session_id=7, pid=0, source_id=0, ts=0, payload=b"", seq_start=1001))
    t = container.tables(container.load(spark, put(tmp_path, "x", rows)))
    kept, dropped = conformance.isolate(t)
    assert {(d.block_seq, d.rule) for d in dropped.collect()} >= {(4, "C7"), (5, "C3")}
    assert kept["participants"].count() == 1 and {r.block_seq for r in kept["records"].collect()} == {6, 7}
    again, none = conformance.isolate(kept)
    assert none.isEmpty() and again["records"].count() == 2


def test_isolation_goes_on_until_nothing_is_left(spark, tmp_path):
    """More records that go back one after the other than the 16 turns that once were the most."""
    back = [row(S.RECORD, session_id=7, pid=0, source_id=0, ts=0, payload=b"", seq_start=1000 - i) for i in range(18)]
    t = container.tables(container.load(spark, put(tmp_path, "x", add(RAW, 4, row(S.RECORD, session_id=7, pid=0, source_id=0, ts=0, payload=b"", seq_start=1001), *back))))
    kept, dropped = conformance.isolate(t)
    assert sorted((d.block_seq, d.rule) for d in dropped.collect()) == [(5 + i, "C4") for i in range(18)]
    assert conformance.block_rules(kept).isEmpty()


def test_coverage_of_a_pair(spark, tmp_path):
    """An input of 64 + 23 bytes, cited with a hole, twice, beyond its end, whole, and with another length declared."""
    raw = container.tables(container.load(spark, put(tmp_path, "raw", raw_file(((1001, 64), (1065, 23))))))
    facts = offsets.stream_facts(raw["participants"], raw["records"], raw["decoders"], raw["sources"])
    extents = offsets.stream_extent(offsets.record_ranges(raw["records"], raw["discontinuities"], facts), raw["participants"])
    cases = [
        (((0, 31), (40, 70), (72, 87)), (), None, [("coverage-gap", 31), ("coverage-gap", 70)]),
        (((0, 50), (45, 60)), [(48, 87, "skipped")], None, [("coverage-overlap", 48)]),
        (((0, 80), (80, 95)), (), None, [("coverage-excess", 80)]),
        (((3, 9),), (), None, [("coverage-gap", 0), ("coverage-gap", 9)]),
        (((0, 87),), (), 87, []),
        (((0, 87),), (), 64, [("extent-mismatch", 64)]),
    ]
    for i, (ranges, und, extent, want) in enumerate(cases):
        t = container.tables(container.load(spark, put(tmp_path, f"d{i}", decoded_file(ranges, und, extent))))
        found = coverage.check_coverage(t["records"], t["undecoded"], t["session_ends"], coverage.input_source(t["sources"]), extents).collect()
        assert sorted((f.category, f.offset) for f in found) == want


def test_filter_stage_is_written_clean(spark, tmp_path):
    rows = decoded_file(((0, 20), (20, 60), (60, 75)), (), 75)
    rows = swap(rows, S.RECORD, flags=0)
    rows[5]["content_type"], rows[6]["content_type"], rows[7]["content_type"] = "dec:a", "dec:b", "dec:a"
    rows = add(rows, 7, row(S.DISCONTINUITY, session_id=7, pid=0, width=5, reason="lost"))
    t = container.tables(container.load(spark, put(tmp_path, "in", rows)))
    out = build.rewritten(t, "out", uri="in", produced_by="filter", produced_at=2, keep=F.col("content_type") == "dec:a")
    container.write(build.build(out), str(tmp_path)).collect()
    u = container.tables(container.load(spark, str(tmp_path / "out")))
    assert [(r.spans[0].off_start, r.spans[0].off_end) for r in u["records"].orderBy("block_seq").collect()] == [(0, 20), (65, 80)]
    assert [(d.width, d.reason) for d in u["discontinuities"].orderBy("block_seq").collect()] == [(5, "lost"), (40, "records-dropped")]
    assert {(d.off_start, d.off_end, d.reason) for d in u["undecoded"].collect()} == {(20, 60, "skipped"), (60, 65, "gap")}
    assert u["session_ends"].first().extents[0].extent == 80 and u["decoders"].first().output_layer == 0
    turned = build.rewritten(t, "turned", uri="in", produced_by="turn", produced_at=2, reorder=[F.desc("block_seq")])
    v = container.tables(build.build(turned))
    assert [d.reason for d in v["discontinuities"].orderBy("block_seq").collect()].count("reordered") == 2
    with pytest.raises(ValueError, match="no decoded layer"):
        build.rewritten(container.tables(container.load(spark, put(tmp_path, "raw", RAW))), "x", uri="raw", produced_by="p", produced_at=1)


def test_a_broken_build_is_not_written(spark, tmp_path):
    t = container.tables(container.load(spark, put(tmp_path, "in", DEC)))
    t["headers"] = t["headers"].withColumn("produced_by", F.lit(None).cast("string"))
    with pytest.raises(build.Invalid, match="C8"):
        build.build(t)
    assert build.build(t, check=False).count() == len(DEC)


def side(isn, pid_clock, sends):
    out = [header(), row(S.SOURCE, source_id=0, kind=0), row(S.SESSION, session_id=3), row(S.PARTICIPANT, session_id=3, pid=5, isn=isn)]
    out += [row(S.RECORD, session_id=3, pid=5, source_id=0, ts=t, payload=d, seq_start=s, ack=a) for t, d, s, a in sends]
    return [*out, row(S.SESSION_END, session_id=3), row(S.END)]


def test_two_sides_with_skewed_clocks(spark, tmp_path):
    a = put(tmp_path, "a", side(1000, 0, [(1000, b"GET / HTTP/1.0\r\n\r\n", 1001, 5001), (1020, b"x", 1019, 5020)]))
    b = put(tmp_path, "b", side(5000, 1, [(995, b"HTTP/1.0 200 OK\r\n\r\n", 5001, 1019)]))
    assert cli.merge(spark, a, b, str(tmp_path / "m"), "test", out=lambda _: None) == 0
    t = container.tables(container.load(spark, str(tmp_path / "m")))
    r = t["records"].orderBy("block_seq").collect()
    assert [(x.sender_pid, bytes(x.payload)[:4]) for x in r] == [(0, b"GET "), (1, b"HTTP"), (0, b"x")]
    assert order.verify_sequenced(t["records"]).isEmpty() and t["sessions"].first().flags == 1
    assert [p.origin.session_id for p in t["participants"].collect()] == [3, 3]
    with pytest.raises(ValueError, match="one session"):
        transform.merge_sides(t, t, "x")


def test_decode_stage_accounts_for_all(spark, tmp_path):
    t = container.tables(container.load(spark, put(tmp_path, "raw", raw_file(((1001, 10), (1050, 10))))))
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"])

    def halves(units):
        return [{"payload": u["data"][:4], "ts": u["ts"], "cites": [(u["off_start"], u["off_start"] + 4)], "undecoded": [(u["off_start"] + 4, u["off_start"] + 6, "undecodable")]} for u in units]

    stage = lambda decoder: transform.decode_stage(t["records"], t["discontinuities"], facts, decoder)
    out = stage(halves)
    assert {(u.off_start, u.off_end, u.reason) for u in out["undecoded"].collect()} == {(4, 6, "undecodable"), (53, 55, "undecodable"), (6, 10, "skipped"), (10, 49, "gap"), (55, 59, "skipped")}
    assert [r.spans[0].off_start for r in out["records"].orderBy("unit").collect()] == [0, 49]
    # what is cited and marked, a record that cites nothing, and a unit that cites without payload fail
    with pytest.raises(ValueError, match=r"\[4, 5\) is both"):
        stage(lambda us: [{"payload": b"", "ts": 0, "cites": [(0, 5)], "undecoded": [(4, 6, "skipped")]}])
    for lost in ({"payload": b"x", "ts": 0}, {"payload": b"x", "ts": 0, "cites": []}, {"cites": (0, 5)}, {"seam": {}, "undecoded": [(0, 1, "skipped")]}):
        with pytest.raises(Exception, match="cite"):
            stage(lambda us, lost=lost: [{"payload": b"", "ts": 0, "cites": (0, 5)}, lost])["records"].collect()


def test_decoders_seams_hints_and_spans(spark, tmp_path):
    t = container.tables(container.load(spark, put(tmp_path, "raw", raw_file(((1001, 10), (1050, 10))))))
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"])
    sid = t["sessions"].first().session_id

    def units(us):
        a, b = us
        own = {"source_id": 0, "in_session_id": int(sid), "in_pid": 0}
        return [
            {"payload": b"one", "ts": 1, "cites": (0, 3), "seam": {"reason": "never before a first"}, "flags": 4},
            {"payload": b"two", "ts": 2, "cites": [(3, 5), {**own, "off_start": 6, "off_end": 7}, [8, 9]], "hints": {"seq_start": 77, "ack": 5}},
            {"discontinuity": {"width": 9, "reason": "lost"}},
            {"payload": b"three", "ts": 3, "cites": {**own, "off_start": 49, "off_end": 59}, "seam": {"width": None, "reason": "hole"}, "content_type": "dec:x"},
            {"payload": b"far", "ts": 4, "cites": {"source_id": 5, "in_session_id": 1, "in_pid": 2, "off_start": 0, "off_end": 99}},
        ]

    out = transform.decode_stage(t["records"], t["discontinuities"], facts, units)
    rec = out["records"].orderBy("position").collect()
    assert [(r.position, bytes(r.payload), r.flags, r.seq_start, r.ack, r.content_type) for r in rec] == [(1, b"one", 4, None, None, None), (2, b"two", 0, 77, 5, None), (5, b"three", 0, None, None, "dec:x"), (6, b"far", 0, None, None, None)]
    assert [[(s.off_start, s.off_end) for s in r.spans] for r in rec] == [[(0, 3)], [(3, 5), (6, 7), (8, 9)], [(49, 59)], [(0, 99)]]
    assert [(b.position, b.width, b.reason) for b in out["discontinuities"].orderBy("position").collect()] == [(3, 9, "lost"), (4, None, "hole")]
    assert {(u.off_start, u.off_end, u.reason) for u in out["undecoded"].collect()} == {(5, 6, "skipped"), (7, 8, "skipped"), (9, 10, "skipped"), (10, 49, "gap")}


def test_self_input(spark, tmp_path):
    t = container.tables(container.load(spark, put(tmp_path, "me.bin", swap(DEC, S.SOURCE, uri="./me.bin"))))
    assert container.self_inputs(t).count() == 1


def test_tail_of_a_growing_file(spark, tmp_path):
    rows = add(RAW, 4, row(S.RECORD, session_id=7, pid=4, source_id=0, ts=0, payload=b"no such sender")) [:-1]
    rows += [row(S.RECORD, session_id=7, pid=0, source_id=0, ts=0, payload=b"late"), row(S.SESSION, session_id=7)]
    data = frames(rows)
    folder = tmp_path / "grow"
    folder.mkdir()
    found, counts, ranks = [], [], []
    for n, cut in enumerate((len(data) // 2, len(data) - 3, len(data))):
        (folder / "f").write_bytes(data[:cut])
        for stream, sink, mode, name in ((tail.check_sessions(tail.blocks(spark, str(folder))), found, "append", "c"), (tail.session_counts(tail.blocks(spark, str(folder))), counts, "complete", "n"), (tail.merge_sessions(tail.blocks(spark, str(folder))), ranks, "append", "m")):
            q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, _, sink=sink: sink.append(df.collect())).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    assert {(r.block_seq, r.rule) for b in found for r in b} == {(4, "C3"), (7, "C3"), (8, "C2")}
    assert [r.record_count for r in counts[-1]] == [3]
    assert [[(r.block_seq, r.merge_rank) for r in b] for b in ranks if b] == [[(4, 2), (5, 1)]]


def test_tail_of_growing_lines(spark, tmp_path):
    put(tmp_path, "a", raw_file(((1001, 10), (1011, 10))))
    container.convert(spark, str(tmp_path / "a"), str(tmp_path / "l"), face="jsonl")[0].collect()
    (whole,) = [p for p in (tmp_path / "l").iterdir() if p.name[0] not in "._"]
    data = whole.read_bytes() + b"no json\n"
    folder = tmp_path / "grow"
    folder.mkdir()
    got = []
    for cut in (20, len(data) // 2, len(data)):
        (folder / "f").write_bytes(data[:cut])
        q = tail.blocks(spark, str(folder)).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    want = container.read(spark, str(whole)).collect()
    bad = [r for r in got if r.parse_error]
    assert len(bad) == 1 and bad[0].parse_error.startswith("invalid-line")
    assert [(r.block_seq, r.block_type, r.payload) for r in got if not r.parse_error] == [(r.block_seq, r.block_type, r.payload) for r in want]


def test_command_line(spark, tmp_path, capsys):
    raw, dec = put(tmp_path, "raw", raw_file(((1001, 100),))), put(tmp_path, "dec", decoded_file(((0, 90),), (), 90))
    lines = []
    assert cli.info(spark, raw, lines.append) == 0
    assert lines[0] == "face:      binary" and "session 7: proto=? participants=[pid 0] records=1 end=yes" in lines and "  stream 0: capture transport" in lines
    assert cli.main(["cat", raw]) == 0
    assert [json.loads(x)["type"] for x in capsys.readouterr().out.splitlines() if x.startswith("{")] == ["file", "source", "session", "participant", "record", "session_end", "end"]
    assert cli.main(["validate", raw, "--verify"]) == 0
    assert cli.main(["validate", dec, "--input", raw]) == 1
    assert "coverage-gap" in capsys.readouterr().out
    assert cli.main(["convert", raw, str(tmp_path / "l"), "--to", "jsonl"]) == 0
    assert cli.main(["info", str(tmp_path / "nothing")]) == 2




def test_inputs_are_opened_by_their_uris(spark, tmp_path):
    """A note on a decoded file on a capture: the chain is opened from its last file, and spans are followed through it."""
    put(tmp_path, "raw", raw_file(((1001, 40),)))
    dec = decoded_file(((0, 40),), (), 40)
    put(tmp_path, "dec", dec)
    note = [header(produced_by="t", produced_at=1), row(S.SOURCE, source_id=0, kind=1, uri="dec"), row(S.DECODER, decoder_id=1, output_layer=0, name="d"), row(S.SESSION, session_id=7)]
    note += [row(S.PARTICIPANT, session_id=7, pid=0, origin={"source_id": 0, "session_id": 7, "pid": 0}), row(S.RECORD, session_id=7, pid=0, source_id=0, ts=0, payload=b"n" * 40, decoder_id=1), row(S.SESSION_END, session_id=7), row(S.END)]
    blocks, files = container.open_inputs(spark, put(tmp_path, "note", note))
    assert {os.path.basename(r.path) for r in blocks.select("path").distinct().collect()} == {"note", "dec", "raw"}
    assert {r.uri for r in files.collect()} == {"dec", "raw"}
    t = container.tables(blocks)
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"])
    ranges = offsets.record_ranges(t["records"], t["discontinuities"], facts)
    wanted = ranges.where(F.col("path").endswith("note")).select(F.lit(1).alias("id"), "path", "session_id", "pid", "off_start", "off_end")
    (found,) = provenance.resolve_spans(wanted, ranges, t["participants"], t["sources"], files).collect()
    assert os.path.basename(found.file) == "dec" and (found.off_start, found.off_end) == (0, 40)


def test_a_promise_of_order_is_kept(spark, tmp_path):
    """A sequenced session whose stored order lets an acknowledgement run ahead is not written; linearized it is."""
    rows = [header(), row(S.SOURCE, source_id=0, kind=0, uri="cap"), row(S.SESSION, session_id=7), *[row(S.PARTICIPANT, session_id=7, pid=p, isn=99) for p in (0, 1)]]
    rows += [row(S.RECORD, session_id=7, pid=p, source_id=0, ts=t, payload=b"x" * 10, seq_start=s, ack=a) for p, t, s, a in ((1, 1, 100, 110), (0, 2, 100, None), (0, 3, 110, 110))]
    t = container.tables(container.load(spark, put(tmp_path, "two", [*rows, row(S.SESSION_END, session_id=7), row(S.END)])))
    t["sessions"] = t["sessions"].withColumn("flags", F.lit(1))
    t["custom_blocks"] = t["custom_blocks"].limit(0)
    use = {k: v for k, v in t.items() if k not in ("ends", "unknown_blocks", "names", "undecoded", "discontinuities")}
    with pytest.raises(build.Invalid, match="O8"):
        build.build(use)
    use["records"] = transform.linearize(t["records"], t["participants"])
    made = container.tables(build.build(use))["records"].orderBy("block_seq").collect()
    assert [(r.sender_pid, r.ts) for r in made] == [(0, 2), (1, 1), (0, 3)]
