"""Operators against sequential models on random tables."""

import random

import model
import pytest
from pyspark.sql import functions as F

from palaver import schema as S
from palaver.functions import content, serial
from palaver.operators import intervals, offsets, order, provenance, segments

REC = "path string, block_seq bigint, session_id bigint, sender_pid int, source_id int, ts bigint, payload binary, flags int, seq_start bigint, ack bigint, ts_first bigint, decoder_id int, content_type string, spans array<struct<source_id:int,in_session_id:bigint,in_pid:int,off_start:bigint,off_end:bigint>>"
BRK = "path string, block_seq bigint, session_id bigint, pid int, width bigint, reason string"
PPL = "path string, block_seq bigint, session_id bigint, pid int, endpoints array<string>, isn bigint, origin struct<source_id:int,session_id:bigint,pid:int>"
SRC = "path string, block_seq bigint, source_id int, kind int, uri string, digest string"
DEC = "path string, block_seq bigint, decoder_id int, output_layer int, name string"


def rec(seq, session, pid, payload=b"", ts=0, seq_start=None, ack=None, decoder=None, spans=(), source=0, path="f", label=None):
    return (path, seq, session, pid, source, ts, payload, 0, seq_start, ack, None, decoder, label, [tuple(s) for s in spans])


def test_serial_arithmetic(spark):
    rnd = random.Random(1)
    near = [0, 1, 2**31 - 1, 2**31, 2**31 + 1, 2**32 - 1]
    pairs = [(a, b) for a in near for b in near] + [(rnd.randrange(2**32), rnd.randrange(2**32)) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    for r in df.select("a", "b", serial.seq_lt("a", "b").alias("lt"), serial.seq_leq("a", "b").alias("leq"), serial.seq_geq("a", "b").alias("geq"), serial.record_end("a", F.col("b")).alias("end")).collect():
        assert (r.lt, r.leq, r.geq, r.end) == (model.lt(r.a, r.b), model.leq(r.a, r.b), model.leq(r.b, r.a), (r.a + r.b) % 2**32)


@pytest.fixture(scope="module")
def streams(spark):
    """Random streams of all kinds: decoded, hinted, without hints, with breaks, across the wrap."""
    rnd = random.Random(7)
    rows, brk, ppl, plain = [], [], [], {}
    for k in range(120):
        decoded, hinted = rnd.random() < 0.4, rnd.random() < 0.7
        isn = rnd.choice([None, 2**32 - 3, 1000])
        base, at, blocks, recs = rnd.choice([2**32 - 2, 1001]), 0, [], []
        for i in range(rnd.randrange(0, 9)):
            if decoded and rnd.random() < 0.25:
                w = rnd.choice([None, 0, 5])
                blocks.append(("b", w))
                brk.append(("f", i, k, 0, w, "x"))
                continue
            n = rnd.choice([0, 0, 1, 7])
            seq = (base + at + rnd.choice([0, 0, 0, 3, -2])) % 2**32 if hinted and rnd.random() < 0.85 else None
            data = bytes(rnd.choice(b"abc") for _ in range(n))
            blocks.append(("r", n, seq))
            recs.append((i, seq, data, rnd.randrange(5)))
            rows.append(rec(i, k, 0, data, recs[-1][3], seq, decoder=1 if decoded else None))
            at += n
        ppl.append(("f", -1, k, 0, ["outer", "inner"], isn, None))
        plain[k] = (blocks, recs, isn, decoded)
    t = {
        "records": spark.createDataFrame(rows, REC).cache(), "discontinuities": spark.createDataFrame(brk, BRK), "participants": spark.createDataFrame(ppl, PPL),
        "sources": spark.createDataFrame([("f", -9, 0, 0, "c", None)], SRC), "decoders": spark.createDataFrame([("f", -8, 1, 0, "d")], DEC),
    }
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"]).cache()
    return t, facts, plain


def test_ranges_and_extents(streams):
    t, facts, plain = streams
    got = {}
    ranges = offsets.record_ranges(t["records"], t["discontinuities"], facts)
    for r in ranges.orderBy("block_seq").collect():
        got.setdefault(r.session_id, []).append((r.off_start, r.off_end))
    for k, (blocks, recs, isn, decoded) in plain.items():
        # breaks are for streams whose records are decoded; one without records is a transport stream
        want = model.ranges(blocks, isn, decoded and bool(recs))
        assert got.get(k, []) == want, (k, blocks)
    extents = {r.session_id: r.extent for r in offsets.stream_extent(ranges, t["participants"]).collect()}
    assert extents == {k: max((e for _, e in got.get(k, [])), default=0) for k in plain}


def test_chunks(streams):
    t, facts, plain = streams
    got = {}
    for c in segments.chunks(t["records"], facts).orderBy("off_start").collect():
        got.setdefault(c.session_id, []).append((c.kind, c.off_start, c.off_end, c.ts, bytes(c.data) if c.data is not None else None))
    for k, (_, recs, isn, _) in plain.items():
        if isn is None and not (recs and recs[0][1] is not None):
            assert k not in got
            continue
        origin = (isn + 1) % 2**32 if isn is not None else None
        want = model.chunks([(s, d, ts) for _, s, d, ts in recs], origin)
        assert got.get(k, []) == want, (k, recs, isn)


def test_units_and_facts(streams):
    t, facts, plain = streams
    rows = offsets.units(t["records"], t["discontinuities"], facts).collect()
    f = {r.session_id: r for r in facts.collect()}
    for k, (blocks, recs, isn, decoded) in plain.items():
        own = sorted((r for r in rows if r.session_id == k), key=lambda r: r.block_seq)
        oriented = isn is not None or bool(recs) and recs[0][1] is not None
        assert f[k].stream_oriented == oriented and f[k].layer == (0 if decoded and recs else 1)
        assert len(own) == sum(1 for b in blocks if b[0] == "b" or not oriented or b[2] is not None)


def test_mixed_and_undeclared_layers(spark, streams):
    t, *_ = streams
    rows = spark.createDataFrame([rec(0, 1, 0, decoder=1), rec(1, 1, 0), rec(0, 2, 0, decoder=9), rec(0, 3, 0, decoder=2)], REC)
    ppl = spark.createDataFrame([("f", -1, k, 0, [], None, None) for k in (1, 2, 3, 4)], PPL)
    dec = spark.createDataFrame([("f", -8, 1, 0, "d"), ("f", -8, 2, 7, "odd")], DEC)
    facts = offsets.stream_facts(ppl, rows, dec, t["sources"])
    kinds = {r.session_id: (r.provenance, r.layer) for r in offsets.stream_kind(facts).collect()}
    assert kinds == {1: ("capture", None), 2: ("capture", None), 3: ("capture", "layer 7"), 4: ("capture", "transport")}
    for k in (1, 3):
        with pytest.raises(Exception, match="not one that is defined"):
            offsets.record_ranges(rows.where(f"session_id = {k}"), spark.createDataFrame([], BRK), facts).collect()


def test_merge_and_verify(spark):
    rnd = random.Random(3)
    rows, plain = [], {}
    for k in range(150):
        n_pids = rnd.choice([1, 2, 2, 2, 3])
        acked, isn = rnd.random() < 0.8, rnd.choice([0, 2**32 - 20])
        sent, seqs, recs = [0] * n_pids, [], []
        for i in range(rnd.randrange(1, 14)):
            p, n = rnd.randrange(n_pids), rnd.choice([0, 1, 5, 30])
            ack = (isn + sent[1 - p if n_pids == 2 else 0]) % 2**32 if acked and rnd.random() < 0.8 else None
            seq = (isn + sent[p]) % 2**32 if rnd.random() < 0.95 else None
            recs.append((i, p, rnd.randrange(40), seq, n, ack))
            sent[p] += n
        if rnd.random() < 0.4:
            rnd.shuffle(recs)
        recs = [(i, *r[1:]) for i, r in enumerate(recs)]
        plain[k] = (recs, n_pids)
        rows += [rec(i, k, p, b"x" * n, ts, seq, ack) for i, p, ts, seq, n, ack in recs]
    df = spark.createDataFrame(rows, REC).cache()
    ppl = spark.createDataFrame([("f", -1, k, p, [], None, None) for k, (_, n) in plain.items() for p in range(n)], PPL)
    got = {}
    for r in order.causal_merge(df, ppl, strict=False).where("merge_rank is not null").orderBy("merge_rank").collect():
        got.setdefault(r.session_id, []).append(r.block_seq)
    stalls = 0
    for k, (recs, n) in plain.items():
        lines = {p: [(i, ts, seq, size, ack) for i, q, ts, seq, size, ack in recs if q == p] for p in range(n)}
        if n != 2:
            lines = {p: [(*x[:4], None) for x in v] for p, v in lines.items()}
        want, stalled = model.merge(lines)
        stalls += stalled
        assert got.get(k, []) == want, (k, recs)
    assert stalls
    with pytest.raises(Exception, match="stalls"):
        order.causal_merge(df, ppl).collect()
    for count in (None, 2, 3):
        bad = {}
        for r in order.verify_sequenced(df, count).collect():
            bad.setdefault(r.session_id, set()).add((r.block_seq, r.rule))
        for k, (recs, n) in plain.items():
            if n > 2 and count == 2:
                continue
            want = set(model.verify([(i, p, seq, size, ack) for i, p, _, seq, size, ack in recs], count))
            assert bad.get(k, set()) == want, (k, count, recs)


def test_merge_order_verifies(spark):
    """What the merge gives is always a valid stored order."""
    rnd = random.Random(4)
    rows = []
    for k in range(60):
        sent, clock = [0, 0], [rnd.randrange(50), rnd.randrange(50)]
        for i in range(20):
            p, n = rnd.randrange(2), rnd.randrange(1, 40)
            clock[p] += rnd.randrange(5)
            rows.append(rec(i, k, p, b"y" * n, clock[p], sent[p], sent[1 - p]))
            sent[p] += n
    merged = order.causal_merge(spark.createDataFrame(rows, REC)).withColumn("block_seq", F.col("merge_rank"))
    assert order.verify_sequenced(merged, 2).isEmpty()


def test_intervals_by_points(spark):
    rnd = random.Random(5)
    a, b, ext = [], [], []
    for k in range(60):
        for side in (a, b):
            for _ in range(rnd.randrange(0, 5)):
                s = rnd.randrange(20)
                side.append((k, s, s + rnd.choice([0, 1, 3, 8])))
        ext.append((k, rnd.randrange(0, 25)))
    frame = lambda rows: spark.createDataFrame(rows, "k bigint, off_start bigint, off_end bigint")
    points = lambda rows: {k: {x for q, s, e in rows if q == k for x in range(s, e)} for k in range(60)}
    pa, pb, ends = points(a), points(b), dict(ext)

    def check(df, want):
        rows = [tuple(r) for r in df.select("k", "off_start", "off_end").collect()]
        assert points(rows) == {k: want(k) for k in range(60)}
        assert all(s < e for _, s, e in rows)
        for k, s, _ in rows:
            assert not any(q == k and t == s for q, _, t in rows)  # maximal

    check(intervals.coalesce(frame(a), ["k"]), lambda k: pa[k])
    check(intervals.intersect(frame(a), frame(b), ["k"]), lambda k: pa[k] & pb[k])
    check(intervals.subtract(frame(a), frame(b), ["k"]), lambda k: pa[k] - pb[k])
    check(intervals.complement(frame(a), spark.createDataFrame(ext, "k bigint, extent bigint"), ["k"]), lambda k: set(range(ends[k])) - pa[k])


def test_resolve_refuses_a_circle(spark):
    ranges = spark.createDataFrame([("f", 1, 0, 0, 0, 5, [])], "path string, session_id bigint, pid int, block_seq bigint, off_start bigint, off_end bigint, spans array<struct<source_id:int,in_session_id:bigint,in_pid:int,off_start:bigint,off_end:bigint>>")
    ppl = spark.createDataFrame([("f", -1, 1, 0, [], None, (0, 1, 0))], PPL)
    src = spark.createDataFrame([("f", -9, 0, 1, "self", None)], SRC)
    files = spark.createDataFrame([("self", "f")], "uri string, path string")
    wanted = spark.createDataFrame([(1, "f", 1, 0, 0, 5)], "id bigint, path string, session_id bigint, pid int, off_start bigint, off_end bigint")
    provenance.MOST_HOPS, old = 3, provenance.MOST_HOPS
    try:
        with pytest.raises(ValueError, match="too long"):
            provenance.resolve_spans(wanted, ranges, ppl, src, files)
    finally:
        provenance.MOST_HOPS = old


def test_content(spark):
    import struct

    rows = [(struct.pack("<I", 1234), "prim:u32"), (b"\xff\xff", "prim:i16"), (b"abc", "prim:u32"), (b"\xff" * 8, "prim:u64"), (b"\x00" * 7 + b"\x80", "prim:i64"), (b"\x80", "prim:i8"), (b"abc", "prim:bytes"), (b"a", "prim:odd"), (b'{"a":1}', "mime: Application/JSON; q=1"), (b"z", "dec:t:1"), (b"z", "plain"), (b"", None)]
    df = spark.createDataFrame(rows, "payload binary, label string")
    reg = content.ContentRegistry()
    reg.register_mime("application/json", lambda p: F.get_json_object(F.decode(p, "utf-8"), "$.a"))
    reg.register_dec("d", "t:1", lambda p: F.hex(p))
    for bad in (lambda: reg.register_mime("a/b; c=d", None), lambda: reg.register_mime("", None), lambda: reg.register_dec("", "t", None)):
        with pytest.raises(ValueError):
            bad()
    got = df.select(content.scheme("label").alias("s"), content.value("label").alias("v"), reg.text("payload", "label", F.lit("d")).alias("c"), content.prim_fault("payload", content.value("label")).alias("f")).collect()
    assert [r.c for r in got] == ["1234", "-1", None, str(2**64 - 1), str(-(2**63)), "-128", None, None, "1", "7A", None, None]
    assert [(r.s, r.v) for r in got][8:] == [("mime", " Application/JSON; q=1"), ("dec", "t:1"), ("", "plain"), (None, None)]
    assert [r.f is None for r in got][:8] == [True, True, False, True, True, True, True, False]
    times = [(0, 1000, None), (-1, 1000, None), (1, 3, 7), (10**18, 10**9, None), (54, 2**32, None), (-54, 2**32, 3), (-(10**9) - 1, 3, None), (7, 2**62 + 1, -9)]
    # ticks whose remainder comes within a hair of the next microsecond
    times += [(t, 2**32, 0) for t in range(2**20, 2**20 + 200000, 4001)] + [(54370672, 2**32, None)]
    clock = spark.createDataFrame(times, "t bigint, hz bigint, e bigint").select(F.unix_micros(content.wallclock("t", "hz", "e"))).collect()
    assert [r[0] for r in clock] == [(t + (e or 0)) * 10**6 // hz for t, hz, e in times]
    read = df.select("payload", reg.content("payload", "label", F.lit("d")).alias("c"), reg.text("payload", "label", F.lit("d")).alias("t")).collect()
    assert all(r.c == (r.t.encode() if r.t is not None else r.payload) for r in read)
    sure = df.where("label in ('prim:u32', 'prim:bytes')").where("octet_length(payload) = 4")
    assert sure.count() and all(r.c is not None for r in sure.select(reg.content("payload", "label", strict=True).alias("c")).collect())
    with pytest.raises(Exception, match="no reading of"):
        df.select(reg.content("payload", "label", strict=True)).collect()
    assert spark.range(1).select(content.digest(F.lit(b"abc"), "blake2b")).first()[0].startswith("blake2b:ba80a5")
    assert [bytes(r[0]) for r in spark.createDataFrame([(b"",), (b"a",), (b"abcd",)], "b binary").select(content.padded("b")).collect()] == [b"", b"a\0\0\0", b"abcd"]
    n = spark.createDataFrame([(-1,), (0,), (2**32,)], "n bigint").select(content.in_range("n", "u32"), content.in_range("n", "i64")).collect()
    assert [tuple(r) for r in n] == [(False, True), (True, True), (False, True)]
    from datetime import datetime, timezone

    assert content.unix_seconds(datetime(1970, 1, 1, 0, 0, 5, tzinfo=timezone.utc)) == 5 == content.unix_seconds(5)
    with pytest.raises(ValueError):
        content.unix_seconds(datetime(1970, 1, 1))
    kinds = spark.createDataFrame([("skipped", None), ("gap", None), ("own", "hole"), ("own", None), (None, None)], "r string, c string").select(content.recoverability("r", "c")).collect()
    assert [r[0] for r in kinds] == ["bytes", "hole", "hole", None, None]
    assert S.REASONS["truncated"] == "hole"


def test_resolve_leaves_rows_where_they_are(spark, monkeypatch):
    """Inputs that are dealt by session meet without another shuffle, and chains give the same in one plan and hop by hop."""
    spans = "array<struct<source_id:int,in_session_id:bigint,in_pid:int,off_start:bigint,off_end:bigint>>"
    session = spark.range(20, numPartitions=1).select(F.col("id").alias("s")).repartition("s")
    rows = lambda path, n, width, said: session.select(
        F.lit(path).alias("path"), F.col("s").alias("session_id"), F.lit(0).alias("pid"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("block_seq")
    ).select("*", (F.col("block_seq") * width).alias("off_start"), (F.col("block_seq") * width + width).alias("off_end")).withColumn("spans", said.cast(spans))
    own = F.array(F.struct(F.lit(0), F.col("session_id") + 100, F.lit(0), "off_start", "off_end"))
    ranges = rows("a", 2, 10, F.array()).unionByName(rows("b", 5, 4, F.array())).unionByName(rows("c", 3, 8, own))
    origin = F.struct(F.lit(0).alias("source_id"), F.col("s").alias("session_id"), F.lit(0).alias("pid"))
    ppl = session.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("path"), F.col("s").alias("session_id"), F.lit(0).alias("pid"), origin.alias("origin"))
    src = spark.createDataFrame([("a", -9, 0, 1, "of b", None), ("b", -9, 0, 1, "of c", None)], SRC)
    files = spark.createDataFrame([("of b", "b"), ("of c", "c")], "uri string, path string")
    wanted = rows("a", 2, 10, F.array()).select("session_id", "block_seq", "off_start", "off_end", F.lit("a").alias("path"), F.lit(0).alias("pid"), F.col("session_id").alias("own"), F.col("block_seq").alias("turn"))
    resolve = lambda: provenance.resolve_spans(wanted, ranges, ppl, src, files, ids=("own", "turn"), width=8)
    meet = lambda x, y: x[0] < y[1] and y[0] < x[1]
    cut_at = lambda n, width: [(i * width, i * width + width) for i in range(n)]
    want = sorted((s, t, "c", s + 100, *c) for s in range(20) for t, a in enumerate(cut_at(2, 10)) for b in cut_at(5, 4) if meet(a, b) for c in cut_at(3, 8) if meet(b, c))
    got = lambda df: sorted(tuple(r) for r in df.select("own", "turn", "file", "in_session_id", "off_start", "off_end").collect())
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        counted = resolve().groupBy("own", "turn").count()
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "SortMergeJoin" in plan and "ENSURE_REQUIREMENTS" not in plan
    assert got(resolve()) == want
    monkeypatch.setattr(provenance, "PLANNED_HOPS", 1)
    assert got(resolve()) == want


def test_moments_beyond_timestamps(spark):
    """One that no timestamp holds is null and does not fail the others; the last ones that fit are there."""
    top = 2**63
    times = [(-1, 3, None), (top - 1, 10**6, 0), (top - 1, 10**6, 1), (-top, 10**6, 0), (-top, 10**6, -1), (top - 1, 1, top - 1), (-top, 1, -top), (top - 1, 3, 7), (top - 1, top - 1, top - 1), (None, 3, 0), (5, 10**6 + 1, -top)]
    df = spark.createDataFrame(times, "t bigint, hz bigint, e bigint")
    exact = [None if t is None else (t + (e or 0)) * 10**6 // hz for t, hz, e in times]
    want = [x if x is not None and -top <= x < top else None for x in exact]
    assert want.count(None) == 6
    assert [r[0] for r in df.select(F.unix_micros(content.wallclock("t", "hz", "e"))).collect()] == want
    with pytest.raises(Exception, match="no timestamp holds"):
        df.select(F.unix_micros(content.wallclock("t", "hz", "e", strict=True))).collect()
    held = [x for x in zip(times, want, strict=True) if x[0][0] is None or x[1] is not None]
    kept = spark.createDataFrame([t for t, _ in held], "t bigint, hz bigint, e bigint").select(F.unix_micros(content.wallclock("t", "hz", "e", strict=True))).collect()
    assert [r[0] for r in kept] == [x for _, x in held]
