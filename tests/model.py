"""Sequential models of operators, and a small builder of block rows."""

from palaver import schema as S

HALF, SPACE = 1 << 31, 1 << 32


def lt(a, b):
    return a != b and (a - b) % SPACE >= HALF


def leq(a, b):
    return a == b or lt(a, b)


def ranges(blocks, isn, decoded):
    """blocks: ('r', length, seq) or ('b', width); offsets of the records."""
    records = [b for b in blocks if b[0] == "r"]
    origin = None
    if not decoded:
        origin = (isn + 1) % SPACE if isn is not None else next((b[2] for b in records if b[2] is not None), None)
    at, out = 0, []
    if origin is None:
        for b in blocks:
            if b[0] == "b":
                at += b[1] or 0
            else:
                out.append((at, at + b[1]))
                at += b[1]
        return out
    for _, n, seq in records:
        if seq is None:
            out.append((at, at))
            continue
        start = (seq - origin) % SPACE
        out.append((start, start + n))
        at = max(at, start + n)
    return out


def chunks(records, origin):
    """records: (seq, payload, ts); segments and gaps in order."""
    out, cursor, run = [], 0, None
    for seq, data, ts in records:
        if seq is None:
            continue
        if origin is None:
            origin = seq
        off = (seq - origin) % SPACE
        if off < cursor:
            data, off = data[cursor - off :], cursor
        if not data:
            continue
        if off > cursor:
            if run:
                out.append(("segment", run[0], cursor, run[1], run[2]))
            run = None
            out.append(("gap", cursor, off, None, None))
        run = (off, ts, data) if run is None else (run[0], max(run[1], ts), run[2] + data)
        cursor = off + len(data)
    if run:
        out.append(("segment", run[0], cursor, run[1], run[2]))
    return out


def merge(streams):
    """streams: {pid: [(id, ts, seq, length, ack)]}; ids in order, and whether it stalled."""
    pids, at, out = sorted(streams), dict.fromkeys(streams, 0), []
    head = lambda p: streams[p][at[p]] if at[p] < len(streams[p]) else None

    def ready(p):
        h = head(p)
        if h is None:
            return False
        if len(pids) != 2 or h[4] is None:
            return True
        o = head(pids[1 - pids.index(p)])
        return o is None or o[2] is None or lt(h[4], (o[2] + o[3]) % SPACE)

    while True:
        free = [p for p in pids if ready(p)]
        if not free:
            return out, any(head(p) is not None for p in pids)
        p = min(free, key=lambda q: (head(q)[1], q))
        out.append(head(p)[0])
        at[p] += 1


def verify(records, count=None):
    """records: (id, pid, seq, length, ack); ids that break stored order, all of them."""
    last, most, senders, bad = {}, {}, set(), []
    acks = count in (2, None)
    for i, p, seq, n, ack in records:
        senders.add(p)
        if count is None and len(senders) > 2:
            acks = False
        if seq is not None:
            if p in last and not leq(last[p], seq):
                bad.append((i, "seq-order"))
            last[p] = seq
            if acks and any(q != p and leq((seq + n) % SPACE, a) for q, a in most.items()):
                bad.append((i, "already-acked"))
        if acks and ack is not None and (p not in most or lt(most[p], ack)):
            most[p] = ack
    return bad


def header(**more):
    return {"block_type": S.FILE_HEADER, "version_major": 0, "version_minor": 16, "tick_hz": 1000, "flags": 0} | more


def row(block_type, /, **more):
    return {"block_type": block_type, "flags": 0 if block_type in (S.SESSION, S.RECORD) else None} | more


def span(a, b, source=1, session=7, pid=0):
    return {"source_id": source, "in_session_id": session, "in_pid": pid, "off_start": a, "off_end": b}


def decoded_file(ranges=((0, 100),), undecoded=(), extent=None, **head):
    """A derived file that cites ranges of stream (7, 0)."""
    out = [header(produced_by="t", produced_at=1, **head), row(S.SOURCE, source_id=1, kind=1, uri="raw"), row(S.DECODER, decoder_id=1, output_layer=0, name="d"), row(S.SESSION, session_id=7), row(S.PARTICIPANT, session_id=7, pid=0)]
    out += [row(S.RECORD, session_id=7, pid=0, source_id=1, ts=i, payload=b"x" * (b - a), decoder_id=1, spans=[span(a, b)]) for i, (a, b) in enumerate(ranges)]
    out += [row(S.UNDECODED, source_id=1, session_id=7, pid=0, off_start=a, off_end=b, reason=why) for a, b, why in undecoded]
    ends = [{"source_id": 1, "in_session_id": 7, "in_pid": 0, "extent": extent}] if extent is not None else []
    return [*out, row(S.SESSION_END, session_id=7, extents=ends), row(S.END)]


def raw_file(records=((1001, 100),), isn=1000, **head):
    out = [header(**head), row(S.SOURCE, source_id=0, kind=0, uri="cap"), row(S.SESSION, session_id=7), row(S.PARTICIPANT, session_id=7, pid=0, isn=isn)]
    out += [row(S.RECORD, session_id=7, pid=0, source_id=0, ts=i, payload=bytes([97 + i]) * n, seq_start=s) for i, (s, n) in enumerate(records)]
    return [*out, row(S.SESSION_END, session_id=7), row(S.END)]


def frames(rows):
    from palaver.sources import codec

    return b"".join(codec.frame(r["block_type"], r["content"] if r.get("content") is not None else codec.build_content(r)) for r in rows)
