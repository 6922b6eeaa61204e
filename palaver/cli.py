"""Command line: info, cat, convert, validate, merge.

Exit codes: 0 clean, 1 findings, 2 an error.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .operators import conformance, coverage, offsets, order
from .sources import build, container, datasource, jsonl


def info(spark: SparkSession, path: str, out=print) -> int:
    blocks = container.load(spark, path)
    t = container.tables(blocks)
    faces = {r.path: r.face for r in container.faces(spark, path).collect()}
    for face in sorted(set(faces.values()), key=str):
        out(f"face:      {face}")
    for h in t["headers"].orderBy("path").collect():
        out(f"complete:  {h.complete}" + ("  (truncated)" if h.truncated else ""))
        out(f"clock:     {h.tick_hz} ticks/s" + ("  single-clock" if (h.flags or 0) & S.SINGLE_CLOCK else ""))
        for name in ("creator", "produced_by", "produced_at"):
            if h[name] is not None:
                out(f"{name}: {h[name]}")
    for s in t["sources"].orderBy("path", "block_seq").collect():
        out(f"source {s.source_id}: {S.KIND_LABELS.get(s.kind, s.kind)} {s.uri or ''}".rstrip())
    for d in t["decoders"].orderBy("path", "block_seq").collect():
        out(f"decoder {d.decoder_id}: {d.name} {d.version or ''}".rstrip())
    for line in summary(t).orderBy("path", "session_id").toLocalIterator():
        out(line.text)
        for stream in line.streams:
            out(f"  stream {stream.pid}: {stream.provenance or 'unresolvable'} {stream.layer or 'unresolvable'}")
    broken = False
    for d in container.diagnostics(blocks).toLocalIterator():
        broken |= d.category == "broken-file"
        print(f"note: {d.category}: {d.message}", file=sys.stderr)
    return 2 if broken else 0


def summary(t: dict[str, DataFrame]) -> DataFrame:
    """One line for each session, with its streams' provenance and layer."""
    key = ["path", "session_id"]
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"])
    streams = offsets.stream_kind(facts).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("pid", "provenance", "layer"))).alias("streams"))
    innermost = F.coalesce(F.try_element_at("endpoints", F.lit(-1)), F.concat(F.lit("pid "), F.col("pid").cast("string")))
    people = t["participants"].groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pid", innermost.alias("e")))), lambda x: x["e"]), ", ").alias("people"))
    counts = t["records"].groupBy(*key).agg(F.count("*").alias("n"))
    ends = t["session_ends"].select(*key, F.coalesce("reason", F.lit("yes")).alias("end"))
    s = t["sessions"].join(streams, key, "left").join(people, key, "left").join(counts, key, "left").join(ends, key, "left")
    text = F.concat(
        F.lit("session "), container.unsigned(F.col("session_id")).cast("string"), F.lit(": proto="), F.coalesce("proto", F.lit("?")), F.coalesce(F.concat(F.lit(" key='"), F.col("flow_key"), F.lit("'")), F.lit("")),
        F.lit(" participants=["), F.coalesce("people", F.lit("")), F.lit("] records="), F.coalesce("n", F.lit(0)).cast("string"),
        F.when(F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(1)) == 1, " sequenced").otherwise(""), F.coalesce(F.concat(F.lit(" end="), F.col("end")), F.lit("")),
    )
    return s.select(*key, text.alias("text"), F.coalesce("streams", F.array()).alias("streams"))


def cat(spark: SparkSession, path: str, out=print) -> int:
    system, name = datasource.filesystem(path)
    with system.open_input_file(name) as source:
        for row in datasource.rows_of(source):
            if row["block_type"] is not None and not row.get("parse_error"):
                out(jsonl.dumps(row))
    return 0


def convert(spark: SparkSession, path: str, folder: str, to: str, out=print) -> int:
    written, lost = container.convert(spark, path, folder, face=to)
    for r in written.collect():
        out(f"{r.file}: {r.blocks} blocks, {r.bytes} bytes")
    notes = 0
    for d in lost.toLocalIterator():
        notes += 1
        print(f"note: {d.category}: {d.message}", file=sys.stderr)
    return 1 if notes else 0


def validate(spark: SparkSession, path: str, *, strict: bool = False, verify: bool = False, raw: str | None = None, out=print) -> int:
    blocks = container.load(spark, path, strict=strict)
    t = container.tables(blocks)
    count = 0

    def say(where, category, message):
        nonlocal count
        count += 1
        out(f"{where}: {category}: {message}")

    for d in container.diagnostics(blocks).toLocalIterator():
        say(d.path, d.category, d.message)
    for f in conformance.findings(t, blocks).orderBy("path", "block_seq").toLocalIterator():
        say(f.path, f.category, f"{f.rule} {f.message}" + (f" (block {f.block_seq})" if f.block_seq is not None else ""))
    if verify:
        flagged = t["sessions"].where(F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(1)) == 1).select("path", "session_id")
        for v in order.verify_sequenced(t["records"].join(flagged, ["path", "session_id"], "left_semi")).orderBy("path", "block_seq").toLocalIterator():
            say(v.path, "sequenced-order", f"session {v.session_id}, block {v.block_seq}: {v.rule}")
    if raw:
        u = container.tables(container.load(spark, raw))
        facts = offsets.stream_facts(u["participants"], u["records"], u["decoders"], u["sources"])
        extents = offsets.stream_extent(offsets.record_ranges(u["records"], u["discontinuities"], facts), u["participants"])
        source = coverage.input_source(t["sources"], container.digests(spark, raw).first().digest)
        for f in coverage.check_coverage(t["records"], t["undecoded"], t["session_ends"], source, extents).orderBy("in_session_id", "in_pid", "offset").toLocalIterator():
            say(f.path, f.category, f"input stream (session {f.in_session_id}, pid {f.in_pid}): {f.message}")
    return 1 if count else 0


def merge(spark: SparkSession, a: str, b: str, target: str, produced_by: str, out=print) -> int:
    folder, _, name = target.rpartition("/")
    sides = [container.tables(container.load(spark, p)) for p in (a, b)]
    digests = tuple(container.digests(spark, p).first().digest for p in (a, b))
    t = build.merged(*sides, name, uris=(a, b), digests=digests, produced_by=produced_by, produced_at=int(time.time()))
    for r in container.write(build.build(t), folder or ".").collect():
        out(f"{r.file}: {r.blocks} blocks")
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="palaver", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "cat"):
        sub.add_parser(name).add_argument("file")
    c = sub.add_parser("convert")
    c.add_argument("file")
    c.add_argument("folder")
    c.add_argument("--to", choices=["binary", "jsonl"], required=True)
    v = sub.add_parser("validate")
    v.add_argument("file")
    v.add_argument("--strict", action="store_true")
    v.add_argument("--verify", action="store_true")
    v.add_argument("--input")
    m = sub.add_parser("merge")
    m.add_argument("side_a")
    m.add_argument("side_b")
    m.add_argument("-o", "--output", required=True)
    m.add_argument("--produced-by", default="palaver")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("palaver").getOrCreate()
    try:
        if a.command == "info":
            return info(spark, a.file)
        if a.command == "cat":
            return cat(spark, a.file)
        if a.command == "convert":
            return convert(spark, a.file, a.folder, a.to)
        if a.command == "validate":
            return validate(spark, a.file, strict=a.strict, verify=a.verify, raw=a.input)
        return merge(spark, a.side_a, a.side_b, a.output, a.produced_by)
    except Exception as e:  # noqa: BLE001
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
