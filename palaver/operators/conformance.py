"""Rules of a container, each a query, all in one table of findings.

``findings`` gives every violation of every rule on the tables as they are.  A
lenient reader instead drops an offending block before later blocks are checked,
so what it declared is missing for them: ``isolate`` repeats the block rules
without dropped blocks until no more fall.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import content
from ..schema import CAPTURE, DECODED, FILE_INPUT, REASON_CLASSES, REASONS, STREAM, TRANSPORT
from ..stages import cut
from . import coverage, offsets
from .order import seq_regressions

SESSION = ["path", "session_id"]


def _as(rule: str, category: str = "nonconformant", severity: str = "error", message: str | Column = "") -> list[Column]:
    text = F.lit(message) if isinstance(message, str) else message
    return ["path", F.col("block_seq").cast("bigint").alias("block_seq"), F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(None).cast("bigint").alias("offset"), text.alias("message")]


def header_rules(blocks: DataFrame) -> DataFrame:
    """The first block is the header, there is no other, nothing follows the end."""
    end = blocks.where("block_type = 65").groupBy("path").agg(F.min("block_seq").alias("__end"))
    b = blocks.select("path", "block_seq", "block_type").join(end, "path", "left")
    first = b.where("block_seq = 0 and block_type <> 1").select(*_as("C1", message="the first block is not a file header"))
    second = b.where("block_seq > 0 and block_type = 1").select(*_as("C1", message="a second file header"))
    after = b.where("block_seq > __end").select(*_as("C1", message="a block behind the end"))
    return first.unionByName(second).unionByName(after)


def duplicate_ids(table: DataFrame, keys: list[str], what: str) -> DataFrame:
    """All but the first declaration of an id."""
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("block_seq"))
    return table.withColumn("__turn", turn).where("__turn > 1").select(*_as("C2", message=f"{what} id declared twice"))


def undeclared(references: DataFrame, declarations: DataFrame, keys: list[str], what: str, ends: DataFrame | None = None) -> DataFrame:
    """References before their declaration, without one, or behind the end of their session."""
    first = declarations.groupBy(*keys).agg(F.min("block_seq").alias("__declared"))
    r = references.select("path", "block_seq", *[k for k in keys if k != "path"]).join(first, keys, "left")
    message = F.lit(f"undeclared {what}")
    if ends is not None:
        r = r.join(ends.groupBy(*SESSION).agg(F.min("block_seq").alias("__ended")), SESSION, "left")
        late = F.coalesce(F.col("__ended") < F.col("block_seq"), F.lit(False))
        message = F.when(late, F.lit(f"{what} behind the session's end")).otherwise(message)
    else:
        late = F.lit(False)
    bad = F.col("__declared").isNull() | (F.col("__declared") > F.col("block_seq")) | late
    return r.where(bad).select(*_as("C3", message=message))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def _named_sources(t: dict[str, DataFrame]) -> DataFrame:
    """(path, block_seq, source_id, by) of all blocks that name a source: as a record, undecoded range, origin or span."""
    r = t["records"]
    origin = t["participants"].where("origin is not null").select("path", "block_seq", F.col("origin.source_id").alias("source_id"), F.lit("origin").alias("by"))
    span = r.select("path", "block_seq", F.explode("spans").alias("s")).select("path", "block_seq", F.col("s.source_id").alias("source_id"), F.lit("span").alias("by"))
    own = [df.select("path", "block_seq", "source_id", F.lit(by).alias("by")) for df, by in ((r, "record"), (t["undecoded"], "undecoded"))]
    return _union([*own, origin, span.distinct()])


def references(t: dict[str, DataFrame]) -> DataFrame:
    """C3 for sessions, participants, sources and decoders: one join for each kind of declaration."""
    r = t["records"].withColumnRenamed("sender_pid", "pid")
    in_session = [t["participants"], t["session_ends"], r, t["discontinuities"], t["names"]]
    found = [
        undeclared(_union([df.select("path", "block_seq", "session_id") for df in in_session]), t["sessions"], SESSION, "session", t["session_ends"]),
        undeclared(_union([df.select("block_seq", *STREAM) for df in (r, t["discontinuities"], t["names"])]), t["participants"], STREAM, "participant"),
        undeclared(_named_sources(t).drop("by"), t["sources"], ["path", "source_id"], "source"),
        undeclared(_union([df.where("decoder_id is not null").select("path", "block_seq", "decoder_id") for df in (r, t["undecoded"])]), t["decoders"], ["path", "decoder_id"], "decoder"),
    ]
    return _union(found).distinct()


def _kind(df: DataFrame, sources: DataFrame) -> DataFrame:
    """df with the kind of its source, if that is declared before."""
    s = sources.groupBy("path", "source_id").agg(F.min_by("kind", "block_seq").alias("__kind"), F.min("block_seq").alias("__at"))
    return df.join(s, ["path", "source_id"], "left").where("__at is null or __at < block_seq").drop("__at")


def source_kinds(t: dict[str, DataFrame]) -> DataFrame:
    """C5, C6 and the first half of C7: known kinds; spans and origins name input files."""
    by, kind = F.col("by"), F.col("__kind")
    rule = (
        F.when(by.isin("record", "undecoded") & ~kind.isin(CAPTURE, FILE_INPUT), "C5")
        .when((by == "span") & (kind != FILE_INPUT), "C6")
        .when((by == "origin") & (kind != FILE_INPUT), "C7")
    )
    text = F.create_map(*[F.lit(x) for kv in {"C5": "source of unknown kind", "C6": "a span names a source that is no input file", "C7": "an origin names a source that is no input file"}.items() for x in kv])
    bad = _kind(_named_sources(t), t["sources"]).withColumn("__rule", rule).where("__rule is not null")
    out = bad.select(*_as("", message=text[F.col("__rule")]), "__rule").withColumn("rule", F.col("__rule")).drop("__rule")
    return out.distinct()


def streams(t: dict[str, DataFrame], facts: DataFrame) -> DataFrame:
    """C7, C9, C10 by stream; a finding stands at the participant, C10 at the last break."""
    p = t["participants"].groupBy(*STREAM).agg(F.min("block_seq").alias("block_seq"))
    f = facts.join(p, STREAM)
    out = f.where("origin is not null and has_spans").select(*_as("C7", message="both origin and spans"))
    out = out.unionByName(f.where(f"array_contains(kinds, {FILE_INPUT}) and origin is null and not has_spans").select(*_as("C7", message="neither origin nor spans")))
    out = out.unionByName(f.where(f"not array_contains(kinds, {FILE_INPUT}) and size(kinds) > 0 and origin is not null").select(*_as("C7", message="origin on a captured stream")))
    out = out.unionByName(f.where("size(layers) > 1").select(*_as("C9", message="records of two layers")))
    known = F.array(F.lit(DECODED), F.lit(TRANSPORT))
    out = out.unionByName(f.where(F.size(F.array_except("layers", known)) > 0).select(*_as("C9", message="a layer that is not defined")))
    last = t["discontinuities"].groupBy(*STREAM).agg(F.max("block_seq").alias("block_seq"))
    broken = last.join(facts.select(*STREAM, "layers"), STREAM).where(~F.array_contains("layers", DECODED))
    return out.unionByName(broken.select(*_as("C10", message="a break in a transport stream")))


def derived_header(t: dict[str, DataFrame]) -> DataFrame:
    """Blocks that make a file a derived one, in a file whose header does not say by what and when."""
    lacking = t["headers"].where("produced_by is null or produced_at is null").select("path")
    inputs = t["sources"].where(f"kind = {FILE_INPUT}").select("path", "source_id").distinct()
    origin = t["participants"].where("origin is not null").select("path", "block_seq", F.col("origin.source_id").alias("source_id"))
    blocks = origin.join(inputs, ["path", "source_id"], "left_semi").select("path", "block_seq")
    blocks = blocks.unionByName(t["session_ends"].where("size(extents) > 0").select("path", "block_seq"))
    for name in ("records", "undecoded"):
        blocks = blocks.unionByName(t[name].select("path", "block_seq", "source_id").join(inputs, ["path", "source_id"], "left_semi").select("path", "block_seq"))
    return blocks.join(lacking, "path", "left_semi").select(*_as("C8", message="the header lacks produced_by or produced_at"))


def basis(t: dict[str, DataFrame]) -> DataFrame:
    """C11: a sequenced session without hints says what its order rests on."""
    hints = t["records"].groupBy(*SESSION).agg(F.max((F.col("seq_start").isNotNull() | F.col("ack").isNotNull()).cast("int")).alias("hints"))
    s = t["sessions"].where((F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(1)) == 1) & F.col("sequenced_basis").isNull()).join(hints, SESSION, "left")
    return s.where("coalesce(hints, 0) = 0").select(*_as("C11", message="sequenced without hints or a basis"))


def undecoded_rules(t: dict[str, DataFrame]) -> DataFrame:
    """Ranges of captures, and reason classes."""
    known = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])
    u = _kind(t["undecoded"], t["sources"]).withColumn("__known", known[F.col("reason")])
    own = F.coalesce("reason_class", "__known")
    capture = u.where(f"__kind = {CAPTURE}")
    out = capture.where("in_session_id <> 0 or in_pid <> 0").select(*_as("C12", message="ids in a capture"))
    out = out.unionByName(capture.where(own == "hole").select(*_as("C12", message="a hole in a capture")))
    out = out.unionByName(u.where("reason is not null and __known is null and reason_class is null").select(*_as("C13", message="a reason outside the vocabulary needs a class")))
    out = out.unionByName(u.where(~F.col("reason_class").isin(*REASON_CLASSES)).select(*_as("C13", message="a class that is not defined")))
    differs = F.col("reason_class").isin(*REASON_CLASSES) & (F.col("__known") != F.col("reason_class"))
    return out.unionByName(u.where(differs).select(*_as("C13", message="the class contradicts the reason")))


def params_digest(t: dict[str, DataFrame]) -> DataFrame:
    """C14: transform_params_digest needs a stream that comes from a file."""
    inputs = t["sources"].where(f"kind = {FILE_INPUT}").select("path", "source_id").distinct()
    derived = t["records"].join(inputs, ["path", "source_id"], "left_semi").select("path").union(t["participants"].where("origin is not null").select("path")).distinct()
    return t["headers"].where("transform_params_digest is not null").join(derived, "path", "left_anti").select(*_as("C14", message="parameters of a transform in a captured file"))


def advisories(t: dict[str, DataFrame]) -> DataFrame:
    """A1 and A2: labels that do not fit; the record stays."""
    r = offsets.with_layer(t["records"], t["decoders"]).where("content_type is not null")
    fault = content.prim_fault("payload", content.value("content_type"))
    prim = r.where((content.scheme("content_type") == "prim") & fault.isNotNull()).select(*_as("A1", severity="advisory", message=fault))
    transport = r.where(F.col("layer").isNotNull() & (F.col("layer") != DECODED)).select(*_as("A2", severity="advisory", message="a label on a transport record"))
    return prim.unionByName(transport)


def block_rules(t: dict[str, DataFrame]) -> DataFrame:
    """The rules that speak of one block, by which a lenient reader drops it."""
    out = references(t)
    for df, keys, what in (
        (t["sources"], ["path", "source_id"], "source"),
        (t["decoders"], ["path", "decoder_id"], "decoder"),
        (t["sessions"], SESSION, "session"),
        (t["participants"], STREAM, "participant"),
    ):
        out = out.unionByName(duplicate_ids(df, keys, what))
    order = seq_regressions(t["records"]).select(*_as("C4", message="seq_start before that of the record before"))
    return out.unionByName(order).unionByName(source_kinds(t)).unionByName(derived_header(t)).unionByName(undecoded_rules(t))


def file_rules(t: dict[str, DataFrame]) -> DataFrame:
    """The rules that a stream's or a file's end settles."""
    facts = offsets.stream_facts(t["participants"], t["records"], t["decoders"], t["sources"])
    out = streams(t, facts).unionByName(basis(t)).unionByName(params_digest(t))
    broken = coverage.unmarked_breaks(t["records"], t["discontinuities"], t["undecoded"], facts)
    out = out.unionByName(broken.select(*_as("C15", message="neighbours around a hole without a break")))
    c = coverage.check_extents(t["records"], t["undecoded"], t["sources"], t["session_ends"])
    said = c.select("path", F.lit(None).cast("bigint").alias("block_seq"), F.lit("error").alias("severity"), F.lit("C16").alias("rule"), "category", "offset", "message")
    return out.unionByName(said)


def findings(t: dict[str, DataFrame], blocks: DataFrame | None = None) -> DataFrame:
    """All rules on the tables of one or more files (see palaver.schema.TABLES)."""
    out = block_rules(t).unionByName(file_rules(t)).unionByName(advisories(t))
    return out.unionByName(header_rules(blocks)) if blocks is not None else out


def isolate(t: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the blocks that a lenient reader drops, and the findings that dropped them.

    Only the first offending block of each file is sure to be one, as those
    behind it may suffer from it: each turn drops, in every file, the offending
    blocks up to the first that declares something, until none is left.  A turn
    drops one block at least, so turns end; what fell is kept in one cut table, so
    that the plan of a turn does not grow with their number.
    """
    whole, dropped = t, None
    while True:
        found = block_rules(t)
        declares = None
        for name in ("sources", "decoders", "sessions", "participants", "session_ends"):
            own = t[name].select("path", "block_seq")
            declares = own if declares is None else declares.unionByName(own)
        bad = found.select("path", "block_seq").distinct()
        edge = bad.join(declares, ["path", "block_seq"], "left_semi").groupBy("path").agg(F.min("block_seq").alias("__edge"))
        # a record dropped for its order changes what the next is held against
        order = found.where("rule = 'C4'").groupBy("path").agg(F.min("block_seq").alias("__order"))
        now = found.join(edge, "path", "left").join(order, "path", "left").where("block_seq <= least(coalesce(__edge, block_seq), coalesce(__order, block_seq))")
        now = cut(now.select(*found.columns))
        if now.isEmpty():
            return t, dropped if dropped is not None else now
        dropped = now if dropped is None else cut(dropped.unionByName(now))
        gone = dropped.select("path", "block_seq").distinct()
        t = {name: df.join(gone, ["path", "block_seq"], "left_anti") for name, df in whole.items()}

