"""Operator 5 - n-gram Jaccard join by MinHash banding.

Documents are sets of word 5-grams.  Equal sets form one class of copies and go
on as one node.  Bands of MinHash values put nodes in buckets (a shuffle on band
hashes); the number of rows in a band is the largest for which ``most`` hash
functions reach the target recall at the threshold.  Nodes that are joined
through buckets form a candidate component; inside one every pair is verified on
the full sets, in blocks, by counting common 5-grams.  Pairs are counted, not
written, so that a group of g near copies makes g rows and not g * g.

Components above ``BLOCK`` nodes or ``BLOCK_BYTES`` of text are cut into chunks,
and each pair of chunks is a unit of its own; links that cross chunks are put
together by a last components step.  Keys that may hold a large share of the
rows (a bucket, a star's centre, a class, a set with many copies) are met by
``cluster.join_hot``: their rows stay where they are.

Cases: words are those of the text as it is; 1 to 4 words make one gram of them
all; null text or no word: no gram, a class of its own without links; rows that
repeat a doc_id are nodes by their text; a null doc_id stays null and is never a
class's id unless all ids of the class are null; an empty table gives an empty
table; other columns, whatever their names, are not read, and ``keep_one`` keeps
them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import textkernel as tk
from .cluster import free_names, join_hot, materialise, release
from .components import components

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST = 128
BLOCK, BLOCK_BYTES = 1024, 8 << 20
#: Nodes and bytes of text of small components that are verified together.
UNIT_NODES, UNIT_BYTES = 1000, 4 << 20
SLICE = 1_000_000
_U = np.uint64


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST) -> tuple[int, int]:
    """(bands, rows): as many rows as ``most`` functions allow for the recall at the threshold."""
    best = None
    for rows in range(1, 33):
        hit = threshold**rows
        bands = 1 if hit >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-hit)))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


def gram_sets(raw: np.ndarray, offsets: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Different gram hashes of each text, sorted within it, and n + 1 bounds."""
    with np.errstate(over="ignore"):
        w = tk.split_words(raw, offsets)
        h = tk.hash_words(w)
        size = np.diff(w.first)
        starts = tk.window_starts(w.first, n)
        grams, doc = tk.window_hashes(h, n), np.searchsorted(w.first, starts, side="right") - 1
        grams = grams[starts] if len(starts) else np.zeros(0, np.uint64)
        few = np.flatnonzero((size > 0) & (size < n))
        if len(few):  # all words as one gram
            acc = tk.mix(size[few].astype(np.uint64))
            for j in range(n - 1):
                on = size[few] > j
                acc[on] = tk.mix(acc[on] * _U(31) + h[w.first[few[on]] + j])
            grams, doc = np.append(grams, acc), np.append(doc, few)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(size) + 1))


def node_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 64-bit id for each set that is not empty, from two sums over it."""
    full = np.flatnonzero(np.diff(first))
    with np.errstate(over="ignore"):
        if not len(full):
            return np.zeros(0, np.int64)
        one = np.add.reduceat(tk.mix(grams ^ _U(0x1234567)), first[full])
        two = np.add.reduceat(tk.mix(grams + _U(0x9876543)), first[full])
        return tk.mix(tk.mix(one) ^ two * _U(0x9E3779B97F4A7C15)).view(np.int64)


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.Generator(np.random.PCG64(20240501))
    return rnd.integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1), rnd.integers(0, 1 << 63, n, dtype=np.uint64)


def band_hashes(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set that is not empty a hash of each band; the band's number is part of it."""
    full = np.flatnonzero(np.diff(first))
    times, plus = _constants(bands * rows)
    out = np.zeros((len(full), bands), np.uint64)
    if not len(full):
        return out.view(np.int64)
    at = first[full]
    with np.errstate(over="ignore"):
        for b in range(bands):
            acc = np.full(len(full), b + 1, np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                x = grams ^ plus[r]
                x *= times[r]
                x >>= _U(20)
                acc = tk.mix(acc * _U(0x100000001B3) + np.minimum.reduceat(x, at))
            out[:, b] = acc
    return out.view(np.int64)


def _signatures(gram, bands, rows):
    def run(batches):
        for batch in batches:
            raw, offsets = tk.string_buffers(batch.column(1))
            for i, j in tk.slices(offsets, SLICE):
                grams, first = gram_sets(*tk.part(raw, offsets, i, j), gram)
                count = np.diff(first)
                full = np.flatnonzero(count)
                sketch = band_hashes(grams, first, bands, rows)
                node = np.zeros(j - i, np.int64)
                node[full] = node_ids(grams, first)
                at = np.zeros(j - i + 1, np.int32)
                at[1:] = np.cumsum(np.where(count > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(node, mask=count == 0), pa.ListArray.from_arrays(pa.array(at), pa.array(sketch.ravel()))],
                    names=["doc_id", "at", "size", "node", "bands"],
                )

    return run


def linked(grams: np.ndarray, first: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold: a symmetric n x n table, counted on all grams."""
    n, size = len(first) - 1, np.diff(first)
    owner = np.repeat(np.arange(n), size)
    _, col, df = np.unique(grams, return_inverse=True, return_counts=True)
    keep = df[col] > 1
    _, col = np.unique(col[keep], return_inverse=True)
    owner = owner[keep]
    common = np.zeros((n, n), np.float32)
    wide = max(1, (4 << 20) // max(n, 1))
    order = np.argsort(col, kind="stable")
    col, owner = col[order], owner[order]
    top = int(col[-1]) + 1 if len(col) else 0
    for at in range(0, top, wide):
        i, j = np.searchsorted(col, [at, at + wide])
        m = np.zeros((n, min(wide, top - at)), np.float32)
        m[owner[i:j], col[i:j] - at] = 1
        common += m @ m.T
    yes = common * (1 + threshold) >= threshold * (size[:, None] + size[None, :]) - 1e-3
    np.fill_diagonal(yes, False)
    return yes & (size[:, None] > 0) & (size[None, :] > 0)


def _labels(yes: np.ndarray) -> np.ndarray:
    """The least row number of each row's component."""
    label = np.arange(len(yes))
    while True:
        near = np.where(yes, label[None, :], len(yes)).min(axis=1, initial=len(yes))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify(gram, threshold):
    def run(key, table):
        """Rows (node, root, links) of each block of this unit; root is a node of the same component."""
        out_node, out_root, out_links = [], [], []
        table = table.sort_by([("comp", "ascending"), ("low", "ascending"), ("high", "ascending"), ("node", "ascending")])
        block = np.stack([table[c].combine_chunks().to_numpy() for c in ("comp", "low", "high")], axis=1)
        node, chunk = table["node"].combine_chunks().to_numpy(), table["chunk"].combine_chunks().to_numpy()
        raw, offsets = tk.string_buffers(table["text"])
        cut = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(axis=1)))
        for i, j in zip(cut, np.append(cut[1:], len(node)), strict=True):
            grams, first = gram_sets(*tk.part(raw, offsets, i, j), gram)
            found = node_ids(grams, first)
            # rows that repeat a doc_id bring texts of other nodes, and the same node twice
            right = np.flatnonzero(np.diff(first))[found == node[i:j][np.diff(first) > 0]]
            right = right[np.unique(node[i:j][right], return_index=True)[1]]
            take = tk.expand(first[right], np.diff(first)[right])
            bounds = np.append(0, np.cumsum(np.diff(first)[right]))
            yes = linked(grams[take], bounds, threshold)
            own, part = node[i:j][right], chunk[i:j][right]
            low, high = block[i, 1], block[i, 2]
            if low != high:
                yes &= part[:, None] != part[None, :]
            out_node.append(own)
            out_root.append(own[_labels(yes)])
            out_links.append(yes.sum(axis=1))
        return pa.table({"node": np.concatenate(out_node), "root": np.concatenate(out_root), "links": np.concatenate(out_links).astype(np.int64)})

    return run


def ngram_jaccard_join(docs: DataFrame, *, gram: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (least id of the linked group), copy_of (least id with the same set), n_copies, n_links.

    n_copies counts documents with the same set (itself included); n_links
    counts the other sets at or above the threshold.
    """
    bands, rows = banding(threshold, recall, most)
    # a text is found again by its id, or by its hash where it has none
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("at", F.coalesce("doc_id", F.xxhash64("text")))
    signed = materialise(plain.select("doc_id", "text", "at").mapInArrow(_signatures(gram, bands, rows), "doc_id long, at long, size long, node long, bands array<long>"))
    full = signed.where("node is not null")
    nodes = full.groupBy("node").agg(F.first("bands").alias("bands"))
    at = materialise(nodes.select("node", F.explode("bands").alias("b")))
    buckets = at.groupBy("b").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("held")).where("least < most").select("b", "least", "held")
    links = join_hot(at, materialise(buckets), "b", F.col("held"), at.count()).where("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    # a node has a link for each band at most; one to the least of its neighbours, and those to each other, join the same
    links = links.withColumn("m", F.min("v").over(Window.partitionBy("u")))
    links = links.select("u", F.col("m").alias("v")).union(links.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
    candidate = components(links).withColumnRenamed("label", "comp")
    release(at)
    heads = full.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("n_copies"), F.min(F.struct("at", "size")).alias("text"))
    member = materialise(candidate.join(heads, "node").select("node", "comp", "text.at", "text.size"))
    sizes = materialise(member.groupBy("comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")))
    total, total_bytes = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    units = max(1, total // UNIT_NODES, total_bytes // UNIT_BYTES)
    chunks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    # no component has more chunks than nodes
    placed = join_hot(member, sizes, "comp", F.col("n"), total).withColumn("chunks", F.least(chunks, F.col("n").cast("int")))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = (
        placed.select("*", other.alias("with"))
        .withColumns({"low": F.least("chunk", "with"), "high": F.greatest("chunk", "with")})
        .withColumn("unit", F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("comp"), F.lit(units))).otherwise(F.xxhash64("comp", "low", "high")))
    )
    # the texts that are needed first, once each; then to their units
    texts = plain.join(member.select("at", "node").hint("merge"), "at").select("node", "text")
    blocks = dealt.select("node", "comp", "low", "high", "chunk", "unit").join(texts, "node").repartition("unit")
    verified = materialise(blocks.groupBy("unit").applyInArrow(_verify(gram, threshold), "node long, root long, links long"))
    per_node = verified.groupBy("node").agg(F.sum("links").alias("n_links"), F.min("root").alias("root"))
    if not sizes.where((F.col("n") > block) | (F.col("bytes") > BLOCK_BYTES)).isEmpty():
        whole = components(verified.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
        per_node = per_node.drop("root").join(whole.withColumnRenamed("label", "root"), "node", "left")
    per_node = per_node.select("node", "n_links", F.coalesce("root", "node").alias("root"))
    facts = materialise(
        heads.drop("text")
        .join(per_node, "node", "left")
        .select("node", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    classes = materialise(facts.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.count("*").alias("nodes")))
    known = materialise(join_hot(facts, classes, "root", F.col("nodes"), facts.count()).drop("root", "nodes"))
    release(facts, classes, member, sizes, verified)
    out = ["doc_id", "class_id", "copy_of", "n_copies", "n_links"]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = signed.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), one.alias("n_copies"), none.alias("n_links"))
    return join_hot(full.select("doc_id", "node"), known, "node", F.col("n_copies"), signed.count()).select(*out).unionByName(alone)


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """One row of each linked group of docs, that of the least id, with all columns.

    Rows without an id cannot be told apart by the join's result and stay; of
    rows that repeat the least id, one for each different text stays.
    """
    found = ngram_jaccard_join(docs, **settings)
    keep, turn = free_names(docs.columns, "keep", "turn")
    kept = materialise(found.where("doc_id = class_id").select(F.col("doc_id").alias(keep)).distinct())
    one = docs.where("doc_id is not null").join(kept.hint("merge"), F.col("doc_id").cast("long") == F.col(keep), "left_semi")
    order = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, AtomicType)]
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy(*order))
    return one.withColumn(turn, first).where(F.col(turn) == 1).drop(turn).union(docs.where("doc_id is null"))
