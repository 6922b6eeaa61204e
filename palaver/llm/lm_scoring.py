"""Operator 3 - LM scoring by cross-entropy difference.

Two bigram models, one of target documents and one of all documents, share one
vocabulary and are smoothed alike.  The vocabulary is the words that the corpus
holds ``floor`` times or more; all others are one unknown word, in words and in
pairs.  Words and pairs are counted exactly, by 64-bit key.  A word's
probability is

    m * c(previous, word) / c(previous) + (1 - m) * (WORD * c(word) / n + (1 - WORD) / V)

with m = MIX, or 0 after a word that the model has not seen, and V the size of
the vocabulary with the unknown word; a model without words is flat, 1 / V.

No document is scored by itself: its own counts are taken out of each model that
it went into (leave one out), so a target and a document like it that is no
target are scored alike.  A document that is there twice does meet its copy.

A document's score is the mean over its words of -log2 p_target + log2 p_all:
the lower, the more it is like the target.  Counts are over all words of all
documents of either kind.

Documents are dealt by doc_id into chunks of about ``CHUNK`` stored bytes, as
many as the input needs.  In a first round a chunk sends its different words,
sorted and with its counts, to ranges of the hash; a range sums the counts of
all chunks and sends each chunk the sums of just the words that it asked for, in
its order and so without the words.  A second round does the same with pairs of
the words that are known by then.  Chunk and sums then meet, and documents are
scored.  Tables grow with the input in number, not in size, and nothing comes to
the driver.  A chunk sends a key once, however often it has it, so a common word
or pair is one row of a block.  Targets are found chunk by chunk, so no key
gathers more rows than repeat one id.

Cases: null text has no words and a null score; without target documents the
target model is the flat one; a document's first word follows a start id; rows
that repeat a doc_id are each counted and scored, and each without its own
counts only; null ids are background only and are dealt by their text; an empty
table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import groups_for

FLOOR = 2
MIX, WORD = 0.6, 0.9
SLICE = 2_000_000
#: Stored bytes of documents in a chunk.
CHUNK = 2 << 20
#: Chunks for each range of the hash.
WIDE = 2
_U = np.uint64
_START, _UNKNOWN = _U(0x5BD1E995C6A4A793), _U(0x2545F4914F6CDD1D)
_WORDS, _PAIRS, _TARGETS = 0, 1, 2


def words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word, and n + 1 bounds of texts."""
    raw, offsets = tk.string_buffers(column)
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    with np.errstate(over="ignore"):
        for i, j in tk.slices(offsets, SLICE):
            w = tk.split_words(*tk.part(raw, offsets, i, j))
            keys.append(tk.hash_words(w))
            counts.append(np.diff(w.first))
    return np.concatenate(keys), np.cumsum(np.concatenate(counts))


def pairs(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The key of each word with the word before it, the start at a text's first."""
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first[:-1][np.diff(first) > 0]] = _START
    with np.errstate(over="ignore"):
        return tk.mix(before * _U(0x9E3779B97F4A7C15) + word)


def _with_starts(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The keys of words, then the start for each text that has words."""
    return np.append(word, np.full(int((np.diff(first) > 0).sum()), _START))


def pack(x: np.ndarray) -> bytes:
    """Numbers from 0 as planes of bytes, lowest first, as many as the greatest needs."""
    if not len(x):
        return b""
    width = max(1, -(-int(x.max()).bit_length() // 8))
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        planes = np.frombuffer(data, np.uint8).reshape(-1, n)
        out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _bounds(ranges: int) -> np.ndarray:
    return np.array([(r << 64) // ranges for r in range(ranges)], np.uint64)


_ASKED = pa.schema([("range", pa.int32()), ("chunk", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("keys", pa.binary()), ("every", pa.binary()), ("target", pa.binary())])
_SUMS = pa.schema(
    [("chunk", pa.int32()), ("range", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("every", pa.binary()), ("target", pa.binary())]
    + [(c, pa.int64()) for c in ("known", "n_every", "n_target", "unknown_every", "unknown_target")]
)
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64()), ("ce_target", pa.float64()), ("ce_background", pa.float64()), ("ce_difference", pa.float64())])


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema) if rows else schema.empty_table()


def _blocks(chunk: int, kind: int, key: np.ndarray, mark: np.ndarray, bounds: np.ndarray) -> list[tuple]:
    """A row for each range: the chunk's different keys there, how often it has them, and how often in targets."""
    u, at, n = np.unique(key, return_inverse=True, return_counts=True)
    t = np.bincount(at[mark], minlength=len(u))
    edge = np.append(np.searchsorted(u, bounds), len(u))
    return [
        (r, chunk, kind, j - i, pack(np.diff(u[i:j], prepend=bounds[r])), pack(n[i:j]), pack(t[i:j]))
        for r, (i, j) in enumerate(zip(edge, edge[1:], strict=False))
    ]


def _targets(docs: pa.Table, ids: np.ndarray) -> np.ndarray:
    own = docs["doc_id"].combine_chunks()
    return np.isin(own.fill_null(0).to_numpy(zero_copy_only=False), ids) & own.is_valid().to_numpy(zero_copy_only=False)


def _ask_words(ranges: int):
    bounds = _bounds(ranges)

    def run(docs, targets):
        """The chunk's words, and which of its documents are targets (for itself)."""
        if not docs.num_rows:
            return _ASKED.empty_table()
        chunk = docs["chunk"][0].as_py()
        word, first = words(docs["text"])
        ids = np.unique(targets["doc_id"].to_numpy())
        wanted, size = _targets(docs, ids), np.diff(first)
        rows = _blocks(chunk, _WORDS, _with_starts(word, first), np.append(np.repeat(wanted, size), wanted[size > 0]), bounds)
        return _table([*rows, (chunk % ranges, chunk, _TARGETS, len(ids), ids.astype("<i8").tobytes(), b"", b"")], _ASKED)

    return run


def _sum(ranges: int, floor: int):
    bounds = _bounds(ranges)

    def run(asked):
        """For each block of keys the sums over all chunks, in the block's order; of words also what the range holds in all."""
        out, rows = [], asked.to_pylist()
        for kind in (_WORDS, _PAIRS):
            blocks = [x for x in rows if x["kind"] == kind]
            if not blocks:
                continue
            cut = np.cumsum([0] + [x["n"] for x in blocks])
            with np.errstate(over="ignore"):
                key = np.concatenate([np.cumsum(unpack(x["keys"], x["n"]), dtype=np.uint64) + bounds[x["range"]] for x in blocks])
            u, at = np.unique(key, return_inverse=True)
            del key
            # sums of counts below 2**53, exact as floats
            sums = [np.bincount(at, np.concatenate([unpack(x[c], x["n"]) for x in blocks]), len(u)).astype(np.int64) for c in ("every", "target")]
            told = (None,) * 5
            if kind == _WORDS:
                real, rare = u != _START, (u != _START) & (sums[0] < floor)
                told = int(real.sum() - rare.sum()), *(int(s[real].sum()) for s in sums), *(int(s[rare].sum()) for s in sums)
            for x, i, j in zip(blocks, cut, cut[1:], strict=False):
                out.append((x["chunk"], x["range"], kind, x["n"], *(pack(s[at[i:j]]) for s in sums), *told))
        out += [(x["chunk"], x["range"], _TARGETS, x["n"], x["keys"], b"", *(None,) * 5) for x in rows if x["kind"] == _TARGETS]
        return _table(out, _SUMS)

    return run


class _Known:
    """A chunk's documents in words of the vocabulary, with what the first round told."""

    def __init__(self, docs: pa.Table, sums: list[dict], floor: int):
        word, self.first = words(docs["text"])
        self.size = np.diff(self.first)
        heads = sorted((x for x in sums if x["kind"] == _WORDS), key=lambda x: x["range"])
        self.v = 1 + sum(x["known"] for x in heads)
        self.n = {c: sum(x[f"n_{c}"] for x in heads) for c in ("every", "target")}
        every = np.concatenate([unpack(x["every"], x["n"]) for x in heads]).astype(np.int64)
        target = np.concatenate([unpack(x["target"], x["n"]) for x in heads]).astype(np.int64)
        u, at = np.unique(_with_starts(word, self.first), return_inverse=True)
        if len(u) != len(every):
            raise RuntimeError("documents changed between counting and scoring")
        rare = (every < floor) & (u != _START)
        self.word = np.where(rare[at[: len(word)]], _UNKNOWN, word)
        self.unknown = rare[at[: len(word)]]
        # the counts of each word and, behind them, of the start
        self.count = {}
        for c, table in (("every", every), ("target", target)):
            table = np.where(rare, sum(x[f"unknown_{c}"] for x in heads), table)
            self.count[c] = table[at]
        del at, u
        (ids,) = [x["every"] for x in sums if x["kind"] == _TARGETS]
        self.wanted = _targets(docs, np.frombuffer(ids, "<i8"))
        self.doc = np.repeat(np.arange(len(self.size)), self.size)


def _ask_pairs(ranges: int, floor: int):
    bounds = _bounds(ranges)

    def run(docs, sums):
        if not docs.num_rows:
            return _ASKED.empty_table()
        own = _Known(docs, sums.to_pylist(), floor)
        return _table(_blocks(docs["chunk"][0].as_py(), _PAIRS, pairs(own.word, own.first), own.wanted[own.doc], bounds), _ASKED)

    return run


def _logs(word, pair, context, n, v: int) -> np.ndarray:
    """log2 of each word's probability, from the counts of words, pairs and the words before, of n words in all."""
    flat = np.where(n > 0, WORD * word / np.maximum(n, 1) + (1 - WORD) / v, 1 / v)
    mix = np.where(context > 0, MIX, 0)
    return np.log2(mix * pair / np.maximum(context, 1) + (1 - mix) * flat)


def _own(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each key stands in its own document, some documents at a time."""
    out = [np.zeros(0, np.int32)]
    for i, j in tk.slices(first, 1 << 18):
        u, at = np.unique(key[first[i] : first[j]], return_inverse=True)
        doc = np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
        _, at, n = np.unique(doc * len(u) + at, return_inverse=True, return_counts=True)
        out.append(n[at].astype(np.int32))
    return np.concatenate(out)


def _score(floor: int):
    def run(docs, sums):
        if not docs.num_rows:
            return _SCORES.empty_table()
        rows = sums.to_pylist()
        k = _Known(docs, rows, floor)
        n, full = k.size, np.flatnonzero(k.size)
        pair = pairs(k.word, k.first)
        u, at = np.unique(pair, return_inverse=True)
        at = at.astype(np.int32)
        own_word, own_pair = _own(k.word, k.first), _own(pair, k.first)
        own_context = np.empty_like(own_word)
        own_context[1:] = own_word[:-1]
        own_context[k.first[full]] = 1
        means = []
        for c in ("target", "every"):
            blocks = sorted((x for x in rows if x["kind"] == _PAIRS), key=lambda x: x["range"])
            table = np.concatenate([unpack(x[c], x["n"]) for x in blocks]).astype(np.int64)
            if len(table) != len(u):
                raise RuntimeError("documents changed between counting and scoring")
            word, of_pair = k.count[c][: len(k.word)], table[at]
            context = np.empty_like(word)
            context[1:] = word[:-1]
            context[k.first[full]] = k.count[c][len(k.word) :]
            # what the document itself brought to this model is taken out
            brought = np.ones(len(n), bool) if c == "every" else k.wanted
            out = brought[k.doc]
            total = (k.n[c] - np.where(brought, n, 0))[k.doc]
            mean = np.full(len(n), np.nan)
            if len(full):
                logs = _logs(word - out * own_word, of_pair - out * own_pair, context - out * own_context, total, k.v)
                mean[full] = -np.add.reduceat(logs, k.first[full]) / n[full]
            means.append(mean)
        t, a = means
        some = lambda x: pa.array(x, mask=n == 0)
        unknown = np.bincount(k.doc[k.unknown], minlength=len(n))
        return pa.Table.from_arrays([docs["doc_id"], pa.array(n, pa.int64()), pa.array(unknown, pa.int64()), some(t), some(a), some(t - a)], schema=_SCORES)

    return run


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def lm_scoring(docs: DataFrame, targets: DataFrame, *, floor: int = FLOOR, chunks: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_unknown, ce_target, ce_background, ce_difference (bits a word); ``targets`` has the doc_id of target documents."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = chunks or groups_for(plain, CHUNK)
    ranges = -(-chunks // WIDE)
    chunk = lambda key: F.pmod(key, F.lit(chunks)).cast("int").alias("chunk")
    # all readers of the documents ask for the same exchange, so it is made once
    dealt = plain.select("doc_id", "text", chunk(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")))).groupBy("chunk")
    ids = targets.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", chunk(F.xxhash64("doc_id")))
    summed = lambda asked: asked.groupBy("range").applyInArrow(_sum(ranges, floor), _ddl(_SUMS))
    of_words = summed(dealt.cogroup(ids.groupBy("chunk")).applyInArrow(_ask_words(ranges), _ddl(_ASKED)))
    of_pairs = summed(dealt.cogroup(of_words.groupBy("chunk")).applyInArrow(_ask_pairs(ranges, floor), _ddl(_ASKED)))
    return dealt.cogroup(of_words.unionByName(of_pairs).groupBy("chunk")).applyInArrow(_score(floor), _ddl(_SCORES))
