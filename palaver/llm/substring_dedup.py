"""Operator 2 - substring dedup by recompression.

Removes every word covered by a window of ``window`` words whose word sequence
also starts in a document with a smaller id.  Windows are judged on the input.

Documents are dealt once, by group, and that exchange is read three times.  In
each group rounds of recompression name runs and pairs of words; names are the
same everywhere, and what they are shared by is settled in Spark, in two rounds
of buckets that each take a part of all names:

1. a group sends each different name once, with its least and largest document
   id: of every window the symbol that the window's own words determine (its
   anchor, of the first ``ROUNDS`` rounds), and the symbols of later rounds that
   span long passages.  Buckets tell which anchors two documents hold, and of
   long symbols the least document;
2. a long symbol that a smaller id holds verifies all windows inside it at once.
   The other windows, if their anchors are shared, go to buckets as keys of their
   words, once for a group, which find the least document of each;
3. per group: words under long symbols and windows with a smaller id are cut.

Equal windows have equal anchors, so none is lost.  A window that lies in a long
symbol of a smaller id is not sent; the least document that holds it does send
it, as no smaller one can hold the symbol, so the least of the others is right.
Long symbols and windows are told apart by 96 bits: 64 of the symbol's name or
of the window's words, and 32 of a second hash of the words themselves.  A very
common passage costs one entry per group, not per document.

Cases: null text counts as empty (0 words, hash of the empty string); a null
doc_id counts as larger than all others; rows that repeat a doc_id each return
a row and never remove each other's words; rows are dealt by id and text, so
neither null ids nor one id gather; texts under 13 words lose nothing; an empty
table gives an empty table; other columns, whatever their names, are not looked
at, and ``cut_repeats`` keeps them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .cluster import stored_size
from .recompression import anchors, long_symbols, rounds

WINDOW = 13
#: Rounds whose contexts fit into a window; and rounds in all.
ROUNDS, LATER = 2, 28
SLICE = 2_000_000
#: Stored bytes of documents in a group, and of the input for a bucket: at least the first, and at most the others.
#: In between both grow with the input, so that groups times buckets, the rows of an exchange, grow no faster.
GROUP_BYTES, MOST_GROUP, MOST_BUCKET = 1 << 20, 48 << 20, 128 << 20
PARTS = 2000
_LAST = np.iinfo(np.int64).max
_B1 = np.uint64(0x9E3779B97F4A7C15)
_B2 = np.uint64(0xC2B2AE3D27D4EB4F)
_INV = {b: np.uint64(pow(int(b), -1, 1 << 64)) for b in (_B1, _B2)}
_KEYS = "bucket int, g int, kind int, base long, keys binary, more binary, least binary, differs binary, most binary"
_TOLD = "g int, kind int, keys binary, more binary, least binary"
_ANCHOR, _LONG, _WINDOW = 0, 1, 2


def _ordered(table: pa.Table) -> pa.Table:
    """The same order in every attempt."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _ids(table: pa.Table) -> np.ndarray:
    return table["doc_id"].combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class _Sums:
    """Hashes of any run of words from prefix sums."""

    def __init__(self, h: np.ndarray, base: np.uint64):
        p, self.back = _powers(base, len(h) + 1), _powers(_INV[base], len(h) + 1)
        self.sums = np.append(np.uint64(0), np.cumsum(h * p[:-1], dtype=np.uint64))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.back[lo]


class _Slice:
    """Words, symbols and anchors of some texts of a group."""

    def __init__(self, raw, offsets, i, j, window, turns):
        self.words = tk.split_words(*tk.part(raw, offsets, i, j))
        self.h = tk.hash_words(self.words)
        self.second = tk.hash_words(self.words, 1)
        self.i, self.window, self.turns = i, window, turns
        self.levels = rounds(self.h, self.words.first, turns)

    def anchor(self):
        """Window starts, and for each the key of its anchor: level, place and words of the context."""
        starts, level, which = anchors(self.levels, self.words.first, self.window)
        sums = _Sums(self.h, _B1)
        key = np.zeros(len(starts), np.uint64)
        for k, x in enumerate(self.levels):
            at = np.flatnonzero(level == k)
            s = which[at]
            lo, hi = x.lo[s], x.hi[s]
            place = ((hi - lo) * 4096 + (x.a[s] - lo) * 64 + k).astype(np.uint64)
            key[at] = tk.mix(sums.of(lo, hi) ^ x.name[s] * _B2 ^ tk.mix(place))
        return starts, key

    def long(self):
        """First and last words and keys of the symbols that span long passages, of a window at least."""
        name, a, b = long_symbols(self.levels[-1], self.turns, LATER)
        on = b - a >= self.window
        name, a, b = name[on], a[on], b[on]
        return a, b, tk.mix(name), (tk.mix(_Sums(self.second, _B2).of(a, b)) >> np.uint64(32)).astype(np.uint32)

    def windows(self, starts):
        m = max(len(self.h) - self.window + 1, 0)
        if not m:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        one = tk.window_hashes(self.h, self.window)[starts]
        two = tk.window_hashes(self.second, self.window, _B2)[starts]
        return one, (two >> np.uint64(32)).astype(np.uint32)

    def docs(self, starts):
        return np.searchsorted(self.words.first, starts, side="right") - 1 + self.i


def _slices(table, window, turns):
    raw, offsets = tk.string_buffers(table["text"])
    for i, j in tk.slices(offsets, SLICE):
        yield _Slice(raw, offsets, i, j, window, turns)


def _folded(keys, more, ids):
    """Sorted different keys, the least and largest id of each, and each input row's place among them."""
    order = np.lexsort((more, keys)) if len(more) else np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    if len(more):
        m = more[order]
        new[1:] |= m[1:] != m[:-1]
    at = np.flatnonzero(new)
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    d = ids[order]
    least = np.minimum.reduceat(d, at) if len(at) else d
    most = np.maximum.reduceat(d, at) if len(at) else d
    return k[at], (more[order][at] if len(more) else more), least, most, place


def _bucket_of(keys, buckets):
    """Buckets are ranges of keys, so sorted keys lie in order of bucket."""
    return ((keys >> np.uint64(40)).astype(np.int64) * buckets) >> 24


def _above(ids, base):
    """Ids as numbers above base, in four bytes each where that does."""
    d = ids.view(np.uint64) - base.view(np.uint64)
    return d.astype("<u4") if not len(d) or d.max() < 1 << 32 else d


def _ids_above(column, base, counts):
    """The ids of _above, of all rows one after the other."""
    out = []
    for x, b, n in zip(column, base, counts, strict=True):
        d = np.frombuffer(x.as_buffer(), "<u4" if len(x.as_buffer()) == 4 * n else "<u8")
        out.append((d.astype(np.uint64) + np.int64(b).view(np.uint64)).view(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _bounds(table):
    """The least and largest id of each key of all rows."""
    rows = {c: [x for chunk in table[c].chunks for x in chunk] for c in ("keys", "least", "differs", "most")}
    base = table["base"].to_pylist()
    counts = np.array([len(x.as_buffer()) // 8 for x in rows["keys"]], np.int64)
    least = _ids_above(rows["least"], base, counts)
    differs, n = _cat(rows["differs"], np.uint32)
    most = least.copy()
    ahead = np.cumsum(counts) - counts
    most[differs + np.repeat(ahead, n)] = _ids_above(rows["most"], base, n)
    return least, most


def _rows(g, kind, keys, more, least, most, buckets):
    """A row for each bucket; the largest id is sent only where it is not the least."""
    cut = np.searchsorted(_bucket_of(keys, buckets), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(cut))
    out = {c: [] for c in ("keys", "more", "least", "differs", "most")}
    base = least.min() if len(least) else np.int64(0)
    for b in full:
        own = slice(cut[b], cut[b + 1])
        other = np.flatnonzero(most[own] != least[own])
        out["keys"].append(keys[own].tobytes())
        out["more"].append(more[own].tobytes())
        out["least"].append(_above(least[own], base).tobytes())
        out["differs"].append(other.astype("<u4").tobytes())
        out["most"].append(_above(most[own][other], base).tobytes())
    return pa.table(
        {"bucket": pa.array(full, pa.int32()), "g": pa.array(np.full(len(full), g), pa.int32()), "kind": pa.array(np.full(len(full), kind), pa.int32()), "base": pa.array(np.full(len(full), base), pa.int64())}
        | {c: pa.array(v, pa.binary()) for c, v in out.items()}
    )


def _cat(column, kind):
    parts = [np.frombuffer(x.as_buffer(), dtype=kind) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def _unbits(column, kind):
    return _cat([x for chunk in column.chunks for x in chunk] if isinstance(column, pa.ChunkedArray) else list(column), kind)


def _group_names(window, turns, buckets):
    def run(key, table):
        """The group's different anchors and long symbols."""
        table = _ordered(table)
        ids, keys, docs, one, two, holders = _ids(table), [], [], [], [], []
        with np.errstate(over="ignore"):
            for s in _slices(table, window, turns):
                starts, key_of = s.anchor()
                # neighbours mostly share their anchor
                d = s.docs(starts)
                new = np.ones(len(starts), bool)
                new[1:] = (key_of[1:] != key_of[:-1]) | (d[1:] != d[:-1])
                keys.append(key_of[new])
                docs.append(ids[d[new]])
                a, _, name, second = s.long()
                one.append(name)
                two.append(second)
                holders.append(ids[s.docs(a)])
            own = _folded(np.concatenate(keys), np.zeros(0, np.uint32), np.concatenate(docs))[:4]
            long = _folded(np.concatenate(one), np.concatenate(two), np.concatenate(holders))[:4]
        g = key[0].as_py()
        return pa.concat_tables([_rows(g, _ANCHOR, *own, buckets), _rows(g, _LONG, *long, buckets)])

    return run


def _told(g, kind, keys, more, least) -> pa.Table:
    """Rows of (g, keys and what goes with them); those without keys are left out."""
    full = [i for i, x in enumerate(keys) if len(x)]
    column = lambda v: pa.array([v[i].tobytes() for i in full], pa.binary())
    return pa.table({"g": g.take(pa.array(full, pa.int64())), "kind": pa.array(np.full(len(full), kind), pa.int32()), "keys": column(keys), "more": column(more), "least": column(least)})


def _shared(table):
    """For each group the anchors that two documents hold, in the order they came."""
    keys, lengths = _unbits(table["keys"], np.uint64)
    least, most = _bounds(table)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    at = np.flatnonzero(new)
    shared = np.minimum.reduceat(least[order], at) < np.maximum.reduceat(most[order], at) if len(at) else np.zeros(0, bool)
    flag = np.empty(len(k), bool)
    flag[order] = shared[np.cumsum(new) - 1]
    ends = np.cumsum(lengths)
    out = [keys[e - n : e][flag[e - n : e]] for e, n in zip(ends, lengths, strict=True)]
    none = [np.zeros(0, np.uint32)] * len(out)
    return _told(table["g"].combine_chunks(), _ANCHOR, out, none, none)


def _smaller(table, kind):
    """For each group the keys that a smaller id holds elsewhere, with that id."""
    keys, lengths = _unbits(table["keys"], np.uint64)
    more, _ = _unbits(table["more"], np.uint32)
    least, most = _bounds(table)
    _, _, low, _, place = _folded(keys, more, least)
    low = low[place]
    flag = low < most
    ends = np.cumsum(lengths)
    pick = [np.flatnonzero(flag[e - n : e]) + e - n for e, n in zip(ends, lengths, strict=True)]
    return _told(table["g"].combine_chunks(), kind, [keys[p] for p in pick], [more[p] for p in pick], [low[p] for p in pick])


def _of_kind(table, kind):
    return table.filter(pa.compute.equal(table["kind"], kind))


def _bucket_names(key, table):
    """What each group learns of its names."""
    return pa.concat_tables([_shared(_of_kind(table, _ANCHOR)), _smaller(_of_kind(table, _LONG), _LONG)])


def _bucket_windows(key, table):
    return _smaller(table, _WINDOW)


class _Smaller:
    """Keys with the least id that holds them, to be looked up."""

    def __init__(self, table, kind):
        table = _of_kind(table, kind)
        keys, more = _unbits(table["keys"], np.uint64)[0], _unbits(table["more"], np.uint32)[0]
        order = np.lexsort((more, keys))
        self.keys, self.more, self.least = keys[order], more[order], _unbits(table["least"], np.int64)[0][order]

    def holds(self, one, two, ids):
        """Which of the keys a smaller id than the given holds."""
        out = np.zeros(len(one), bool)
        if not len(self.keys):
            return out
        at = np.searchsorted(self.keys, one)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == one)
        at = at[hit]
        while True:  # keys that differ in their last 32 bits only
            step = np.flatnonzero((at < len(self.keys) - 1) & (self.more[at] < two[hit]))
            step = step[self.keys[at[step] + 1] == one[hit[step]]] if len(step) else step
            if not len(step):
                break
            at[step] += 1
        out[hit] = (self.more[at] == two[hit]) & (self.least[at] < ids[hit])
        return out


def _verified(s, long, ids):
    """Words [a, b) of the long symbols of a slice that a smaller id holds."""
    if not len(long.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, one, two = s.long()
    on = long.holds(one, two, ids[s.docs(a)])
    return a[on], b[on]


def _group_windows(window, turns, buckets):
    def run(key, left, right):
        """The windows on shared anchors that no long symbol of a smaller id holds."""
        shared = np.sort(_unbits(_of_kind(right, _ANCHOR)["keys"], np.uint64)[0])
        if not len(shared) or not left.num_rows:
            return _rows(0, _WINDOW, *[np.zeros(0, t) for t in (np.uint64, np.uint32, np.int64, np.int64)], buckets)
        long, table = _Smaller(right, _LONG), _ordered(left)
        ids, one, two, docs = _ids(table), [], [], []
        with np.errstate(over="ignore"):
            for s in _slices(table, window, turns):
                starts, key_of = s.anchor()
                a, b = _verified(s, long, ids)
                inside = _covered(a, b - window + 1, len(s.h))
                keep = starts[_among(key_of, shared) & ~inside[starts]]
                x, y = s.windows(keep)
                one.append(x)
                two.append(y)
                docs.append(ids[s.docs(keep)])
            k, m, least, most, _ = _folded(np.concatenate(one), np.concatenate(two), np.concatenate(docs))
        return _rows(key[0].as_py(), _WINDOW, k, m, least, most, buckets)

    return run


def _among(x, of):
    """Which of x are among the sorted ``of``."""
    at = np.minimum(np.searchsorted(of, x), len(of) - 1)
    return of[at] == x


def _covered(begin, end, n):
    """Which of n places lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    return np.cumsum(edge[:-1]) > 0


def _group_cut(window, turns, with_text, carry):
    def run(key, left, right):
        windows, long = _Smaller(right, _WINDOW), _Smaller(right, _LONG)
        table = _ordered(left)
        ids = _ids(table)
        n_words, n_removed, digest, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], []
        with np.errstate(over="ignore"):
            for s in _slices(table, window, turns if len(long.keys) else 0):
                w = s.words
                gone = np.zeros(len(w.start), bool)
                if len(windows.keys) or len(long.keys):
                    starts = tk.window_starts(w.first, window)
                    hit = starts[windows.holds(*s.windows(starts), ids[s.docs(starts)])]
                    a, b = _verified(s, long, ids)
                    gone = _covered(np.append(hit, a), np.append(hit + window, b), len(w.start))
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), w.first[:-1]) if len(w.first) > 1 else np.zeros(0, np.int64)
                removed[np.diff(w.first) == 0] = 0
                n_words.append(np.diff(w.first))
                n_removed.append(removed)
                for d in range(len(w.first) - 1):
                    lo, hi = int(w.offsets[d]), int(w.offsets[d + 1])
                    body = w.raw[lo:hi].tobytes()
                    if removed[d]:
                        f, e = int(w.first[d]), int(w.first[d + 1])
                        keep = np.flatnonzero(~gone[f:e]) + f
                        stay = [body[a - lo : b - lo] for a, b in zip(w.start[keep].tolist(), w.end[keep].tolist(), strict=True)]
                        if with_text:
                            mask = np.ones(hi - lo, bool)
                            edge = np.append(w.start[f:e], hi) - lo
                            for i in np.flatnonzero(gone[f:e]):
                                mask[edge[i] : edge[i + 1]] = False
                            texts.append(w.raw[lo:hi][mask].tobytes())
                    else:
                        stay = body.split()
                        if with_text:
                            texts.append(body)
                    digest.append(hashlib.sha256(b" ".join(stay)).hexdigest())
        out = {
            "doc_id": table["doc_id"],
            "n_words": pa.array(np.concatenate(n_words), pa.int64()),
            "n_removed": pa.array(np.concatenate(n_removed), pa.int64()),
            "kept_sha256": pa.array(digest, pa.string()),
        }
        if with_text:
            out["kept_text"] = pa.array(texts, pa.binary()).cast(pa.string())
        return pa.table(out | ({"rest": table["rest"]} if carry else {}))

    return run


def spread(size: int) -> tuple[int, int]:
    """(groups, buckets) for an input of so many stored bytes, up to some hundred TB."""
    each = max(GROUP_BYTES, size // PARTS)
    return max(1, -(-size // min(each, MOST_GROUP))), max(4, -(-size // min(each, MOST_BUCKET)))


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, turns: int = ROUNDS, with_text: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256.

    ``with_text`` adds kept_text (cut words leave with the space after them),
    ``carry`` the other columns of docs as a struct ``rest``.
    """
    groups, buckets = spread(stored_size(docs.select("doc_id", "text")))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest = [F.struct(*others).alias("rest")] if carry and others else []
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest
    )
    held = dealt.groupBy("g").applyInArrow(_group_names(window, turns, buckets), _KEYS)
    told = held.groupBy("bucket").applyInArrow(_bucket_names, _TOLD)
    found = dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(_group_windows(window, turns, buckets), _KEYS)
    least = found.groupBy("bucket").applyInArrow(_bucket_windows, _TOLD)
    smaller = told.where(F.col("kind") == _LONG).unionByName(least)
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] * with_text + [f for f in dealt.schema if f.name == "rest"]
    return dealt.groupBy("g").cogroup(smaller.groupBy("g")).applyInArrow(_group_cut(window, turns, with_text, bool(rest)), T.StructType(fields))


def cut_repeats(docs: DataFrame, *, window: int = WINDOW, turns: int = ROUNDS) -> DataFrame:
    """docs with its columns, repeated words cut from text, and n_chars (if there) that of the new text."""
    cut = substring_dedup(docs, window=window, turns=turns, with_text=True, carry=True)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    return cut.select(*[(new[f.name] if f.name in new else F.col(f"rest.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema])
