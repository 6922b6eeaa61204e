"""Operator 10 - benchmark decontamination by q-gram counting and banded alignment.

Texts and items are compared in simple lower case with runs of white space as
one space.  An item of m characters may be held with k = min(RATE * m, (m - q) // q)
edits; such an occurrence shares at least m - q + 1 - k * q of the item's
q-grams, all on k + 1 neighbouring diagonals.  Hits are counted in bands of
2 * (k + 1) diagonals that overlap by half, so one band holds them all; bands
that reach the bound are merged and verified by an alignment inside the band.

A q-gram that an item holds at more than ``OFTEN`` offsets is not counted by
diagonal: it counts as found, and the item's bound falls by its offsets.  Where
nothing is left of the bound the item is periodic; then the text's places that
hold any of its q-grams are counted, each once, and stretches of the item's
length that reach the whole bound are verified.  Hits are taken ``HITS`` at a
time, in order of place, and bands that can get no more are settled at once, so
memory follows the text and not the number of hits.

Occurrences of an item in a text do not overlap and are taken from the left: of
the ends within 2 * k characters of the first, the one of fewest edits.  An end
whose best alignment begins before the last occurrence ends is passed over.

One pass over the documents, without a shuffle.  The items are broadcast in
parts of at most ``PART_CHARS`` characters, a pass for each part; a benchmark of
any size takes more passes, not more memory.

Cases: null texts and items match nothing; items of under q characters are too
short to tell and match nothing; equal items are each reported; an occurrence is
a row, so an item found twice in a text makes two; rows that repeat a doc_id
each report; empty tables give no rows; other columns, whatever their names, are
not read by the search and are kept by ``keep_clean``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import filter_rows

Q, RATE = 12, 0.06
PART_CHARS = 8 << 20
SLICE = 1 << 20
#: Characters whose q-grams are hashed at a time, hits that are held at a time, and starts that are aligned at a time.
PIECE, HITS, STARTS = 1 << 20, 1 << 20, 1 << 18
OFTEN = 4
_U = np.uint64
_EDIT = 1 << 40
_BASE = _U(0x9E3779B97F4A7C15)
_BITS = 22


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """Code point to lower case where that is one code point; all white space is a space."""
    t = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        s = chr(c)
        if s.isspace():
            t[c] = 32
        elif len(s.lower()) == 1:
            t[c] = ord(s.lower())
    return t


def _folded(code: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case without second spaces, and which characters stay; a text begins at each of ``begins``."""
    x = _lower()[code]
    space = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[begins] = True
    return x[keep], keep


class _Texts:
    """Folded texts one after the other: characters, bounds, and where a character came from."""

    def __init__(self, texts: list[str]):
        codes = [_codes(t) for t in texts]
        self.first = np.append(0, np.cumsum([len(c) for c in codes])).astype(np.int64)
        begins = self.first[:-1][np.diff(self.first) > 0]
        self.x, self.keep = _folded(np.concatenate(codes) if codes else np.zeros(0, np.uint32), begins)
        # kept characters before each block of the original, so that no place is stored
        ends = np.add.reduceat(self.keep, np.arange(0, len(self.keep), 4096), dtype=np.int64) if len(self.keep) else np.zeros(0, np.int64)
        self.before = np.append(0, np.cumsum(ends))
        self.bounds = np.array([self._kept_before(int(i)) for i in self.first], np.int64)

    def _kept_before(self, i: int) -> int:
        b = i // 4096
        return int(self.before[min(b, len(self.before) - 1)]) + int(np.count_nonzero(self.keep[b * 4096 : i]))

    def origin(self, i: int) -> int:
        """The original place of folded character i, over all texts."""
        b = int(np.searchsorted(self.before, i, side="right")) - 1
        return b * 4096 + int(np.flatnonzero(self.keep[b * 4096 : (b + 1) * 4096])[i - int(self.before[b])])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def qgrams(x: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, by doubling."""
    if len(x) < q:
        return np.zeros(0, np.uint64)
    n = len(x) - q + 1
    power, h, done, size = _BASE, tk.mix(x.astype(np.uint64)), None, 0
    width = 1
    while True:
        if q & width:  # done = this piece, then what is done already
            if done is None:
                done, size = h, width
            else:
                done = h[: len(done) - width] * _U(pow(int(_BASE), size, 1 << 64)) + done[width:]
                size += width
        if width * 2 > q:
            return tk.mix(done[:n])
        h = h[:-width] * power + h[width:]
        power = power * power
        width *= 2


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    return max(0, min(int(rate * m), (m - q) // q))


@dataclass
class Grams:
    """q-grams sorted by hash, of which item and at which offset."""

    hash: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    seen: np.ndarray  # bits of the hashes' tops

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Grams:
        cat = lambda i, t: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t)
        g = cat(0, np.uint64)
        order = np.argsort(g, kind="stable")
        seen = np.zeros(1 << _BITS if len(g) else 0, bool)
        seen[(g >> _U(64 - _BITS)).astype(np.int64)] = True
        return Grams(g[order], cat(1, np.int64)[order], cat(2, np.int64)[order], seen)

    def hits(self, h: np.ndarray, valid: np.ndarray):
        """(places, entries) of the q-grams of h that are here, in order of place, about HITS at a time; with the place after."""
        if not len(self.hash):
            return
        p = np.flatnonzero(self.seen[(h >> _U(64 - _BITS)).astype(np.int64)] & valid)
        lo, hi = np.searchsorted(self.hash, h[p], side="left"), np.searchsorted(self.hash, h[p], side="right")
        p, lo, count = p[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        total = np.cumsum(count)
        i = 0
        while i < len(p):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + HITS, side="right")))
            yield np.repeat(p[i:j], count[i:j]), tk.expand(lo[i:j], count[i:j]), int(p[j]) if j < len(p) else len(h)
            i = j


@dataclass
class Items:
    """A part of the benchmark: texts, the q-grams that are counted by diagonal, and those of periodic items."""

    ids: list
    text: list[np.ndarray]
    grams: Grams
    loose: Grams
    k: np.ndarray
    need: np.ndarray  # of hits by diagonal
    whole: np.ndarray  # of all hits
    size: np.ndarray


def index(rows: list[tuple[int, str]], q: int = Q, rate: float = RATE) -> Items:
    ids, text, counted, loose, k, need, whole = [], [], [], [], [], [], []
    with np.errstate(over="ignore"):
        for i, t in rows:
            code = _codes(t or "")
            x = _folded(code, np.zeros(min(len(code), 1), np.int64))[0]
            lo, hi = (1, len(x)) if len(x) and x[0] == 32 else (0, len(x))
            x = x[lo : hi - 1] if hi > lo and x[hi - 1] == 32 else x[lo:hi]
            if len(x) < q:
                continue
            g = qgrams(x, q)
            different, at, count = np.unique(g, return_inverse=True, return_counts=True)
            rare = count[at] <= OFTEN
            most = budget(len(x), q, rate)
            bound = len(g) - most * q
            k.append(most)
            whole.append(bound)
            need.append(bound - int((~rare).sum()))
            own = np.full(len(g), len(ids))
            if need[-1] > 0:
                counted.append((g[rare], own[rare], np.flatnonzero(rare)))
            else:
                loose.append((different, own[: len(different)], np.zeros(len(different), np.int64)))
            ids.append(i)
            text.append(x)
    number = lambda v: np.array(v, np.int64)
    return Items(ids, text, Grams.of(counted), Grams.of(loose), number(k), number(need), number(whole), number([len(x) for x in text]))


def align(item: np.ndarray, x: np.ndarray, least: int, most: int, k: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ends, edits, begins) of the occurrences of item in x[low:high] that begin in [least, most] and stay inside k diagonals of there.

    For each end the fewest edits, k at most, and of the alignments with so many the latest begin.
    """
    lo = least - k
    width = most + k - lo + 1  # diagonals; those before the text serve items whose first characters are left out
    step = np.arange(width, dtype=np.int64)
    begin = lo + step
    # edits above, begins below: the least number has fewest edits, then the latest begin
    big = (2 * (k + 1) + len(item)) * _EDIT
    row = np.where((begin >= max(least, low)) & (begin <= min(most, high)), -step, big)
    ladder = step * _EDIT
    for i, c in enumerate(item):
        a, b = max(0, low - lo - i), min(width, high - lo - i)  # the diagonals on which x has a character that meets item[i]
        over = np.full(width, big)
        if b > a:
            over[a:b] = row[a:b] + np.where(x[lo + i + a : lo + i + b] == c, 0, _EDIT)
        over[:-1] = np.minimum(over[:-1], row[1:] + _EDIT)  # item[i] left out
        row = np.minimum.accumulate(over - ladder) + ladder  # characters put in
        row[: max(0, min(width, low - lo - i - 1))] = big
        row[max(0, high - lo - i) :] = big
    edits = -(-row // _EDIT)
    good = np.flatnonzero(edits <= k)
    return lo + good + len(item), edits[good], lo + edits[good] * _EDIT - row[good]


def _occurrences(m: np.ndarray, x: np.ndarray, least: int, most: int, k: int, low: int, high: int):
    """(edits, begin, end) of the occurrences that begin in [least, most], from the left, as the module says."""
    if most - least < len(m) - k:  # there is room for one, and mostly it is a plain copy
        from_ = max(least, low)
        whole, part = x[from_ : min(high, most + len(m))].tobytes(), m.tobytes()
        found = whole.find(part)
        while found >= 0 and found % 4:
            found = whole.find(part, found + 1)
        if found >= 0:
            yield 0, from_ + found // 4, from_ + found // 4 + len(m)
            return
    parts = [align(m, x, s, min(s + STARTS - 1, most), k, low, high) for s in range(least, most + 1, STARTS)]
    end, edits, begin = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((-begin, edits, end))
    end, edits, begin = end[order], edits[order], begin[order]
    first = np.append(True, end[1:] != end[:-1]) if len(end) else np.zeros(0, bool)
    end, edits, begin = end[first], edits[first], begin[first]
    i, last = 0, low
    while i < len(end):
        j = int(np.searchsorted(end, end[i] + 2 * k, side="right"))
        at = i + int(edits[i:j].argmin())
        if begin[at] < last:
            i = at + 1
            continue
        last = int(end[at])
        yield int(edits[at]), int(begin[at]), last
        i = int(np.searchsorted(end, last + len(m) - k, side="left"))


def _valid(t: _Texts, lo: int, n: int, q: int) -> np.ndarray:
    """Which of the n places from lo have a q-gram that lies in one text."""
    ok = np.ones(n, bool)
    inner = t.bounds[1:-1]
    for b in inner[(inner > lo) & (inner < lo + n + q)].tolist():
        ok[max(0, b - q + 1 - lo) : max(0, b - lo)] = False
    return ok


class _Bands:
    """Counts by (text, item, band) while places ascend; what can grow no more is settled."""

    def __init__(self, items: Items):
        self.items, self.key, self.count, self.good = items, np.zeros((3, 0), np.int64), np.zeros(0, np.int64), []

    def add(self, doc: np.ndarray, which: np.ndarray, diagonal: np.ndarray, after: int) -> None:
        band = np.floor_divide(diagonal, self.items.k[which] + 1)
        key = np.stack([np.tile(doc, 2), np.tile(which, 2), np.append(band, band - 1)])
        key, count = np.concatenate([self.key, key], axis=1), np.append(self.count, np.ones(key.shape[1], np.int64))
        order = np.lexsort(key[::-1])
        key, count = key[:, order], count[order]
        at = np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))) if key.shape[1] else np.zeros(0, np.int64)
        key, count = key[:, at], np.add.reduceat(count, at) if len(at) else count
        done = (key[2] + 2) * (self.items.k[key[1]] + 1) + self.items.size[key[1]] <= after
        self.good.append(key[:, done & (count >= self.items.need[key[1]])])
        self.key, self.count = key[:, ~done], count[~done]

    def regions(self) -> np.ndarray:
        """Rows (text, item, least begin, most): merged bands, and k more on either side, as edits before the first hit move the begin."""
        self.good.append(self.key[:, self.count >= self.items.need[self.key[1]]])
        doc, which, band = np.concatenate(self.good, axis=1)
        k = self.items.k[which]
        return np.stack([doc, which, band * (k + 1) - k, (band + 2) * (k + 1) - 1 + k], axis=1)


class _Stretches:
    """Stretches of text with enough places that hold any q-gram of a periodic item."""

    def __init__(self, items: Items, q: int):
        self.items, self.q, self.held, self.found = items, q, {}, [np.zeros((0, 4), np.int64)]

    def add(self, doc: np.ndarray, which: np.ndarray, place: np.ndarray) -> None:
        order = np.lexsort((place, which))
        which, place, doc = which[order], place[order], doc[order]
        edge = np.flatnonzero(np.append(True, which[1:] != which[:-1])) if len(which) else which
        for i, j in zip(edge, np.append(edge[1:], len(which)), strict=True):
            w = int(which[i])
            before = self.held.get(w, np.zeros((2, 0), np.int64))
            p, d = np.append(before[0], place[i:j]), np.append(before[1], doc[i:j])
            n, m, k = int(self.items.whole[w]), int(self.items.size[w]), int(self.items.k[w])
            if len(p) >= n:
                a, b = p[: len(p) - n + 1], p[n - 1 :]
                ok = np.flatnonzero((b - a <= m + k - self.q) & (d[: len(a)] == d[n - 1 :]))
                self.found.append(_merged(np.stack([d[ok], np.full(len(ok), w), b[ok] - (m + k - self.q), a[ok]], axis=1)))
            keep = n - 1
            self.held[w] = np.stack([p[len(p) - keep :], d[len(d) - keep :]]) if keep and len(p) > keep else np.stack([p, d]) if keep else np.zeros((2, 0), np.int64)

    def regions(self) -> np.ndarray:
        return np.concatenate(self.found)


def _merged(rows: np.ndarray) -> np.ndarray:
    """Rows (text, item, least, most) with what overlaps or touches put together."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    group = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    # the furthest end so far in the group: groups are lifted above each other
    lift = np.cumsum(group) * (int(rows[:, 3].max()) - int(rows[:, 2].min()) + 2)
    far = np.maximum.accumulate(rows[:, 3] + lift)
    new = group.copy()
    new[1:] |= rows[1:, 2] + lift[1:] > far[:-1] + 1
    at = np.flatnonzero(new)
    out = rows[at].copy()
    out[:, 3] = np.maximum.reduceat(rows[:, 3], at)
    return out


def search(items: Items, texts: list[str], q: int = Q) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, begin, end, edits) of each occurrence; begin and end are characters of the text."""
    if not items.ids:
        return []
    t = _Texts(texts)
    bands, stretches = _Bands(items), _Stretches(items, q)
    with np.errstate(over="ignore"):
        for lo in range(0, len(t.x) - q + 1, PIECE):
            h = qgrams(t.x[lo : lo + PIECE + q - 1], q)
            valid = _valid(t, lo, len(h), q)
            for p, entry, after in items.grams.hits(h, valid):
                own = np.searchsorted(t.bounds, p + lo, side="right") - 1
                bands.add(own, items.grams.item[entry], p + lo - items.grams.offset[entry], after + lo)
            for p, entry, _ in items.loose.hits(h, valid):
                own = np.searchsorted(t.bounds, p + lo, side="right") - 1
                stretches.add(own, items.loose.item[entry], p + lo)
    out = []
    for d, w, least, most in _merged(np.concatenate([bands.regions(), stretches.regions()])).tolist():
        low, high = int(t.bounds[d]), int(t.bounds[d + 1])
        for edits, a, z in _occurrences(items.text[w], t.x, max(least, low), min(most, high), int(items.k[w]), low, high):
            out.append((d, w, t.origin(a) - int(t.first[d]), t.origin(z - 1) - int(t.first[d]) + 1, edits))
    return out


def _scan(items, q: int):
    def run(batches):
        own = items.value
        for batch in batches:
            raw, offsets = tk.string_buffers(batch.column(1))
            data = raw.tobytes()
            ids = batch.column(0).to_pylist()
            for i, j in tk.slices(offsets, SLICE):
                texts = [data[offsets[d] : offsets[d + 1]].decode("utf-8", "replace") for d in range(i, j)]
                found = search(own, texts, q)
                if found:
                    d, w, a, z, e = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([ids[i + x] for x in d], pa.int64()),
                            "item_id": pa.array([own.ids[x] for x in w], pa.int64()),
                            "begin": pa.array(a, pa.int64()),
                            "end": pa.array(z, pa.int64()),
                            "edits": pa.array(e, pa.int32()),
                        }
                    )

    return run


def _parts(benchmark: DataFrame, q: int, rate: float, part_chars: int):
    """Broadcast indexes of the benchmark, each of about ``part_chars`` characters."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-int(chars) // part_chars) or 1
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(index([tuple(r) for r in rows], q, rate))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, begin, end, edits of each occurrence of a benchmark item."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for shared in _parts(benchmark, q, rate, part_chars):
        found = plain.mapInArrow(_scan(shared, q), "doc_id long, item_id long, begin long, end long, edits int")
        out = found if out is None else out.union(found)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, q: int = Q, rate: float = RATE, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of docs without an occurrence, all columns, in one pass for each part."""

    def judge(shared):
        def run(column):
            raw, offsets = tk.string_buffers(column)
            data = raw.tobytes()
            for i, j in tk.slices(offsets, SLICE):
                texts = [data[offsets[d] : offsets[d + 1]].decode("utf-8", "replace") for d in range(i, j)]
                kept = np.ones(j - i, bool)
                kept[[d for d, *_ in search(shared.value, texts, q)]] = False
                yield i, j, kept

        return run

    for shared in _parts(benchmark, q, rate, part_chars):
        docs = filter_rows(docs, "text", judge(shared))
    return docs
