"""Operator 9 - quality rules: an isolation forest on rule statistics.

One pass over the whole texts counts the rule statistics and scores them; no
shuffle.  The forest and its threshold are fitted beforehand on the driver from
a bounded sample of labelled rows (``SAMPLE_ROWS`` of least hash of the id),
which is the only bounded thing here: every document is counted and judged.

Trees grow on good rows inside the box of all sampled rows: a node draws a
feature and a split uniformly in its box, and ends when it holds one good row or
none, or at ``DEPTH``.  Rows in regions without good rows are isolated after a
few splits; the mean path length is the score.  The threshold is calibrated on
good rows that grew no tree and on bad ones: it is the length at which the share
of good rows rejected and the share of bad rows kept are least together.  A path
of that length or less is anomalous.  Trees on good rows alone are a variant of
the forest: grown on all rows, bad ones that are many and alike would be normal.

Cases: null text counts as empty (0 words, base rules fail); without labelled
rows of both kinds only the base rules judge; labels with nulls or other values
are not used; several labels of one id all count; rows that repeat a doc_id are
each judged by their own text; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .cluster import filter_rows

SAMPLE_ROWS = 20_000
TREES, DRAWN, DEPTH = 128, 512, 10
LEAST_WORDS, REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
SLICE = 1_000_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_letters", "n_marks", "n_marked_words", "n_stutters"]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL = _table("#*$%&|<>")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_MARK = _table("!?;:@^_=+~/\\[]{}()\"'-")
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False  # continuation bytes


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


def statistics(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text."""
    size, n = int(offsets[-1]), len(offsets) - 1
    body = raw[:size]
    with np.errstate(over="ignore"):
        w = tk.split_words(raw, offsets)
        h = tk.hash_words(w)
        starts = tk.window_starts(w.first, REPEAT_WINDOW)
        doc = np.searchsorted(w.first, starts, side="right") - 1
        grams = tk.window_hashes(h, REPEAT_WINDOW)
        grams = tk.mix(grams[starts] ^ tk.mix(doc.astype(np.uint64) + np.uint64(1))) if len(starts) else np.zeros(0, np.uint64)
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1] if len(grams) else np.zeros(0, bool)
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(edge, starts[twice], 1)
    np.add.at(edge, starts[twice] + REPEAT_WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    symbol = _SYMBOL[body]
    marked = np.zeros(len(w.start), bool)
    if len(w.start):
        last = body[w.end - 1]
        marked = _SYMBOL[last] | _MARK[last]
    stutter = np.zeros(len(w.start), bool)
    stutter[1:] = h[1:] == h[:-1]
    stutter[w.first[:-1][np.diff(w.first) > 0]] = False
    dup = np.zeros(n, np.int64)
    data = body.tobytes()
    for d in range(n):
        own = [x for x in data[offsets[d] : offsets[d + 1]].split(b"\n") if x.strip()]
        if len(own) > 1:
            dup[d] = len(own) - len(set(own))
    return {
        "n_words": np.diff(w.first),
        "word_chars": _per_text(_HEAD[body] & ~tk.SPACE[body], offsets),
        "n_symbols": _per_text(symbol, offsets),
        "n_dup_lines": dup,
        "n_repeat_words": _per_text(covered, w.first),
        "n_upper": _per_text(_UPPER[body], offsets),
        "n_letters": _per_text(_UPPER[body] | _LOWER[body], offsets),
        "n_marks": _per_text(_MARK[body], offsets),
        "n_marked_words": _per_text(marked, w.first),
        "n_stutters": _per_text(stutter, w.first),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios, which do not follow a text's length; repeated lines and windows are left to the base rules."""
    per = lambda a, b: s[a] / np.maximum(s[b], 1)
    return np.stack(
        [
            per("n_symbols", "word_chars"),
            per("n_upper", "n_letters"),
            per("n_marks", "word_chars"),
            per("n_marked_words", "n_words"),
            per("word_chars", "n_words"),
            per("n_stutters", "n_words"),
        ],
        axis=1,
    )


@dataclass
class Forest:
    """Trees as arrays: feature (-1: a leaf), split, children, and a leaf's path length."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    path: np.ndarray
    threshold: float = -1.0

    def paths(self, x: np.ndarray) -> np.ndarray:
        """The mean path length of each row."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int32)
            for _ in range(DEPTH):
                f = self.feature[t, at]
                go = x[rows, np.maximum(f, 0)] >= self.split[t, at]
                at = np.where(f >= 0, self.child[t, at] + go, at)
            total += self.path[t, at]
        return total / len(self.feature)

    def rejects(self, x: np.ndarray) -> np.ndarray:
        return self.paths(x) <= self.threshold


def _rest(n: np.ndarray | float) -> float:
    """The mean path length below a leaf that still holds n rows."""
    return 0.0 if n <= 1 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def grow(good: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7) -> Forest:
    rnd = np.random.Generator(np.random.PCG64(seed))
    most = 2 ** (DEPTH + 1)
    feature, child = np.full((TREES, most), -1, np.int8), np.zeros((TREES, most), np.int32)
    split, path = np.zeros((TREES, most)), np.zeros((TREES, most))
    usable = np.flatnonzero(high > low)
    for t in range(TREES):
        drawn = good[rnd.choice(len(good), min(DRAWN, len(good)), replace=False)]
        todo, used = [(0, drawn, low.copy(), high.copy(), 0)], 1
        while todo:
            at, rows, lo, hi, depth = todo.pop()
            if len(rows) <= 1 or depth == DEPTH or not len(usable):
                path[t, at] = depth + _rest(len(rows))
                continue
            f = int(usable[rnd.integers(len(usable))])
            s = rnd.uniform(lo[f], hi[f])
            feature[t, at], split[t, at], child[t, at] = f, s, used
            right = rows[:, f] >= s
            for k, (part, a, b) in enumerate(((rows[~right], lo[f], s), (rows[right], s, hi[f]))):
                lo2, hi2 = lo.copy(), hi.copy()
                lo2[f], hi2[f] = a, b
                todo.append((used + k, part, lo2, hi2, depth + 1))
            used += 2
    return Forest(feature, split, child, path)


def calibrated(good: np.ndarray, bad: np.ndarray) -> float:
    """The path length that separates held-out good rows from bad ones at the least share of good rejected and share of bad kept, together."""
    good, bad = np.sort(good), np.sort(bad)
    tried = np.unique(np.append(good, bad))
    cost = np.searchsorted(good, tried, side="right") / len(good) + 1 - np.searchsorted(bad, tried, side="right") / len(bad)
    at = int(cost.argmin())
    if cost[at] >= 1:
        return -1.0  # none separates them: nothing is rejected
    return float((tried[at] + tried[at + 1]) / 2) if at + 1 < len(tried) else float(tried[at])


def fit(x: np.ndarray, quality: np.ndarray) -> Forest | None:
    """None without rows of both kinds.  Every second good row grows the trees, the others set the threshold."""
    good, bad = x[quality == 1], x[quality == 0]
    if len(good) < 2 or not len(bad):
        return None
    forest = grow(good[::2], x.min(axis=0), x.max(axis=0))
    forest.threshold = calibrated(forest.paths(good[1::2]), forest.paths(bad))
    return forest


def _columns(batch):
    raw, offsets = tk.string_buffers(batch.column(1))
    for i, j in tk.slices(offsets, SLICE):
        yield i, j, statistics(*tk.part(raw, offsets, i, j))


def _counted(batches):
    """Id, features and label of labelled rows."""
    for batch in batches:
        for i, j, s in _columns(batch):
            x = features(s)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())), pa.array(base_failed(s)), batch.column(2).slice(i, j - i)],
                names=["doc_id", "x", "failed", "quality"],
            )


def fit_labelled(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """A forest from at most ``sample_rows`` labels, those of least hash of the id.

    A label that is there twice counts once, and so does an id that has several
    documents: of these it takes the row of least features.
    """
    rows = (
        labels.where("doc_id is not null and quality in (0, 1)")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "quality")
        .limit(sample_rows)
    )
    # at most sample_rows rows of 12 bytes
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    counted = joined.mapInArrow(_counted, "doc_id long, x array<double>, failed boolean, quality int")
    one = counted.groupBy("doc_id", "quality").agg(F.min(F.struct("x", "failed")).alias("row"))
    got = one.select("row.x", "row.failed", "quality").toArrow()
    if not got.num_rows:
        return None
    x, quality = np.array(got["x"].to_pylist()), got["quality"].to_numpy()
    order = np.lexsort((*x.T[::-1], quality))  # the same rows grow the same trees, however they came
    order = order[~got["failed"].to_numpy(zero_copy_only=False).astype(bool)[order]]
    return fit(x[order], quality[order])


def quality_rules(docs: DataFrame, labels: DataFrame | None = None, *, forest: Forest | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, kept and path_length (null without a forest)."""
    if forest is None and labels is not None:
        forest = fit_labelled(docs, labels, sample_rows)

    def judge(batches):
        for batch in batches:
            for i, j, s in _columns(batch):
                failed = base_failed(s)
                paths = forest.paths(features(s)) if forest else np.full(j - i, np.nan)
                kept = ~failed & ~((paths <= forest.threshold) if forest else np.zeros(j - i, bool))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(s[c], pa.int64()) for c in COUNTS), pa.array(failed), pa.array(kept), pa.array(paths, mask=np.isnan(paths))],
                    names=["doc_id", *COUNTS, "base_failed", "kept", "path_length"],
                )

    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, path_length double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, kinds)


def keep_good(docs: DataFrame, labels: DataFrame | None = None, *, forest: Forest | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns, in one pass."""
    if forest is None and labels is not None:
        forest = fit_labelled(docs, labels, sample_rows)

    def judge(column):
        raw, offsets = tk.string_buffers(column)
        for i, j in tk.slices(offsets, SLICE):
            s = statistics(*tk.part(raw, offsets, i, j))
            kept = ~base_failed(s)
            if forest:
                kept &= ~forest.rejects(features(s))
            yield i, j, kept

    return filter_rows(docs, "text", judge)
