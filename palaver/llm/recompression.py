"""Recompression: rounds that name runs and pairs of symbols.

A round first names every run of one symbol by (symbol, length), then every
pair whose left symbol falls in the left class and whose right symbol falls in
the right class.  Names and classes are fixed 64-bit functions of the symbols,
so they are the same in all documents, on all executors and in every attempt,
without a dictionary that grows with the corpus.

Beside its words [a, b) a symbol of the first rounds keeps its context [lo, hi):
the words that determined it.  Wherever those words occur again, the same symbol
stands, so any repeated passage that spans a symbol's context holds that symbol.
Later rounds go on without contexts: their symbols stand for long passages, and
two that have one name stand for the same words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textkernel import expand, mix

#: A later round's symbol is kept where its span in words first reaches one of these.
SPANS = np.array([32, 128, 512, 2048])

_U = np.uint64
_RUN, _PAIR, _SIDE = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)


@dataclass
class Level:
    """Symbols of one text after another: name, words [a, b), context [lo, hi), number of the text."""

    name: np.ndarray
    a: np.ndarray
    b: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray


def ground(h: np.ndarray, first: np.ndarray) -> Level:
    at = np.arange(len(h))
    return Level(h, at, at + 1, at, at + 1, np.repeat(np.arange(len(first) - 1), np.diff(first)))


def _spread(x: Level, lo_at: np.ndarray, hi_at: np.ndarray, begin: np.ndarray, end: np.ndarray, name: np.ndarray) -> Level:
    """Symbols that merge [begin, end); contexts reach lo_at and hi_at, beyond any window where that is another text."""
    n = len(x.name)
    out = -(1 << 40), 1 << 40
    lo = np.where((lo_at >= 0) & (x.doc[np.maximum(lo_at, 0)] == x.doc[begin]), x.lo[np.maximum(lo_at, 0)], out[0])
    top = np.minimum(hi_at, n - 1)
    hi = np.where((hi_at < n) & (x.doc[top] == x.doc[begin]), x.hi[top], out[1])
    return Level(name, x.a[begin], x.b[end - 1], lo, hi, x.doc[begin])


def name_runs(x: Level) -> Level:
    n = len(x.name)
    if n == 0:
        return x
    head = np.ones(n, bool)
    head[1:] = (x.name[1:] != x.name[:-1]) | (x.doc[1:] != x.doc[:-1])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], n)
    length = end - begin
    name = np.where(length > 1, mix(x.name[begin] * _RUN + length.astype(np.uint64)), x.name[begin])
    return _spread(x, begin - 1, end, begin, end, name)


def _pairs(name: np.ndarray, doc: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the round's symbols where each begins, which are pairs, their names, and which symbols are of the right class."""
    n = len(name)
    right = (mix(name + _U((int(_SIDE) * (turn + 1)) % (1 << 64))) & _U(1)).astype(bool)
    joined = np.zeros(n, bool)  # with the next
    joined[:-1] = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1])
    follows = np.zeros(n, bool)
    follows[1:] = joined[:-1]
    begin = np.flatnonzero(~follows)
    pair = joined[begin]
    new = name[begin]
    at = begin[pair]
    new[pair] = mix(name[at] * _PAIR + mix(name[at + 1] + _U(turn)))
    return begin, pair, new, right


def name_pairs(x: Level, turn: int) -> Level:
    n = len(x.name)
    if n == 0:
        return x
    begin, pair, name, right = _pairs(x.name, x.doc, turn)
    end = begin + 1 + pair
    lone_right = right[begin] & ~pair
    lo_at = np.where(lone_right, begin - 1, begin)
    hi_at = np.where(~right[begin] & ~pair, end, end - 1)
    return _spread(x, lo_at, hi_at, begin, end, name)


def rounds(h: np.ndarray, first: np.ndarray, n: int) -> list[Level]:
    levels = [ground(h, first)]
    for turn in range(n):
        levels.append(name_pairs(name_runs(levels[-1]), turn))
    return levels


def long_symbols(x: Level, turn: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, a, b) of the symbols of level x and of rounds ``turn`` to ``most`` whose span first reaches one of SPANS."""
    reach = lambda a, b: np.searchsorted(SPANS, b - a, side="right")
    name, a, b, doc = x.name, x.a, x.b, x.doc
    on = reach(a, b) > 0
    out = [(name[on], a[on], b[on])]

    def merge(begin: np.ndarray, end: np.ndarray, new: np.ndarray) -> None:
        nonlocal name, a, b, doc
        many = np.flatnonzero(end - begin > 1)
        i, j = begin[many], end[many] - 1
        span = reach(a[i], b[j])
        first = many[span > np.maximum(reach(a[i], b[i]), reach(a[j], b[j]))]
        out.append((new[first], a[begin[first]], b[end[first] - 1]))
        name, a, b, doc = new, a[begin], b[end - 1], doc[begin]

    for k in range(turn, most):
        if not (doc[1:] == doc[:-1]).any():
            break
        same = (name[1:] == name[:-1]) & (doc[1:] == doc[:-1])
        if same.any():
            begin = np.flatnonzero(np.append(True, ~same))
            end = np.append(begin[1:], len(name))
            length = end - begin
            merge(begin, end, np.where(length > 1, mix(name[begin] * _RUN + length.astype(np.uint64)), name[begin]))
        begin, pair, new, _ = _pairs(name, doc, k)
        merge(begin, begin + 1 + pair, new)
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def anchors(levels: list[Level], first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of words its anchor, fixed by the window's words alone.

    Of the symbols of the highest level whose context lies in the window, the
    one of least hash.  Returns, for each window start, (level, symbol number);
    also the window starts.
    """
    count = np.maximum(np.diff(first) - window + 1, 0)
    starts = expand(first[:-1], count)
    level = np.full(len(starts), -1, np.int8)
    which = np.zeros(len(starts), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        todo = np.flatnonzero(level < 0)
        if not len(todo):
            break
        x = levels[k]
        keep = np.flatnonzero((x.hi - x.lo <= window) & (x.lo >= 0))
        if not len(keep):
            continue
        lo, hi, order = x.lo[keep], x.hi[keep], mix(x.name[keep] ^ _SIDE)
        at = starts[todo]
        begin = np.searchsorted(lo, at, side="left")
        end = np.searchsorted(hi, at + window, side="right")
        best = begin.copy()
        found = end > begin
        least = np.where(found, order[np.minimum(begin, len(order) - 1)], _U(0))
        for step in range(1, int((end - begin).max(initial=0))):
            j = begin + step
            better = j < end
            value = order[np.minimum(j, len(order) - 1)]
            better &= value < least
            best = np.where(better, j, best)
            least = np.where(better, value, least)
        level[todo[found]] = k
        which[todo[found]] = keep[best[found]]
    return starts, level, which
