import random

import numpy as np
import pytest
from brute import best_edits, folded

from palaver.llm import decontamination as op


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéx") for _ in range(rnd.randrange(1, 8))) for _ in range(n))


def edited(rnd, text, n):
    t = list(text)
    for _ in range(n):
        i = rnd.randrange(len(t)) if t else 0
        t[i : i + 1] = rnd.choice([[], ["z"], [*t[i : i + 1], "y"]])
    return "".join(t)


def test_qgrams_by_doubling():
    x = np.random.default_rng(0).integers(0, 3, 300).astype(np.uint32)
    for q in (1, 2, 3, 7, 12, 16, 21):
        with np.errstate(over="ignore"):
            h = op.qgrams(x, q)
        grams = [tuple(x[i : i + q]) for i in range(len(x) - q + 1)]
        assert len(h) == len(grams) and len({(a, b) for a, b in zip(h, grams)}) == len(set(grams)) == len(set(h))


@pytest.mark.parametrize("q, rate", [(4, 0.15), (6, 0.1), (12, 0.06)])
def test_pairs_as_brute_force(q, rate):
    rnd = random.Random(q)
    items = [(i, sentence(rnd, rnd.choice([2, 8, 20]))) for i in range(12)] + [(99, None), (98, "ab")]
    texts = []
    for _ in range(80):
        parts = [sentence(rnd, rnd.choice([0, 3, 20]))]
        for _ in range(rnd.choice([0, 1, 2])):
            t = rnd.choice(items)[1] or ""
            t = edited(rnd, t, rnd.choice([0, 1, 2, 5, 9])) if t else t
            parts += [rnd.choice([t, t.upper(), t.replace(" ", " \n ")]), sentence(rnd, rnd.choice([0, 2, 9]))]
        texts.append(" ".join(parts))
    found = op.search(op.index(items, q, rate), texts, q)
    ix = op.index(items, q, rate)
    got = {}
    for d, w, a, z, e in found:
        assert best_edits(folded(items[[i for i, _ in items].index(ix.ids[w])][1]), folded(texts[d][a:z])) <= e
        got[d, ix.ids[w]] = min(e, got.get((d, ix.ids[w]), 99))
    want = {}
    for d, t in enumerate(texts):
        for i, x in items:
            x = folded(x).strip()
            if len(x) >= q:
                e = best_edits(x, folded(t))
                if e <= op.budget(len(x), q, rate):
                    want[d, i] = e
    assert got == want


def test_each_occurrence_is_a_row():
    item = "the quick brown fox jumps over the lazy dog and runs away"
    text = f"{item} {item.upper()}!! {item}\n\n{item}"
    assert len(op.search(op.index([(1, item)]), [text, "x " * 5000 + item])) == 5


def test_in_spark(spark):
    rnd = random.Random(3)
    item = sentence(rnd, 30)
    docs = [(1, "a " + item + " b"), (1, item), (None, item.upper()), (2, None), (3, ""), (4, sentence(rnd, 60)), (5, "pad " * 30000 + item)]
    d = spark.createDataFrame([(*r, 0, 0) for r in docs], "doc_id long, text string, item_id int, edits int")
    b = spark.createDataFrame([(7, item), (7, item), (8, None), (None, item), (9, "short")], "item_id long, text string")
    for part_chars in (100, 1 << 20):
        got = op.decontaminate(d, b, part_chars=part_chars).collect()
        assert sorted((str(r.doc_id), str(r.item_id)) for r in got) == sorted((a, c) for a in ("1", "1", "None", "5") for c in ("7", "7", "None"))
        by = {r.doc_id: r for r in got}
        assert (by[5].begin, by[5].end, by[5].edits) == (120000, 120000 + len(item), 0)
    assert op.decontaminate(d, b.limit(0)).collect() == [] and op.decontaminate(d.limit(0), b).collect() == []


@pytest.mark.parametrize("q, rate", [(4, 0.2), (6, 0.1), (12, 0.06)])
def test_periodic_texts_as_brute_force(q, rate, monkeypatch):
    """q-grams that an item holds many times, in items and texts of one or two repeated letters, in small pieces."""
    monkeypatch.setattr(op, "PIECE", 64)
    monkeypatch.setattr(op, "HITS", 50)
    monkeypatch.setattr(op, "STARTS", 32)
    rnd = random.Random(q)
    piece = lambda: rnd.choice(["a", "ab", "-", "aab", "xyz"]) * rnd.randrange(1, 40)
    plain = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.choice([30, 90])))
    items = [(i, "".join(piece() for _ in range(rnd.choice([1, 1, 2, 3])))) for i in range(14)] + [(20 + i, plain() + piece() * (i % 2)) for i in range(6)]
    texts = ["".join(edited(rnd, rnd.choice([piece(), rnd.choice(items)[1]]), rnd.choice([0, 0, 1, 3])) for _ in range(rnd.choice([1, 2, 5]))) for _ in range(40)]
    ix = op.index(items, q, rate)
    assert len(ix.loose.hash) and len(ix.grams.hash)
    got, ends = {}, {}
    for d, w, a, z, e in op.search(ix, texts, q):
        assert best_edits(dict(items)[ix.ids[w]], texts[d][a:z]) <= e and a >= ends.get((d, w), 0)
        ends[d, w] = z
        got[d, ix.ids[w]] = min(e, got.get((d, ix.ids[w]), 99))
    want = {}
    for d, t in enumerate(texts):
        for i, x in items:
            e = best_edits(x, t)
            if len(x) >= q and e <= op.budget(len(x), q, rate):
                want[d, i] = e
    assert set(got) == set(want) and len(want) > 40


def test_periodic_long_text_in_bounded_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert len(op.search(op.index([(1, "ab" * 50)]), ["ab" * 1_000_000])) == 20_000
    assert len(op.search(op.index([(1, "-" * 80), (2, "a plain start " + "-" * 80)]), ["-" * 2_000_000])) == 25_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000


def test_filter_keeps_columns(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, f"so {item} so", "x", None), (2, "clean", None, 5), (None, None, "y", 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, begin int")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = op.keep_clean(d, b)
    assert kept.columns == d.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows[1:]))
