import random

import numpy as np
from brute import rule_counts

from palaver.llm import quality_rules as op

SCHEMA = "doc_id long, text string, kept string, x int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "a", 1) for d, t in rows], SCHEMA)


def plain(got):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]


def test_counts_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op, "SLICE", 500)
    rnd = random.Random(4)
    parts = ["a", "é", "the", "of", "#x", "a|b", "\n", "\n", "  ", "\t", "\r", "\x0b", "l" * 300, "漢字", " ", "\x85"]
    rows = [(i, " ".join(rnd.choice(parts[: rnd.choice([3, 9, 16])]) for _ in range(rnd.choice([0, 1, 7, 20, 90])))) for i in range(120)]
    rows += [(500, None), (None, "null id " * 30), (501, ""), (502, "same"), (502, "same\nsame\n \nsame"), (503, "w " * 40000)]
    got = op.quality_rules(frame(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    rows = [(d, t) if d != 503 else (d, "w " * 50) for d, t in rows]
    want = sorted(((d, *rule_counts(t)) for d, t in rows), key=key)
    have = sorted(((*r[:1], 50, 50, 0, 0, 50, r[6]) if r[0] == 503 else r for r in plain(got)), key=key)
    assert have == want
    assert all(r.kept == (not r.base_failed) and r.path_length is None for r in got)


def texts(rnd, n, junk):
    out = []
    for i in range(n):
        w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(40, 200))]
        out.append(" ".join(x + "###" if junk else x for x in w))
    return out


def test_held_out_accuracy_and_one_forest(spark):
    rnd = random.Random(5)
    rows = [(i, t, 1) for i, t in enumerate(texts(rnd, 400, False))] + [(1000 + i, t, 0) for i, t in enumerate(texts(rnd, 80, True))]
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows if d % 2] + [(None, 1, 0), (3, None, 0), (5, 9, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [(d, t) for d, t, _ in rows])
    got = {r.doc_id: r.kept for r in op.quality_rules(docs, labels).collect()}
    held = [(got[d], q) for d, _, q in rows if not d % 2]
    assert np.mean([k == (q == 1) for k, q in held]) > 0.98
    assert got == {r.doc_id: r.kept for r in op.quality_rules(docs.repartition(5), labels).collect()}


def test_a_repeated_bad_id_leaves_the_good_rows(spark):
    rnd = random.Random(6)
    good, bad = texts(rnd, 100, False), texts(rnd, 20, True)
    rows = [*enumerate(good), *((1000 + i, t) for i, t in enumerate(bad)), *((1000, bad[0]) for _ in range(400))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(1000 + i, 0, 0) for i in range(20)] * 2, "doc_id long, quality int, toxic int")
    once = op.fit_labelled(frame(spark, rows[:120]), labels, 120)
    many = op.fit_labelled(frame(spark, rows), labels, 120)
    assert once is not None and many is not None and many.threshold == once.threshold
    assert (many.feature == once.feature).all() and (many.split == once.split).all()


def test_paths_as_walked():
    rnd = np.random.default_rng(0)
    x = rnd.random((300, 4))
    forest = op.grow(x, x.min(0), x.max(0))
    some = rnd.random((20, 4)) * 1.4 - 0.2
    for row, path in zip(some, forest.paths(some)):
        total = 0
        for t in range(op.TREES):
            at = 0
            while forest.feature[t, at] >= 0:
                at = forest.child[t, at] + (row[forest.feature[t, at]] >= forest.split[t, at])
            total += forest.path[t, at]
        assert abs(path - total / op.TREES) < 1e-9


def test_no_usable_labels(spark):
    docs = frame(spark, [(1, "word " * 3), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in op.quality_rules(docs, none).collect()] == [False, False]
    assert op.quality_rules(frame(spark, []), none).collect() == []


def test_threshold_as_brute_force():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        good, bad = rnd.integers(3, 20, rnd.integers(1, 30)) / 2, rnd.integers(0, 14, rnd.integers(1, 10)) / 2
        cost = lambda t: (good <= t).mean() + (bad > t).mean()
        assert abs(cost(op.calibrated(good, bad)) - min(1, *(cost(t) for t in [*good, *bad]))) < 1e-12
    assert op.calibrated(np.array([5.0, 6]), np.array([7.0])) == -1


def test_filter_keeps_columns(spark):
    rows = [(1, "word " * 30, "x", 1), (2, "a b c d e f g h i j k l m n o p q r s t u v", None, None), (None, None, "y", 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, kept int")
    kept = op.keep_good(d)
    assert kept.columns == d.columns and [tuple(r) for r in kept.collect()] == [rows[1]]
