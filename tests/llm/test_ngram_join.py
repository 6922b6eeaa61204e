import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from brute import ngram_join as model

from palaver.llm import cluster, ngram_join as op

KEY = lambda r: tuple((x is None, str(x or 0)) for x in r)


def check(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, comp int")
    got = [tuple(r) for r in op.ngram_jaccard_join(df, **more).collect()]
    assert sorted(got, key=KEY) == sorted(model(rows), key=KEY)
    return got


def near(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_banding():
    bands, rows = op.banding()
    assert bands * rows <= op.MOST and 1 - (1 - 0.8**rows) ** bands >= op.RECALL
    with pytest.raises(ValueError):
        op.banding(0.01, 0.999999, 8)


@pytest.mark.parametrize("block", [4, 1024])
def test_as_brute_force(spark, block):
    rnd = random.Random(block)
    rows = []
    for g in range(12):
        base = [f"{g}w{rnd.randrange(50)}" for _ in range(rnd.choice([5, 30, 200, 600]))]
        for _ in range(rnd.choice([1, 2, 12])):
            rows.append((len(rows) * 3, near(rnd, base, rnd.choice([0, 0, 1, 2, 9]))))
    rnd.shuffle(rows)
    check(spark, rows, block=block)


def test_edges(spark):
    t = " ".join(f"a{i}" for i in range(60))
    rows = [(1, t), (1, t + " z"), (1, "other words here are different"), (None, t), (None, None), (4, None), (5, ""), (6, "one"), (7, "one"), (8, "one two"), (9, " one\n"), (10, "x " * 500), (11, "x " * 700), (12, "long" * 30000)]
    check(spark, rows)


def test_empty(spark):
    check(spark, [])


def test_recall_of_linked_pairs():
    rnd = np.random.default_rng(1)
    bands, rows = op.banding()
    missed = 0
    for _ in range(300):
        a = rnd.integers(0, 1 << 62, 450, dtype=np.uint64)
        b = a.copy()
        b[:50] = rnd.integers(0, 1 << 62, 50, dtype=np.uint64)  # 400 / 500
        g, f = np.concatenate([a, b]), np.array([0, 450, 900])
        x = op.band_hashes(g, f, bands, rows)
        missed += not (x[0] == x[1]).any()
    assert missed <= 1


def test_hot_keys_as_brute_force(spark, monkeypatch):
    """One set with many copies, one large group of near copies, many documents without words and without ids; blocks by bytes."""
    monkeypatch.setattr(cluster, "HOT", 6)
    monkeypatch.setattr(op, "BLOCK_BYTES", 4000)
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = [(i, "one text that many hold, word for word") for i in range(60)]
    rows += [(100 + i, near(rnd, base, rnd.choice([0, 1, 2, 3]))) for i in range(60)]
    rows += [(200 + i, rnd.choice([None, "", " "])) for i in range(40)]
    rows += [(300 + i, near(rnd, base, 100)) for i in range(20)] + [(None, near(rnd, base, 1)) for _ in range(10)] + [(None, None)] * 5
    check(spark, rows)


def test_keep_one(spark):
    t = " ".join(f"a{i}" for i in range(60))
    rows = [(5, t, 1, "x"), (3, t + " z", 2, None), (3, t + " z", 2, None), (4, "other words here", 3, "y"), (None, t, 4, "n"), (6, None, 5, None), (7, "", 6, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, turn int, `a.b` string").withColumnRenamed("turn", "__turn").withColumn("keep", F.lit(1))
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    assert sorted([tuple(r)[:4] for r in kept.collect()], key=KEY) == sorted([rows[1], rows[3], rows[4], rows[5], rows[6]], key=KEY)
    assert op.keep_one(df.limit(0)).collect() == []
