import random
import zlib
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from palaver.llm import resharding as op


def test_flow_is_cheapest():
    rnd = np.random.default_rng(3)
    for _ in range(40):
        m, n = rnd.integers(1, 4, 2)
        supply = rnd.integers(0, 4, m)
        capacity = rnd.integers(0, 4, n)
        capacity[-1] += max(0, supply.sum() - capacity.sum())
        cost = rnd.integers(0, 5, (m, n))
        flow = op.min_cost_flow(supply, capacity, cost)
        assert (flow.sum(1) == supply).all() and (flow.sum(0) <= capacity).all() and (flow >= 0).all()
        best = None
        units = [i for i in range(m) for _ in range(supply[i])]
        for way in product(range(n), repeat=len(units)):
            if (np.bincount(way, minlength=n) <= capacity).all():
                c = sum(cost[i, j] for i, j in zip(units, way))
                best = c if best is None else min(best, c)
        assert (flow * cost).sum() == (best or 0)


def check(rows, got, shards):
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == want
    assert len(got) == len(rows)
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)


def test_near_equal_and_cheap(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.choice([0, 5, 40, 300, 2000])) for i in range(3000)]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, slot int, shard string")
    written, plan = op.reshard(df)
    assert {"slot_in", "shard_in"} <= set(written.columns)
    got = op.digest(written).collect()
    check(rows, got, 40)
    by = [sum(r.size for r in got if r.shard == s) for s in range(40)]
    assert max(by) - min(by) <= 0.02 * sum(by) / 40
    # no plan can move less than what old shards hold beyond their new capacity
    old = np.bincount(plan.old, weights=plan.size, minlength=32)
    least = np.maximum(old - sum(by) / 40, 0).sum()
    assert plan.moved <= least * 1.02 + 5000


def test_unaffected_shards_stay(spark):
    rows = [(i, "y" * 84) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written, plan = op.reshard(df, new=4, old=(F.col("doc_id") % 4))
    assert plan.moved == 0 and not plan.affected
    check(rows, op.digest(written).collect(), 4)


def test_edges(spark):
    rows = [(1, None), (1, None), (1, "a"), (None, "b"), (None, "b"), (None, None), (7, "é" * 100000), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(rows, op.digest(op.reshard(df)[0]).collect(), 40)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.digest(op.reshard(empty)[0]).collect() == []


def test_names_that_clash(spark):
    """Columns of any name reach the files with their values."""
    rows = [(i, f"text {i}", i, f"s{i}", i * 2, i * 3, None if i % 2 else "d") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__size` int, shard string, Shard_in int, `block` int, `a.b` string")
    written, _ = op.reshard(df, new=3)
    assert written.columns == ["doc_id", "text", "__size", "shard_in_in", "Shard_in", "block", "a.b", "slot", "old_shard", "shard"]
    assert sorted(tuple(r)[:7] for r in written.collect()) == rows
    check([r[:2] for r in rows], op.digest(written).collect(), 3)


def test_keys_deal_as_spark_does(spark):
    x = np.array([0, 1, -1, 7, 2**31 - 1, -(2**31), 123456])
    got = spark.createDataFrame([(int(v),) for v in x], "v int").select(F.hash("v")).collect()
    assert [r[0] for r in got] == op._hash_int(x).tolist()
    for n in (1, 2, 40, 211):
        assert (op._hash_int(op.deal_keys(n)).astype(np.int64) % n == np.arange(n)).all()


def test_one_task_for_each_file(spark, monkeypatch):
    monkeypatch.setattr(op, "FILE_BYTES", 20_000)
    df = spark.createDataFrame([(i, "z" * 84) for i in range(4000)], "doc_id long, text string")
    written, plan = op.reshard(df, new=4)
    n = sum(int(plan.file[plan.shard == s].max()) + 1 for s in range(4))
    assert n > 10 and len(written.inputFiles()) == n
    check([(i, "z" * 84) for i in range(4000)], op.digest(written).collect(), 4)
