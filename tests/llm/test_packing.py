import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from brute import best_fit_decreasing
from tokenizers import Tokenizer

from palaver.llm import packing as op, tokens


def test_knapsack_as_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(rnd.integers(1, 12, 4))
        price = rnd.random(len(lengths))

        def best(room):
            return max([p + best(room - n) for n, p in zip(lengths, price) if n <= room], default=0)

        value = op._values(price, lengths, 12)
        assert np.allclose(value, [best(c) for c in range(13)])
        found = [op._configuration(i, price, value, lengths, 12) for i in range(len(lengths))]
        assert all((c * lengths).sum() <= 12 and c[i] for i, c in enumerate(found))
        assert abs(max((c * price).sum() for c in found) - best(12)) < 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_configurations_use_up_the_histogram(seed):
    rnd = np.random.default_rng(seed)
    h = np.zeros(2049, np.int64)
    n = [3, 50, 1000, 30000][seed % 4]
    np.add.at(h, np.minimum(rnd.lognormal(6, 1.2, n).astype(int) + 1, 2048), 1)
    plan, bound = op.configurations(h)
    back = np.zeros(2049, np.int64)
    for k, counts in plan:
        assert k > 0 and sum(a * c for a, c in counts.items()) <= 2048
        for a, c in counts.items():
            back[a] += k * c
    assert (back == h).all()
    least = -(-int((h * np.arange(2049)).sum()) // 2048)
    used = sum(k for k, _ in plan)
    plain = best_fit_decreasing(np.repeat(np.arange(2049), h).tolist(), 2048)
    assert least <= bound <= used <= min(plain + 1, bound * 1.003 + 1), (least, bound, used, plain)
    assert op.configurations(np.zeros(2049, np.int64)) == ([], 0)


def test_program_beats_best_fit():
    """Best-fit puts 51 with 27 and leaves the rest without partners; the program mixes them."""
    h = np.zeros(101, np.int64)
    h[[51, 27, 26, 23]] = 600, 600, 600, 1200
    plan, bound = op.configurations(h, 100)
    used = sum(n for n, _ in plan)
    assert bound == 900 <= used <= 960 and best_fit_decreasing(np.repeat(np.arange(101), h).tolist(), 100) == 1100


@pytest.mark.parametrize("seed", range(30))
def test_bound_as_brute_force(seed):
    """The bound is below the best packing, which is found by trying all."""
    rnd = random.Random(seed)
    pieces = sorted((rnd.randrange(1, 13) for _ in range(rnd.randrange(1, 9))), reverse=True)

    def best(i, rooms):
        if i == len(pieces):
            return len(rooms)
        tries = [best(i + 1, rooms[:k] + [r - pieces[i]] + rooms[k + 1 :]) for k, r in enumerate(rooms) if r >= pieces[i]]
        return min([*tries, best(i + 1, [*rooms, 12 - pieces[i]])])

    h = np.bincount(pieces, minlength=13)
    plan, bound = op.configurations(h, 12)
    assert bound <= best(0, []) <= sum(n for n, _ in plan)


@pytest.mark.parametrize("seed", range(2))
def test_program_covers_all_demand(seed):
    """More lengths than 256 steps cover."""
    h = np.zeros(2049, np.int64)
    np.add.at(h, np.minimum(np.random.default_rng(seed).lognormal(6, 1.2, 1500).astype(int) + 1, 2048), 1)
    lengths = np.flatnonzero(h)
    plan, weight, _ = op.program(lengths, h[lengths].astype(float), 2048)
    assert len(plan) > 256
    assert (sum(n * counts for n, counts in zip(weight, plan, strict=True)) > h[lengths] * (1 - 1e-9)).all()


def check(rows, got, capacity):
    t = Tokenizer.from_file(tokens.default_vocabulary())
    want = []
    for d, x in rows:
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        for p in range(0, len(ids), capacity):
            part = ids[p : p + capacity]
            want.append((d, p // capacity, p, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), [r[3] for r in want]


def test_in_spark(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice(["the", "of", "unheard", "words"]) for _ in range(rnd.choice([0, 3, 40, 200])))) for i in range(300)]
    rows += [(5, "again"), (None, "x"), (None, None), (900, "long words " * 6000), (901, "the " * 63), (902, "the " * 64)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, part int, length int").repartition(3)
    packed, table = op.pack(df, capacity=64)
    used, lengths = check(rows, packed.collect(), 64)
    assert table.bound <= used == table.sequences <= best_fit_decreasing(lengths, 64)
    assert op.pack(df.limit(0))[0].collect() == []


def test_words_that_are_alike(spark):
    """Words that differ in their 8th or 16th byte only keep their own ids."""
    words = [a + c for a in ("abcdefg", "version", "abcdefghabcdefg") for c in map(chr, range(33, 127))]
    rows = list(enumerate([*words, " ".join(words)]))
    packed, table = op.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), capacity=64)
    used, _ = check(rows, packed.collect(), 64)
    assert table.bound <= used == table.sequences
