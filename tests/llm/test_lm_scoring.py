import math
import random
from collections import Counter

import pytest
from brute import words

from palaver.llm import lm_scoring as op


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 0, True) for d, t in rows], "doc_id long, text string, n_tokens int, target boolean")


def brute(rows, targets, floor):
    """Scores by models that are made anew for each document, without it."""
    seen = Counter(w for _, t in rows for w in words(t))
    known = lambda t: [w if seen[w] >= floor else None for w in words(t)]
    v = 1 + sum(n >= floor for n in seen.values())

    def model(texts):
        uni, pair, ctx = Counter(), Counter(), Counter()
        for w in texts:
            uni.update(w)
            ctx.update(["start"] if w else [])
            ctx.update(w)
            pair.update(zip(["start", *w], w))
        n = sum(uni.values())
        mix = lambda a: op.MIX if ctx[a] else 0
        flat = lambda b: op.WORD * uni[b] / n + (1 - op.WORD) / v if n else 1 / v
        return lambda a, b: math.log2(mix(a) * pair[a, b] / max(ctx[a], 1) + (1 - mix(a)) * flat(b))

    out = []
    for i, (d, t) in enumerate(rows):
        others = [(e, known(x)) for j, (e, x) in enumerate(rows) if j != i]
        w = known(t)
        means = [-sum(m(a, b) for a, b in zip(["start", *w], w)) / len(w) if w else None for m in (model([x for e, x in others if e in targets]), model([x for _, x in others]))]
        out.append((d, len(w), w.count(None), *means, means[0] - means[1] if w else None))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    for g, x in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:3] == x[:3]
        assert all(a is b is None or abs(a - b) < 1e-9 for a, b in zip(g[3:], x[3:])), (g, x)


@pytest.mark.parametrize("floor", [1, 2, 4])
def test_as_brute_force(spark, floor):
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "x" * 300]
    rows = [(i, " ".join(rnd.choice(vocabulary[: rnd.choice([5, 30, 62])]) for _ in range(rnd.choice([0, 1, 9, 40])))) for i in range(60)]
    rows += [(100 + i, f"once{i} w1 once{i} twice") for i in range(5)]
    rows += [(3, "w1 w2 again"), (None, "w1"), (None, "w1 w3"), (500, None)]
    targets = {i for i in range(0, 60, 3)}
    got = op.lm_scoring(frame(spark, rows).repartition(3), spark.createDataFrame([(i,) for i in [*targets, 3, 3]] + [(None,)], "doc_id long"), floor=floor, chunks=5).collect()
    same(got, brute(rows, targets, floor))


def test_targets_are_scored_as_held_out_ones(spark):
    """A target's score does not tell that it is in the model; a document with a copy is told from one without."""
    rnd = random.Random(4)
    say = lambda: " ".join(rnd.choice(["the", "of", *(f"w{rnd.randrange(3000)}" for _ in range(3))]) for _ in range(80))
    rows = [(i, say()) for i in range(300)]
    rows += [(1000 + i, rows[200 + i][1]) for i in range(20)]
    got = {r.doc_id: r for r in op.lm_scoring(frame(spark, rows), spark.createDataFrame([(i,) for i in range(100)], "doc_id long")).collect()}
    mean = lambda ids: sum(got[i].ce_difference for i in ids) / len(ids)
    assert abs(mean(range(100)) - mean(range(100, 200))) < 0.1 * abs(mean(range(100, 200)))
    assert min(got[i].ce_difference for i in [*range(200, 220), *range(1000, 1020)]) > max(got[i].ce_difference for i in range(200))


def test_target_like_texts_score_lower(spark):
    rnd = random.Random(2)
    say = lambda v: " ".join(rnd.choice(v) for _ in range(60))
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(i, say(a if i % 2 else b)) for i in range(200)]
    got = op.lm_scoring(frame(spark, rows), spark.createDataFrame([(i,) for i in range(1, 60, 2)], "doc_id long")).collect()
    like = [r.ce_difference for r in got if r.doc_id >= 60 and r.doc_id % 2]
    other = [r.ce_difference for r in got if r.doc_id >= 60 and not r.doc_id % 2]
    assert max(like) < min(other) and len(like) == len(other) == 70


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert op.lm_scoring(frame(spark, []), none).collect() == []
    (r,) = op.lm_scoring(frame(spark, [(1, "a b a")]), none).collect()
    assert (r.n_tokens, r.n_unknown) == (3, 1) and abs(r.ce_target - 1) < 1e-9 and abs(r.ce_background - 1) < 1e-9


def test_more_words_and_pairs_than_a_fixed_table(spark):
    """300,000 different words, each text there twice: counts stay those of the word and the pair."""
    a = ["".join(f"{p}{i} {q}{i} " for i in range(k, k + 1000)) for p, q in ("xy", "vw") for k in range(0, 75_000, 1000)]
    rows = [*enumerate(a), *((len(a) + i, t) for i, t in enumerate(a))]
    got = {r.doc_id: r for r in op.lm_scoring(frame(spark, rows).repartition(4), spark.createDataFrame([(0,)], "doc_id long"), chunks=7).collect()}
    # without itself every document meets each of its words and pairs once, in its copy
    n, v, starts = 2000 * (2 * len(a) - 1), 2 * 2 * 75_000 + 1, 2 * len(a) - 1
    seen = lambda before: math.log2(op.MIX / before + (1 - op.MIX) * (op.WORD / n + (1 - op.WORD) / v))
    for d, _ in rows:
        assert abs(got[d].ce_background + (seen(starts) + 1999 * seen(1)) / 2000) < 1e-9
    # an unseen pair after an unseen word is flat in the target model, and no other word lends it a count
    flat = math.log2((1 - op.WORD) / v)
    for d in range(1, len(a)):
        first = math.log2((1 - op.MIX) * (1 - op.WORD) / v)
        assert abs(got[d].ce_target + (first + 1999 * flat) / 2000) < 1e-9
    assert abs(got[0].ce_target - math.log2(v)) < 1e-9 and got[len(a)].ce_target < 9
