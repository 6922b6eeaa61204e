import random

import pytest
from brute import substring_dedup as model

from palaver.llm import recompression, substring_dedup as op

SCHEMA = "doc_id long, text string, g int, bucket string"


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA)
    return df


def check(spark, rows):
    got = op.substring_dedup(run(spark, rows), with_text=True).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(model(rows), key=key)
    by = {r.doc_id: r for r in got}
    for d, t in rows:
        if by[d].n_removed == 0 and sum(x == d for x, _ in rows) == 1:
            assert by[d].kept_text == (t or "")
    return by


def corpus(seed, n, vocabulary):
    rnd = random.Random(seed)
    text = lambda m: " ".join(rnd.choice(vocabulary) for _ in range(m))
    shared = [text(rnd.choice([13, 14, 20, 80])) for _ in range(4)]
    rows = []
    for d in range(n):
        parts = [text(rnd.choice([0, 3, 12, 40]))]
        for _ in range(rnd.choice([0, 1, 2])):
            parts += [rnd.choice(shared), text(rnd.choice([0, 1, 5, 30]))]
        rows.append((d * 7 + 3, rnd.choice(["\n", " ", "\t \r"]).join(parts)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("vocabulary", [["a", "b"], ["a", "bb", "é", "the", "of", "x" * 300], [f"w{i}" for i in range(500)]])
def test_as_brute_force(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(op, "GROUP_BYTES", 600)
    check(spark, corpus(len(vocabulary), 40, vocabulary))


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(op, "GROUP_BYTES", 200)
    long = " ".join(f"t{i}" for i in range(30))
    check(spark, [(5, long), (2, long + " more"), (None, long), (9, None), (10, ""), (11, "  \n "), (12, "a " * 40), (13, "a " * 13), (13, long), (14, "nul\x00   " + long)])


def test_spread_grows_with_the_input():
    for size in (0, 1, 10**6, 10**8, 10**10, 10**12, 10**14):
        groups, buckets = op.spread(size)
        assert groups * op.MOST_GROUP >= size and buckets * op.MOST_BUCKET >= size
        assert groups * buckets <= max(4, op.PARTS**2, size // 24)


def test_empty_table(spark):
    assert op.substring_dedup(run(spark, [])).collect() == []


def test_long_text(spark, monkeypatch):
    monkeypatch.setattr(op, "SLICE", 1000)
    rnd = random.Random(1)
    big = " ".join(str(rnd.randrange(10**6)) for _ in range(20000))
    check(spark, [(1, big), (2, "x " + big[5000:9000] + " y"), (3, "lone")])


def passages(seed):
    """Copies of whole texts, copies of copies, and long passages inside others."""
    rnd = random.Random(seed)
    text = lambda n: [f"w{rnd.randrange(4000)}" for _ in range(n)]
    base = [text(rnd.choice([60, 300, 1500])) for _ in range(6)]
    rows = []
    for d in range(60):
        b = rnd.choice(base)
        i = rnd.randrange(len(b) // 2)
        part = b if rnd.random() < 0.4 else b[i : i + rnd.randrange(20, len(b))]
        rows.append((rnd.randrange(10**6), " ".join([*text(rnd.choice([0, 2, 30])), *part, *text(rnd.choice([0, 1, 30]))])))
    rows += [(10**7, "same " * 3000), (10**7 + 1, "same " * 2000), (10**7 + 2, " ".join(base[2] * 3))]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_long_passages_as_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(op, "GROUP_BYTES", 20000)
    monkeypatch.setattr(op, "SLICE", 5000)
    check(spark, passages(seed))


def test_what_symbols_do(spark, monkeypatch):
    """Long symbols settle most windows of copies; and where names are not shared nothing is found, whatever the words."""
    rnd = random.Random(2)
    rows = [(i, " ".join(f"w{rnd.randrange(9)}" for _ in range(40)) + " " + t) for i, t in enumerate([" ".join(f"t{k}" for k in range(3000))] * 4)]
    sent = []
    told = op._told
    monkeypatch.setattr(op, "_told", lambda g, kind, *rest: (sent.append(kind), told(g, kind, *rest))[1])
    import pyarrow as pa

    def group(rows, salt):
        table = pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
        if salt:
            monkeypatch.setattr(recompression, "mix", lambda x: op.tk.mix(op.tk.mix(x) + op.np.uint64(salt)))
        names = op._group_names(13, op.ROUNDS, 1)((pa.scalar(salt),), table)
        monkeypatch.setattr(recompression, "mix", op.tk.mix)
        return table, names

    parts = [group([r], 0) for r in rows]
    heard = op._bucket_names(None, pa.concat_tables([n for _, n in parts]))
    windows = [op._group_windows(13, op.ROUNDS, 1)((pa.scalar(0),), t, heard) for t, _ in parts]
    count = [sum(len(x) // 8 for x in w["keys"].to_pylist()) for w in windows]
    assert count[0] > 2900 and all(n < 0.5 * count[0] for n in count[1:])
    # the same words under names of their own: only anchors of single words, which no round names, are shared
    parts = [group([r], i + 1) for i, r in enumerate(rows)]
    heard = op._bucket_names(None, pa.concat_tables([n for _, n in parts]))
    assert not any(k == op._LONG for k in heard["kind"].to_pylist())
    assert sum(len(x) // 8 for x in heard["keys"].to_pylist()) < 0.1 * sum(len(x) // 8 for _, n in parts for x in n["keys"].to_pylist())


def test_null_ids_and_repeated_ids_are_spread(spark):
    rows = [(None, f"text {i} of none") for i in range(200)] + [(7, f"text {i} of one") for i in range(200)]
    df = run(spark, rows)
    g = df.select(op.F.pmod(op.F.xxhash64("doc_id", "text"), op.F.lit(8)).alias("g")).groupBy("g").count().collect()
    assert len(g) == 8 and max(r["count"] for r in g) < 100
    check(spark, [(None, " ".join(f"t{i}" for i in range(40)))] * 3 + [(7, " ".join(f"t{i}" for i in range(5, 40)))] * 3)


def test_filter_keeps_columns(spark):
    t = " ".join(f"t{i}" for i in range(40))
    df = spark.createDataFrame([(1, t, "x", 5, {"k": 1}), (2, "a " + t, None, 6, None), (None, None, "z", 7, None)], "doc_id long, text string, `a.b` string, g int, `rest` map<string,int>")
    cut = op.cut_repeats(df)
    assert cut.columns == df.columns and cut.schema.simpleString() == df.schema.simpleString()
    got = sorted(map(tuple, cut.collect()), key=str)
    assert got == sorted([(1, t, "x", 5, {"k": 1}), (2, "a ", None, 6, None), (None, "", "z", 7, None)], key=str)
