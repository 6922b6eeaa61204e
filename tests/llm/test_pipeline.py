import random

import pytest
from brute import folded, ngram_join, rule_counts, substring_dedup
from tokenizers import Tokenizer

import corpus_pipeline as cp
from palaver.llm import tokens


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghi") for _ in range(rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(30) for _ in range(4)]
    shared = [text(60) for _ in range(3)]
    rows = []
    for i in range(160):
        kind = i % 8
        t = text(rnd.randrange(80, 200))
        if kind == 1:
            t = " ".join(w + "###" for w in t.split())
        elif kind == 2:
            t = f"{t}\n{rnd.choice(shared)}\n{text(40)}"
        elif kind == 3:
            t = f"{text(30)} {rnd.choice(items).upper()} {text(40)}"
        elif kind == 4:
            t = rows[-4][1] if rnd.random() < 0.5 else " ".join([*rows[-4][1].split(), "tail"])
        elif kind == 5:
            t = rnd.choice([text(10), "", "same " * 60])
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([*rows, (900, None, None, None, None), (None, text(50), "en", None, 3)], schema).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 8 != 1), 0) for i in range(160) if i % 8 in (0, 1, 2, 6, 7)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, items


def test_stages_as_brute_force(spark, folder):
    path, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = lambda df: {(r.doc_id, r.text) for r in df.collect()}
    have = rows(docs)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path).cache()
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        got = rows(out)
        if name == "quality_rules":
            base = {(d, t) for d, t in have if not rule_counts(t)[-1]}
            junk = {(d, t) for d, t in base if "###" in t}
            assert got <= base and not got & junk and len(base - junk - got) <= 1
        elif name == "ngram_jaccard_join":
            order = sorted(have, key=str)
            assert got == {x for x, (d, c, *_) in zip(order, ngram_join(order)) if d == c}
        elif name == "substring_dedup":
            want = {(d, n, digest) for d, n, _, digest in substring_dedup(sorted(have, key=str))}
            from brute import hashlib, words

            old = {d: len(words(t)) for d, t in have}
            assert {(d, old[d], hashlib.sha256(b" ".join(words(t))).hexdigest()) for d, t in got} == want
            assert all(r.n_chars == len(r.text) for r in out.collect())
        else:
            assert got == {(d, t) for d, t in have if not any(folded(i) in folded(t) for i in items)} and got < have
        docs, have = out, got
    got = cp.run(spark, path).collect()
    t = Tokenizer.from_file(tokens.default_vocabulary())
    want = {(d, len(t.encode(x, add_special_tokens=False).ids) + 1) for d, x in have}
    assert {(r.doc_id, r.start + r.length) for r in got if r.piece == max(q.piece for q in got if q.doc_id == r.doc_id)} == want


def test_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_columns_of_any_name_pass_all_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumnsRenamed({"lang": "a.b", "source": "__turn"}).selectExpr("*", "1 AS keep", "array(doc_id) AS `rest`", "map('k', doc_id) AS node")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    assert docs.count() > 40 and all(r["rest"] == [r.doc_id] and r["node"] == {"k": r.doc_id} for r in docs.where("doc_id is not null").collect())
