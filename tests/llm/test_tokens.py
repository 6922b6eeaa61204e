import io
import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from palaver.llm import sstable, textkernel as tk, tokens


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PARTS = ["The", "of,", "naïve", "ét́", "ΟΔΟΣ", "İstanbul", "it's", "don't", "漢字かな", "12a3", "###", "<|endoftext|>", "x<|startoftext|>y", " ", " ", "\x85", "a b", "😀👍🏽", "ß", "́", "z" * 700, "\x00", "'s", "​"]


def texts():
    rnd = random.Random(8)
    out = ["".join(rnd.choice(PARTS) + rnd.choice([" ", "\n", "\t", "  ", "\x0b", ""]) for _ in range(rnd.choice([0, 1, 5, 60]))) for _ in range(150)]
    return out + [None, "", " ", "\n"]


def test_ids_as_whole_texts(plain, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 300)
    t, coder = texts(), tokens.Encoder(tokens.default_vocabulary())
    for _ in range(2):
        raw, offsets = tk.string_buffers(pa.array(t, pa.string()))
        for i, j in tk.slices(offsets, 700):
            ids, first = coder.encode(*tk.part(raw, offsets, i, j))
            assert [ids[first[k] : first[k + 1]].tolist() for k in range(j - i)] == [plain(x) for x in t[i:j]]


def test_shard_round_trip(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    rnd = random.Random(1)
    keys = sorted([rnd.randrange(-(1 << 63), 1 << 63) for _ in range(40)] + list(range(-5, 200, 3)) + [7, 7, 7, 7, 7, 7])
    rows = [(k, np.array([rnd.randrange(49408) for _ in range(rnd.choice([1, 2, 30]))], np.uint32)) for k in [*keys, None]]
    for width in (2, 4):
        sink = io.BytesIO()
        w = sstable.ShardWriter(sink, width)
        for k, v in rows:
            w.add(sstable.key_of(k), v)
        w.close()
        data = sink.getvalue()
        r = sstable.ShardReader(io.BytesIO(data), len(data))
        assert [(sstable.id_of(k), v.tolist()) for k, v in r] == [(k, v.tolist()) for k, v in rows]
        assert len(r.index) > 5
        for k in {k for k, _ in rows}:
            assert [x.tolist() for x in r.get(k)] == [v.tolist() for x, v in rows if x == k]
        misses = sum(r.may_hold(sstable.key_of(k)) for k in range(10**6, 10**6 + 2000))
        assert misses < 60 and r.get(10**7) == []
        with pytest.raises(ValueError):
            sstable.ShardReader(io.BytesIO(data[:-60] + b"x" * 10 + data[-50:]), len(data))
        with pytest.raises(ValueError):
            list(sstable.ShardReader(io.BytesIO(b"?" + data[1:]), len(data)))


def test_shards_in_spark(spark, plain):
    t = texts()
    rnd = random.Random(2)
    rows = [(i * 3 - 50, x) for i, x in enumerate(t)] + [(10, "twice"), (None, "no id"), (1, "long " * 50000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, x, 5, "k") for d, x in rows], "doc_id long, text string, start int, number string")
    shards = sstable.write_shards(df, shard_bytes=2000)
    assert len(shards.table) > 3
    got = sorted(map(tuple, sstable.scan_shards(spark, shards).collect()), key=lambda r: r[1])
    low = lambda d: (d is None, d or 0)
    assert [low(r[0]) for r in got] == sorted(low(d) for d, _ in rows)
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    want = []
    for d, x in rows:
        ids = np.array([*plain(x), 2], "<u4")
        want.append((low(d), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((low(r[0]), *r[2:]) for r in got) == sorted(want)
    assert sum(n for _, n, _ in shards.table) == len(rows) and sstable.Shards.open(spark, shards.folder) == shards
    empty = sstable.write_shards(df.limit(0))
    assert sstable.scan_shards(spark, empty).collect() == []


def test_one_id_in_several_shards(spark):
    """Rows of one id, even equal ones, do not gather in a task."""
    df = spark.createDataFrame([(7, "the same words again and again " * 20)] * 400 + [(None, "no id " * 50)] * 400 + [(9, "w")], "doc_id long, text string").repartition(4)
    shards = sstable.write_shards(df, shard_bytes=3000)
    assert max(n for _, n, _ in shards.table) < 400 and sum(n for _, n, _ in shards.table) == 801
    got = sorted(sstable.scan_shards(spark, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [7] * 400 + [9] + [None] * 400


def test_tokenizers_that_join_words():
    """Definitions that cut at white space are known, and texts are encoded whole by others."""
    import json

    spec = json.load(open(tokens.default_vocabulary(), encoding="utf-8"))
    assert tokens.cuts_at_space(spec)
    cut = lambda **change: tokens.cuts_at_space(spec | change)
    split = {"type": "Split", "pattern": {"Regex": r" ?\p{L}+|\s+(?!\S)|\s+"}, "behavior": "Isolated", "invert": False}
    assert cut(pre_tokenizer={"type": "WhitespaceSplit"}) and not cut(pre_tokenizer=None) and not cut(pre_tokenizer=split)
    assert not cut(pre_tokenizer={"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True})
    assert not cut(pre_tokenizer=split | {"behavior": "Removed", "invert": True}) and not cut(normalizer={"type": "Prepend", "prepend": "x"})
    assert not cut(added_tokens=[{"content": "two words", "single_word": False}])
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = os.path.join(os.path.dirname(tokens.default_vocabulary()), name)
        coder, whole = tokens.Encoder(path), Tokenizer.from_file(path)
        assert coder.by_word == (name == "word_bpe_49k.json")
        t = texts()
        ids, first = coder.encode(*tk.string_buffers(pa.array(t, pa.string())))
        assert [ids[first[k] : first[k + 1]].tolist() for k in range(len(t))] == [whole.encode(x or "", add_special_tokens=False).ids for x in t]


def alike():
    """Words that differ in their 8th or 16th byte, or in length, only."""
    last = "".join(map(chr, range(33, 127)))
    return [a + c for a in ("abcdefg", "version", "abcdefghabcdefg") for c in last] + ["a" * n for n in range(1, 40)] + ["\x00" * n for n in range(1, 20)]


@pytest.mark.parametrize("seed", [0, 1])
def test_words_that_are_alike_have_their_own_hashes(seed):
    raw, offsets = tk.string_buffers(pa.array([" ".join(alike())]))
    with np.errstate(over="ignore"):
        h = tk.hash_words(tk.split_words(raw, offsets), seed)
    assert len(h) == len(alike()) == len(np.unique(h))


def test_shards_of_words_that_are_alike(spark, plain):
    words = alike()
    texts = [*words, " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = sorted(map(tuple, sstable.scan_shards(spark, sstable.write_shards(df)).collect()))
    want, at = [], 0
    for d, x in enumerate(texts):
        ids = np.array([*plain(x), 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
