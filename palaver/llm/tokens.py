"""Token ids of whole texts.

Where a tokenizer's definition shows that it cuts at all white space and that
nothing before that reaches across (``cuts_at_space``), equal words get equal ids
wherever they stand, so each process encodes a different word once and keeps its
ids in a table of bounded size.  With any other tokenizer texts are encoded whole.
"""

from __future__ import annotations

import json
import os
from itertools import product

import numpy as np
import regex

from . import textkernel as tk

VOCABULARY = "word_bpe_49k.json"
#: Words that a process keeps; beyond, the table starts anew.
KEPT = 1 << 20
SLICE = 2_000_000
#: Words encoded in one call: their encodings are many times as large.
AT_ONCE = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: Steps that change characters of a word only, and ones that cut at white space or inside what is cut already.
_IN_WORDS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "StripAccents"}
_AT_SPACE, _INSIDE = {"Whitespace", "WhitespaceSplit", "BertPreTokenizer"}, {"ByteLevel", "Digits", "Punctuation", "Split", "UnicodeScripts"}


def _members(step: dict | None, name: str) -> list[dict]:
    return [] if step is None else step[name] if step["type"] == "Sequence" else [step]


def _finds_space(pattern: str) -> bool:
    """Whether the pattern may match white space, or looks around itself."""
    if "(?" in pattern or "\\b" in pattern or "^" in pattern.replace("[^", "") or "$" in pattern:
        return True
    found = regex.compile(pattern)
    return any(c in m.group() for a, c, b in product("aZ1'._é漢 ", " \t\n\x0b\x0c\r", "sZ1'._é漢 ") for m in found.finditer(a + c + b))


def cuts_at_space(spec: dict) -> bool:
    """Whether the definition of a tokenizer says that equal words get equal ids wherever they stand."""
    for step in _members(spec.get("normalizer"), "normalizers"):
        one_space = step["type"] == "Replace" and step["pattern"] in ({"Regex": "\\s+"}, {"Regex": " +"}) and step["content"] == " "
        if step["type"] not in _IN_WORDS and not one_space:
            return False
    steps = _members(spec.get("pre_tokenizer"), "pretokenizers")
    if not steps:
        return False
    first, *rest = steps
    words_only = first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and "Regex" in first["pattern"] and not _finds_space(first["pattern"]["Regex"])
    if first["type"] not in _AT_SPACE and not words_only:
        return False
    if any(s["type"] not in _INSIDE | _AT_SPACE or s.get("add_prefix_space") for s in rest):
        return False
    plain = all(not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])
    return plain and not spec.get("truncation") and not spec.get("padding")


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = cuts_at_space(json.load(f))
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found = [e.ids for i in range(0, len(words), AT_ONCE) for e in self.tokenizer.encode_batch_fast(words[i : i + AT_ONCE], add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        flat = np.array([i for x in found for i in x], np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        slot = np.arange(len(keys)) + len(self.at)
        self.at = np.append(self.at, self.used + np.cumsum(count) - count)
        self.count = np.append(self.count, count)
        self.used += len(flat)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.slot = np.insert(self.keys, place, keys), np.insert(self.slot, place, slot)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n + 1 bounds."""
        if not self.by_word:
            data = raw.tobytes()
            found = [self.tokenizer.encode(data[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([i for x in found for i in x], np.uint32), np.append(0, np.cumsum([len(x) for x in found])).astype(np.int64)
        with np.errstate(over="ignore"):
            w = tk.split_words(raw, offsets)
            h = tk.hash_words(w)
        if not len(h):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        keys, sample, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT:
            self._clear()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[place] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            data = raw.tobytes()
            s, e = w.start[sample[new]].tolist(), w.end[sample[new]].tolist()
            self._learn(keys[new], [data[a:b].decode("utf-8", "replace") for a, b in zip(s, e, strict=True)])
            place = np.searchsorted(self.keys, keys)
        slot = self.slot[place][inverse]
        count = self.count[slot]
        ids = self.ids[tk.expand(self.at[slot], count)]
        return ids, np.append(0, np.cumsum(count))[w.first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def closed(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    n = len(first) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    bounds = first + np.arange(n + 1)
    keep = np.ones(len(out), bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds
