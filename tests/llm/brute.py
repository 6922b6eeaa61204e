"""Plain models that the operators are held against."""

import hashlib


def words(text):
    return (text or "").encode().split()


def substring_dedup(rows, window=13):
    """rows: (doc_id, text)."""
    least = {}
    big = 1 << 70
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, big), big - 1 if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < (big - 1 if d is None else d):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def grams(text, n=5):
    w = words(text)
    if 0 < len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def ngram_join(rows, threshold=0.8):
    """rows: (doc_id, text) -> {position: (class_id, copy_of, n_copies, n_links)}."""
    sets = [grams(t) for _, t in rows]
    nodes = sorted({s for s in sets if s}, key=hash)
    ids = {s: [d for (d, _), x in zip(rows, sets) if x == s] for s in nodes}
    least = lambda v: min([x for x in v if x is not None], default=None)
    near = {s: [u for u in nodes if u is not s and len(s & u) / len(s | u) >= threshold] for s in nodes}
    seen, of = set(), {}
    for s in nodes:
        if s in seen:
            continue
        todo, comp = [s], []
        seen.add(s)
        while todo:
            x = todo.pop()
            comp.append(x)
            for u in near[x]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        c = least([i for x in comp for i in ids[x]])
        for x in comp:
            of[x] = c
    return [(d, of[s], least(ids[s]), len(ids[s]), len(near[s])) if s else (d, d, d, 1, 0) for (d, _), s in zip(rows, sets)]


def rule_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = [False] * len(w)
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit[i : i + 8] = [True] * 8
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), dup, sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w)


def best_fit_decreasing(lengths, capacity):
    """Number of bins."""
    import bisect

    room = []
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(room, n)
        left = room.pop(k) - n if k < len(room) else capacity - n
        bisect.insort(room, left)
    return len(room)


def folded(text):
    out = []
    for c in text or "":
        c = " " if c.isspace() else c.lower() if len(c.lower()) == 1 else c
        if not (c == " " and out and out[-1] == " "):
            out.append(c)
    return "".join(out)


def best_edits(item, text):
    """The least edits of an occurrence of item in text."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)
