"""Exact, near and substring dedup against brute force, on made-up rows with nulls, ties, repeats and long texts."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import exact_dedup, jaccard, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, sha string, digest string, n int"


def rows(seed=0, n=160):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(30)]
    passage = " ".join(r.choices(words, k=30))
    out = []
    for k in range(n):
        w = r.choice(base).split(" ")
        kind = r.random()
        if kind < 0.3:
            w[r.randrange(len(w))] = r.choice(words)
        elif kind < 0.4:
            w = w[: len(w) // 2] + passage.split(" ") + w[len(w) // 2 :]
        elif kind < 0.5:
            w = [x.upper() for x in w]
        sep = r.choice([" ", "  ", "\n", " \t "])
        out.append((k, sep.join(w) if kind < 0.95 else r.choice(["", "   ", "é" * 40, "a " * 4000, "ab" * 9000])))
    out += [(n, None), (n + 1, ""), (n + 2, None), (None, base[0]), (None, base[0]), (3, out[3][1]), (5, base[1] + " x"), (n + 3, " ".join(base) * 20), (n + 4, " ".join(base) * 20 + " tail")]
    r.shuffle(out)
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, t, "x", "s", 1, "clash", "clash", "clash", 7) for i, t in data], SCHEMA)


def least(values):
    real = [v for v in values if v is not None]
    return min(real) if real else None


def test_exact(spark):
    data = rows()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in data:
        groups.setdefault(norm(t), []).append(i)
    want = sorted(repr((i, least(g := groups[norm(t)]), len(g), i == least(g), hashlib.sha256(norm(t).encode()).hexdigest())) for i, t in data)
    got = exact_dedup.exact_duplicates(frame(spark, data).repartition(5)).collect()
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got) == want


def test_exact_empty(spark):
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=300, unique=True))
@settings(max_examples=80, deadline=None)
def test_golomb_round_trip(values):
    x = np.array(sorted(values), np.uint64)
    assert (exact_dedup.golomb_decode(exact_dedup.golomb_encode(x), len(x)) == x).all()


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    n = min(k, len(w))
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if w else frozenset()


def near_brute(data, k, percent):
    sets = [(i, shingles(t, k)) for i, t in data]
    group = list(range(len(sets)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                group[find(a)] = find(b)
    ids = {}
    for a, (i, s) in enumerate(sets):
        ids.setdefault(find(a), []).append(i)
    return sorted(repr((i, len(s), least(ids[find(a)]) if s else i)) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("words, percent, rows_of_a_cell", [(4, 85, 1000), (5, 80, 3), (2, 50, 4), (1, 34, 5)])
def test_near(spark, monkeypatch, words, percent, rows_of_a_cell):
    monkeypatch.setattr(jaccard, "CELL_ROWS", rows_of_a_cell)
    data = rows(words)
    got = jaccard.near_duplicates(frame(spark, data).repartition(3), words=words, percent=percent).collect()
    assert sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in got) == near_brute(data, words, percent)


def test_near_empty(spark):
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def cut_brute(data, length):
    bodies = [(i, (t or "").encode()) for i, t in data]
    first = {}
    for i, b in bodies:
        for k in range(len(b) - length + 1) if i is not None else ():
            w = b[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in bodies:
        gone = bytearray(len(b))
        if i is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < i:
                    gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append(repr((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("length", [50, 20])
def test_substrings(spark, length):
    data = [(i, t) for i, t in rows(length) if not (i in (3, 5) and t and t.endswith(" x"))]
    got = suffix_dedup.deduplicated(frame(spark, data).repartition(3), length=length).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == cut_brute(data, length)


def test_substrings_empty(spark):
    assert suffix_dedup.deduplicated(frame(spark, [])).count() == 0


@given(st.lists(st.text("ab", min_size=6, max_size=30), min_size=1, max_size=12, unique=True))
@settings(max_examples=150, deadline=None)
def test_index_statistics(texts):
    """Streamed statistics are the true common prefix lengths of neighbouring rows, and marks are those of brute force."""
    texts = [t.encode() for t in texts]
    index = suffix_dedup.RunLengthIndex(texts)
    marks = [bytes(suffix_dedup.END + ((k >> (3 * j)) & 7) for j in range(index.mark))[::-1] for k in range(len(texts))]
    whole = b"".join(t + m for t, m in zip(texts, marks, strict=True))
    assert index.sa.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:] + b"\xff" * 9)
    stats = index.statistics()
    for a, b in zip(index.sa[:-1].tolist(), index.sa[1:].tolist(), strict=True):
        n = 0
        while n < index.longest and max(a, b) + n < len(whole) and whole[a + n] == whole[b + n]:
            n += 1
        assert stats[b] == n
    got = suffix_dedup.marked_windows(texts, np.arange(len(texts)), 6).tolist()
    want = [any(t[k : k + 6] in s for s in texts[:j]) for j, t in enumerate(texts) for k in range(len(t) - 5)]
    assert got == want
