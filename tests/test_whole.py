"""Registered queries against brute force over whole texts and groups."""

import re
from collections import Counter

import pytest

from plumbline import registry

SF = "/root/testdata/sf0.001"


def turns(spark):
    return {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}


def normalised(text):
    bare = re.sub(r"[!-/:-@\[-`{-~]", "", text.lower())
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", bare) if w not in ("", "a", "an", "the")]


def f1(hit, selected, relevant):
    p, r = (len(hit) / len(x) if x else 1.0 for x in (selected, relevant))
    return 2 * p * r / (p + r) if p > 0 and r > 0 else 0.0


def parts(s, p, t, n):
    s, p, t = ({tuple(x[k : k + n]) for k in range(len(x) - n + 1)} for x in (s, p, t))
    return f1((p - s) & (t - s), p - s, t - s), f1(p & s & t, p & s, t & s), len((s - p) - t) / len(s - p) if s - p else 1.0


def test_token_f1_of_whole_texts(spark):
    text, want = turns(spark), {}
    assert any(len(t) > 400 for t in text.values())
    for c, k in text:
        if (c, k + 1) in text:
            a, b = normalised(text[c, k]), normalised(text[c, k + 1])
            same = sum((Counter(a) & Counter(b)).values())
            want[c, k] = (2 * same / (len(a) + len(b)) if a and b else float(len(a) == len(b)), int(a == b))
    got = {(r.conv_id, r.turn): (r.f1, r.em) for r in registry.queries()["q_token_f1"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_sari_of_whole_texts(spark):
    text, ones, four = turns(spark), {}, {}
    for c, k in text:
        if (c, k + 1) in text:
            x, y = text[c, k], text[c, k + 1]
            ones[c, k] = parts(*(v.lower().split(" ") for v in (x, y, f"{y} {x[:50]}")), 1)
            if (c, k + 2) in text:
                words = [v.lower().split(" ") for v in (x, y, text[c, k + 2])]
                four[c, k] = sum(sum(parts(*words, n)) for n in range(1, 5)) / 12
    got = {(r.conv_id, r.turn): (r["add"], r.keep, r.delete) for r in registry.queries()["q_sari_unigrams"](spark, SF).collect()}
    assert got.keys() == ones.keys() and all(got[k] == pytest.approx(ones[k], abs=1e-6) for k in ones)
    got = {(r.conv_id, r.turn): r.sari for r in registry.queries()["q_sari"](spark, SF).collect()}
    assert four and got.keys() == four.keys() and all(got[k] == pytest.approx(four[k], abs=1e-6) for k in four)


def test_number_pairs_of_all_orders(spark):
    orders, want = {}, {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity").collect():
        orders.setdefault(r.l_orderkey, []).append(float(r.l_quantity))
    assert any(len(v) > 4 for v in orders.values())
    for key, v in orders.items():
        v.sort()
        answer = sum(v[:2])
        if len(v) > 1 and not (answer % 1 == 0 and answer < 10):
            v = [*v, 100.0]
            pairs = {tuple(sorted((a, b))) for k, a in enumerate(v) for b in v[k + 1 :] if a + b == answer}
            if len(pairs) == 1:
                want[key] = pairs.pop()
    got = {r.qid: (r.low, r.high) for r in registry.queries()["q_number_pairs"](spark, SF).collect()}
    assert got == want
