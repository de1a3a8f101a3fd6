"""SARI of many rows, ragged and null targets, against sets."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumbline.functions import metrics

ORDERS = range(1, 5)


def f1(hit, selected, relevant):
    p, r = (hit / x if x else 1.0 for x in (selected, relevant))
    return 2 * p * r / (p + r) if p > 0 and r > 0 else 0.0


def plain(source, prediction, targets):
    out = []
    for n in ORDERS:
        s, p, *ts = ({tuple(x[k : k + n]) for k in range(len(x or []) - n + 1)} for x in (source, prediction, *targets))
        ts = [t for t in ts if t]
        share = lambda x, ts=ts: sum(len(x & t) for t in ts) / len(ts) if ts else 0.0
        every = set().union(*ts)
        gone = s - p
        out.append((f1(len((p - s) & every), len(p - s), len(every - s)), f1(share(p & s), len(p & s), share(s)), (len(gone) - share(gone)) / len(gone) if gone else 1.0))
    return [sum(x) / len(ORDERS) for x in zip(*out, strict=True)]


def test_many_rows(spark, monkeypatch):
    monkeypatch.setattr(metrics, "PIECE", 500)
    some = random.Random(5)
    text = lambda: None if some.random() < 0.05 else [some.choice("abcdef") * some.randint(1, 2) for _ in range(some.choice((0, 1, 2, 3, 9, 200)))]
    rows = [(k, text(), text(), [text() for _ in range(some.randint(0, 3))]) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, s array<string>, p array<string>, t array<array<string>>").repartition(4)
    began = time.perf_counter()
    got = {r.k: r for r in df.select("k", *[v.alias(c) for c, v in metrics.sari_of_targets(F.col("s"), F.col("p"), F.col("t")).items()]).collect()}
    assert time.perf_counter() - began < 30  # expressions over arrays took minutes
    assert len(got) == len(rows)
    for k, s, p, t in rows:
        want = plain(s, p, t)
        assert [got[k][c] for c in ("add", "keep", "delete", "sari")] == pytest.approx([*want, sum(want) / 3], abs=1e-9)
