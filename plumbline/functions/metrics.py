"""Exact match, token F1 and SARI as columns over arrays of words."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import normalized_answer, once


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def exact(prediction: Column, gold: Column) -> Column:
    return (normalized_answer(prediction) == normalized_answer(gold)).cast("int")


def _numbered(words_: Column) -> Column:
    """Each word with how often it has come before, so that a bag is a set."""
    number = lambda s: F.transform(s, lambda w, i: F.concat(w, F.lit("\u0001"), (i - F.array_position(s, w)).cast("string")))
    return once(F.array_sort(words_), number)


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two bags: for each distinct word the smaller count."""
    return F.size(F.array_intersect(_numbered(a), _numbered(b)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Of bags of normalised words; two empty ones agree."""

    def score(p: Column) -> Column:
        same, a, b = p["same"], p["a"], p["b"]
        f1 = F.when(same > 0, 2 * (same / a) * (same / b) / (same / a + same / b)).otherwise(F.lit(0.0))
        return F.when((a == 0) | (b == 0), (a == b).cast("double")).otherwise(f1)

    def sizes(p: Column) -> Column:
        return F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), overlap(p["a"], p["b"]).cast("double").alias("same"))

    both = F.struct(words(normalized_answer(prediction)).alias("a"), words(normalized_answer(gold)).alias("b"))
    return once(once(both, sizes), score)


def best_over(golds: Column, score) -> Column:
    """The best score over several gold answers."""
    return F.array_max(F.transform(golds, score))


#: Words whose n-grams are counted together.
PIECE = 1 << 20


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.ones(len(a)), where=b > 0)


def _f1(hit: np.ndarray, selected: np.ndarray, relevant: np.ndarray) -> np.ndarray:
    p, r = _ratio(hit, selected), _ratio(hit, relevant)
    return np.divide(2 * p * r, p + r, out=np.zeros(len(p)), where=(p > 0) & (r > 0))


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


def _items(lists: pa.Array) -> pa.Array:
    """All items; Arrow can't flatten an array of no lists that Spark gives."""
    return lists.flatten() if len(lists) else pa.array([], lists.type.value_type)


def _sari_of(source: pa.Array, prediction: pa.Array, targets: pa.Array, orders: range) -> list[np.ndarray]:
    """add, keep and delete of each row, means over the orders. N-grams are numbered, those of a row once, and a row of flags
    for the source, the prediction and each target says which of them it has."""
    n_rows, texts = len(source), _items(targets)
    many = _lengths(targets)
    lengths = np.concatenate([_lengths(source), _lengths(prediction), _lengths(texts)])
    rows = np.concatenate([np.arange(n_rows), np.arange(n_rows), np.repeat(np.arange(n_rows), many)])
    kinds = np.concatenate([np.zeros(n_rows, np.int64), np.ones(n_rows, np.int64), 2 + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])
    words_ = pa.concat_arrays([_items(x).cast(pa.string()) for x in (source, prediction, texts)]).dictionary_encode()
    codes = np.asarray(pc.fill_null(words_.indices, -1)).astype(np.int64) + 1
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    row, kind, n_words = np.repeat(rows, lengths), np.repeat(kinds, lengths), len(words_.dictionary) + 1
    grams, means = codes.copy(), [np.zeros(n_rows) for _ in range(3)]
    for n in range(1, orders.stop):
        at = np.flatnonzero(left >= n)
        if n > 1:
            grams[at] = pd.factorize(grams[at] * n_words + codes[at + n - 1])[0]
        if n not in orders:
            continue
        n_grams = int(grams[at].max()) + 1 if len(at) else 1
        number, found = pd.factorize(row[at] * n_grams + grams[at])
        of_row = found // n_grams
        has = np.zeros((2 + int(many.max(initial=0)), len(found)), bool)
        has[kind[at], number] = True
        s, p, ts = has[0], has[1], has[2:]
        every, kept, gone, added = ts.any(axis=0), p & s, s & ~p, p & ~s
        targets_n = np.bincount(rows[(kinds > 1) & (lengths >= n)], minlength=n_rows)

        def size(flags: np.ndarray, of_row: np.ndarray = of_row) -> np.ndarray:
            return np.bincount(of_row[flags], minlength=n_rows).astype(float)

        def share(flags: np.ndarray, ts: np.ndarray = ts, size=size, targets_n: np.ndarray = targets_n) -> np.ndarray:
            hits = sum((size(flags & t) for t in ts), np.zeros(n_rows))
            return np.divide(hits, targets_n, out=np.zeros(n_rows), where=targets_n > 0)

        means[0] += _f1(size(added & every), size(added), size(every & ~s))
        means[1] += _f1(share(kept), size(kept), share(s))
        means[2] += _ratio(size(gone) - share(gone), size(gone))
    return [m / len(orders) for m in means]


def _sari_columns(source: Column, prediction: Column, targets: Column, orders: range) -> Column:
    """A struct of add, keep and delete."""

    @F.arrow_udf("add double, keep double, delete double")
    def scores(source: pa.Array, prediction: pa.Array, targets: pa.Array) -> pa.Array:
        texts = _items(targets)
        ends = np.concatenate([[0], np.cumsum(_lengths(texts))])[np.cumsum(_lengths(targets))]
        held = np.cumsum(_lengths(source) + _lengths(prediction)) + ends
        cuts = [0, *(np.flatnonzero(np.diff(held // PIECE)) + 1).tolist(), len(source)]
        parts = [_sari_of(*(x.slice(a, b - a) for x in (source, prediction, targets)), orders) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["add", "keep", "delete"])

    kind = "array<string>"
    return scores(source.cast(kind), prediction.cast(kind), targets.cast(f"array<{kind}>"))


def _parts(scores: Column) -> dict[str, Column]:
    return {k: scores[k] for k in ("add", "keep", "delete")}


def sari_parts(source: Column, prediction: Column, target: Column, n: int) -> dict[str, Column]:
    """Add and keep F1 and delete precision on sets of n-grams; a ratio of nothing to nothing is 1."""
    return _parts(_sari_columns(source, prediction, F.array(target), range(n, n + 1)))


def sari(source: Column, prediction: Column, target: Column, most: int = 4) -> Column:
    return sari_of_targets(source, prediction, F.array(target), most)["sari"]


def sari_of_targets(source: Column, prediction: Column, targets: Column, most: int = 4) -> dict[str, Column]:
    """add, keep, delete and sari, means over n-grams up to `most`, with an array of targets. What is kept or left out counts by
    the share of targets (of those that have n-grams) that have it; what is added, if any target has it. A null text has no n-grams.
    All rows of a batch are scored together, in Python: as functions of arrays each n-gram list was made anew wherever it is named."""
    mean = _parts(_sari_columns(source, prediction, targets, range(1, most + 1)))
    return mean | {"sari": (mean["add"] + mean["keep"] + mean["delete"]) / 3}


def span_accuracy(rows, no_answer: bool = False):
    """Shares of rows(start, end, gold_start, gold_end) whose start, end, and both are right; gold_start -1 is unknown and, with
    no_answer, 0 is none: such rows don't count."""
    known = rows.where(F.col("gold_start") != -1)
    known = known.where(F.col("gold_start") != 0) if no_answer else known
    first, last = F.col("start") == F.col("gold_start"), F.col("end") == F.col("gold_end")
    return known.agg(*[F.avg(x.cast("double")).alias(n) for n, x in (("start_acc", first), ("end_acc", last), ("span_acc", first & last))], F.count("*").alias("n"))
