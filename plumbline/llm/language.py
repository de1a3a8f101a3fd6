"""Language identification as inference of a mixture.

A language is a distribution over hashed character trigrams, counted over all rows that may be learnt from. A text is
taken as a mixture of languages: expectation-maximisation estimates their proportions from the trigrams' likelihoods.
The set of languages is then selected by penalised likelihood: along the order of the proportions, a language is added
as long as the log-likelihood gains more than the penalty of a parameter.

Training sums trigram counts by task and then by language and trigram; prediction is one scan without a shuffle. What is
sent to the tasks are BUCKETS numbers (128 KB) for each language that rows are labelled with, however many rows there are; only
the penalty ends the selection.

Defined cases: a null text and one without a letter (Unicode category L) are `und` with score 0; texts shorter than a trigram are padded with
spaces; rows with null lang or id teach nothing; without rows to learn from all are `und`; rows repeat as they are; other
columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import from_texts, learns, table

BUCKETS = 1 << 15
STEPS = 8
#: Log-likelihood that another language must gain, times the log of the number of trigrams; overlapping trigrams count a third.
PENALTY = 1.5
#: Likelihoods (distinct trigrams times languages) of a batch that are worked on at once.
TOGETHER = 1_600_000
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


def trigrams(text: str) -> np.ndarray:
    """A bucket for each trigram of the lower-cased text, padded by a space on each side."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(c) < 3:
        c = np.append(c, np.full(3 - len(c), 32, np.uint32))
    h = (c[:-2] * np.uint32(0x9E3779B1)) ^ (c[1:-1] * np.uint32(0x85EBCA77)) ^ (c[2:] * np.uint32(0xC2B2AE3D))
    return (h * np.uint32(0x27D4EB2F)) >> np.uint32(17)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sums: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            got = sums.get(lang)
            if got is None:
                got = sums[lang] = np.zeros(BUCKETS, np.int64)
            got += np.bincount(trigrams(text), minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})


def fit(docs: DataFrame, mod: int = 4, held: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages and their smoothed trigram probabilities (buckets x languages)."""
    rows = docs.where(learns("doc_id", mod, held)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counted = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by: dict[str, np.ndarray] = {}
    packed = counted.groupBy("lang").agg(F.collect_list("bucket").alias("at"), F.collect_list("n").alias("n"))  # BUCKETS entries at most
    for r in packed.collect():
        by[r["lang"]] = np.zeros(BUCKETS)
        by[r["lang"]][r["at"]] = r["n"]
    langs = sorted(by)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    n = np.stack([by[x] for x in langs], axis=1)
    share = (n.sum(axis=1) + 1) / (n.sum() + BUCKETS)
    return langs, ((n + 50 * share[:, None]) / (n.sum(axis=0) + 50)).astype(np.float32)


def _em(p: np.ndarray, c: np.ndarray, first: np.ndarray, owner: np.ndarray, start: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document. p: likelihood of each distinct trigram by language; c: its count; first: where documents begin."""
    total = np.add.reduceat(c, first)[:, None]
    pi = start
    for _ in range(steps):
        joint = pi[owner] * p
        joint *= (c / np.maximum(joint.sum(axis=1), 1e-30))[:, None]
        pi = np.add.reduceat(joint, first, axis=0) / total
    ll = np.add.reduceat(c * np.log(np.maximum((pi[owner] * p).sum(axis=1), 1e-30)), first)
    return pi, ll


def mixtures(texts: list[str], probs: np.ndarray) -> np.ndarray:
    """Proportions (texts x languages) after selection; unselected languages have 0."""
    out = np.zeros((len(texts), probs.shape[1]))
    at, counts, lengths, done = [], [], [], 0

    def work() -> None:
        nonlocal done
        sizes = np.array(lengths)
        first, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        p, c = probs[np.concatenate(at)], np.concatenate(counts).astype(np.float32)
        k = p.shape[1]
        pi, _ = _em(p, c, first, owner, np.full((len(sizes), k), 1 / k, np.float32), STEPS)
        order, n = np.argsort(-pi, axis=1, kind="stable"), np.add.reduceat(c, first)
        rows = np.arange(len(sizes))
        chosen = np.zeros_like(pi)
        chosen[rows, order[:, 0]] = 1
        best = np.add.reduceat(c * np.log((chosen[owner] * p).sum(axis=1)), first)
        open_ = np.ones(len(sizes), bool)
        for m in range(2, k + 1):
            which = np.flatnonzero(open_)
            if not len(which):
                break
            mine = open_[owner]
            allowed = np.zeros_like(pi[which])
            np.put_along_axis(allowed, order[which, :m], np.take_along_axis(pi[which], order[which, :m], axis=1), axis=1)
            allowed /= allowed.sum(axis=1, keepdims=True)
            some = sizes[which]
            pi2, ll = _em(p[mine], c[mine], np.cumsum(some) - some, np.repeat(np.arange(len(which)), some), allowed, 4)
            gain = (ll - best[which]) / 3 > PENALTY * np.log(np.maximum(n[which], 2))
            took = which[gain]
            chosen[took], best[took] = pi2[gain], ll[gain]
            open_[which[~gain]] = False
        out[done : done + len(sizes)] = chosen
        done += len(sizes)
        at.clear(), counts.clear(), lengths.clear()

    held = 0
    for text in texts:
        n = np.bincount(trigrams(text), minlength=BUCKETS)
        where = np.flatnonzero(n)
        at.append(where), counts.append(n[where]), lengths.append(len(where))
        held += len(where)
        if held * probs.shape[1] >= TOGETHER:
            work()
            held = 0
    if lengths:
        work()
    return out


def identified(docs: DataFrame, langs: list[str], probs: np.ndarray, columns: list[str]) -> DataFrame:
    """The given columns with lang_pred, score (the proportion of that language) and mixture (the selected languages' proportions)."""
    shipped = docs.sparkSession.sparkContext.broadcast((langs, probs))

    def make():
        names, p = shipped.value

        def work(texts: list[str | None]) -> dict:
            some = [k for k, t in enumerate(texts) if names and t and has_letter(t)]
            pi = mixtures([texts[k] for k in some], p) if some else np.zeros((0, 1))
            pred, score, mixed = ["und"] * len(texts), [0.0] * len(texts), [{} for _ in texts]
            for k, row in zip(some, pi, strict=True):
                best = int(row.argmax())
                pred[k], score[k] = names[best], min(1.0, float(row[best]))
                mixed[k] = {names[j]: round(float(row[j]), 6) for j in np.flatnonzero(row)}
            return {"lang_pred": pred, "score": score, "mixture": [list(x.items()) for x in mixed]}

        return work

    return from_texts(docs.select(*columns, F.col("text").cast("string").alias("__text")), make, {"lang_pred": "string", "score": "double", "mixture": "map<string,double>"})


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, probs = fit(docs)
    rows = docs.withColumn("held_out", ~learns("doc_id", 4, 2))
    return identified(rows, langs, probs, ["doc_id", "held_out"]).drop("mixture")
