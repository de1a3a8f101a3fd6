"""Odd inputs of operators: link targets, letters, a plain mixture model, empty and clashing tables, the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import language, quality, url_filter
from tests.conftest import SF


def test_targets(spark):
    tag = lambda x: f'<link rel="canonical" href="{x}">'
    data = [
        (1, "http://example.com/en/a?b", tag("/de/x")), (2, "http://free.io/dir/a", tag("b?x=1&amp;y=2")), (3, "http://free.io/dir/b?x=1&y=2", tag("//Example.com/de/")),
        (4, "http://free.io/c", tag("mailto:x@y") + tag("#top") + tag("HTTP://EXAMPLE.COM/de/q")), (5, "http://free.io/d", '<meta http-equiv="refresh" content="0;url=/dir/a">'), (6, "http://free.io", tag("e")),
        (7, "http://free.io/e", tag("?z")), (8, "http://free.io/e?z", None),
    ]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert {k for k, v in got.items() if v == "block"} == {1, 2, 3, 4, 5}
    edges = {(r.a, r.b) for r in url_filter.link_edges(spark.createDataFrame(data[5:7], "page_id long, url string, html string")).where("a <> b").collect()}
    assert edges == {("http://free.io", "http://free.io/e"), ("http://free.io/e", "http://free.io/e?z")}


def test_letters(spark):
    langs, probs = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [(1, "½ ² Ⅷ"), (2, "½ a"), (3, "漢"), (3, "漢"), (4, "١٢"), (None, "the")]
    got = language.identified(spark.createDataFrame(rows, "doc_id long, text string"), langs, probs, ["doc_id"]).collect()
    assert [(r.doc_id, r.lang_pred == "und") for r in got] == [(1, True), (2, False), (3, False), (3, False), (4, True), (None, False)]


def plain_mixture(text, probs):
    """Expectation-maximisation a trigram at a time, then languages by penalised likelihood."""
    at = language.trigrams(text)
    p = probs[at].astype(float)

    def run(pi, steps):
        for _ in range(steps):
            joint = pi * p
            pi = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
        return pi, np.log((pi * p).sum(axis=1)).sum()

    k = p.shape[1]
    pi, _ = run(np.full(k, 1 / k), language.STEPS)
    order = np.argsort(-pi, kind="stable")
    chosen = np.eye(k)[order[0]]
    best = np.log((chosen * p).sum(axis=1)).sum()
    for m in range(2, k + 1):
        start = np.where(np.isin(np.arange(k), order[:m]), pi, 0)
        more, ll = run(start / start.sum(), 4)
        if (ll - best) / 3 <= language.PENALTY * np.log(max(len(at), 2)):
            break
        chosen, best = more, ll
    return chosen


def test_mixture_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    langs, probs = language.fit(docs)
    by = {lang: " ".join(r.text for r in docs.where(F.col("lang") == lang).orderBy("doc_id").limit(5).collect()) for lang in langs}
    texts = [by[a][:x] + " " + by[b][:y] for a in langs for b in langs for x, y in ((400, 30), (300, 300), (60, 900))] + ["a", "the house", by["de"][:5000]]
    want = [plain_mixture(t, probs) for t in texts]
    for a, b in zip(language.mixtures(texts, probs), want, strict=True):
        assert np.abs(a - b).max() < 2e-3
    assert any((x > 0).sum() > 1 for x in want)


def test_more_languages_than_one(spark):
    rows = [(k, f"l{k % 300}", " ".join(chr(0x4E00 + 7 * (k % 300) + j) * 3 for j in range(6))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    langs, probs = language.fit(docs)
    assert len(langs) == 300
    got = language.identified(docs, langs, probs, ["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95


def test_quality_odd_inputs(spark):
    docs = spark.createDataFrame([(k, "good words of a text " * 3 if k % 2 else "bad!! $$$ junk " * 4, "x") for k in range(40)] + [(3, "good words of a text " * 3, "x"), (None, "y", "z"), (50, None, None), (51, "", "")], "doc_id long, text string, predicted string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (7, 0), (60, None), (61, 1)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit(docs, labels), ["doc_id"]).collect()
    assert len(got) == 44 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert min(by[k] for k in range(1, 40, 2)) > max(by[k] for k in range(0, 40, 2))
    assert len({r.score for r in got if r.doc_id in (50, 51)}) == 1
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert {r.score for r in quality.scored(docs, quality.fit(docs, few), ["doc_id"]).collect()} == {1.0 if few.count() else 0.5}
    assert quality.scored(docs.limit(0), quality.fit(docs, labels), ["doc_id"]).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, k):
    """Empty tables, nulls in every column, extra columns with clashing names, very long and repeated texts."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, digest binary, head string"
    rows = [(1, "a text of words " * 20_000, "en", "s", 1), (1, "a text of words " * 20_000, "en", "s", 1), (None, None, None, None, None), (None, "", None, None, None), (2, "other words in a text", None, "s", None)]
    docs = spark.createDataFrame([(*r, "clash", 7, b"x", "y") for r in rows], schema)
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, docs.limit(0), SF).count() == 0
    out = stage(spark, docs, SF)
    if k < 4:
        assert out.columns == corpus_pipeline.COLUMNS and out.count() <= len(rows)
    else:
        assert {r.doc_id for r in out.collect()} == {1, 2, None}
