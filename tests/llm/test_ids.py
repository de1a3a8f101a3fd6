"""Every operator keeps 64-bit ids beside null ids, and rows that repeat."""

from collections import Counter

import pytest

from plumbline.llm import decontaminate, exact_dedup, jaccard, language, line_dedup, packing, quality, suffix_dedup, warc

BIG = [2**53 + 1, 2**53 + 3, 2**53 + 5, 2**62 + 1]
TEXTS = ["one text of some words", "another text, of other words", "Ein dritter Text", "one text of some words"]
ROWS = [*zip(BIG, TEXTS, strict=True), (None, "a text without an id"), (None, None), (BIG[0], TEXTS[0])]


def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z", 7) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, id string, row string, digest string, predicted int").coalesce(1)


def bench(spark):
    return spark.createDataFrame([(BIG[3], "other words"), (None, "x")], "item_id long, text string")


OPERATORS = {
    "quality": lambda s: quality.scored(docs(s), quality.fit(docs(s), s.createDataFrame([(BIG[0], 1), (None, 0)], "doc_id long, quality int")), ["doc_id"]),
    "packing": lambda s: packing.packed(docs(s)),
    "lines": lambda s: line_dedup.repeated_lines(docs(s), min_words=1),
    "benchmark": lambda s: decontaminate.judged(docs(s), bench(s)),
    "language": lambda s: language.identified(docs(s), *language.fit(docs(s)), ["doc_id"]),
    "exact": lambda s: exact_dedup.exact_duplicates(docs(s)),
    "near": lambda s: jaccard.near_duplicates(docs(s)),
    "substrings": lambda s: suffix_dedup.deduplicated(docs(s), length=20),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids(spark, name):
    got = OPERATORS[name](spark).select("doc_id").collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ROWS)


def test_ids_that_are_kept(spark):
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_duplicates(docs(spark)).collect() if r.doc_id}
    assert got == {i: BIG[0] if t == TEXTS[0] else i for i, t in ROWS if i}


def test_archive(spark, tmp_path):
    pages = docs(spark).selectExpr("doc_id AS page_id", "text AS url", "text AS html")
    folder = f"file://{tmp_path}/a"
    warc.write_archive(pages, folder)
    got = warc.read_archive(spark, folder, payloads=False).collect()
    assert Counter(r.page_id for r in got) == Counter(i for i, _ in ROWS)
    assert {r.refers_to for r in got} == {None, BIG[0]}
