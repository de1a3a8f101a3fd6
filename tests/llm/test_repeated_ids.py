"""Substring dedup where several texts share an id."""

from tests.llm.test_dedup import cut_brute, frame, rows

from plumbline.llm import suffix_dedup


def test_repeated_ids(spark):
    data = rows(7) + [(9, "the same passage of some length in several texts of one id " * 2), (9, "before the same passage of some length in several texts of one id after"), (8, "x the same passage of some length in several texts of one id y"), (8, "")]
    got = suffix_dedup.deduplicated(frame(spark, data).repartition(3), length=30).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == cut_brute(data, 30)
