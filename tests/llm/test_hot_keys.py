"""One short string in all documents: contexts of one key are cut by longer grams where they exceed an index."""

import random

import pytest
from tests.llm.test_dedup import cut_brute, frame

from plumbline.llm import suffix_dedup


@pytest.mark.parametrize("most", [500, 1 << 20])
def test_hot_key(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", most)
    r = random.Random(11)
    made = lambda n: "".join(r.choices("abcdefgh", k=n))
    common, passages = made(30), [made(60) for _ in range(4)]
    data = [(k, made(r.randint(0, 80)) + r.choice(passages)[: r.randint(20, 60)] + common + made(r.randint(5, 60))) for k in range(120)]
    data += [(200, "z" * 300), (201, "z" * 200 + common), (None, common * 3)]
    got = suffix_dedup.deduplicated(frame(spark, data).repartition(3), length=50).collect()
    assert sorted(repr((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256)) for x in got) == cut_brute(data, 50)
    assert any(0 < x.n_removed < x.n_bytes for x in got)
