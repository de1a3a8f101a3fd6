from pyspark.sql import functions as F

from plumbline.llm import line_dedup

SF = "/root/testdata/sf0.001"


def test_short_lines_go(spark, tmp_path):
    data = [(1, "All rights reserved.\n\na b c d e"), (2, "x\nall  RIGHTS reserved.\n \nx"), (None, "X\nA b c d e")]
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_units, r.starts, r.ends) for r in line_dedup.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (2, [], []), 2: (3, [2, 26], [23, 27]), None: (2, [0, 2], [1, 11])}


def test_every_line_counts(spark):
    first, want = set(), {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy(F.col("doc_id").asc_nulls_last()).collect():
        n, gone = 0, []
        for line in (r.text or "").split("\n"):
            key = b" ".join(line.encode().lower().split())
            if key:
                n += 1
                gone += [len(line)] if key in first else []
                first.add(key)
        want[r.doc_id] = (n, len(gone), sum(gone))
    got = {r.doc_id: (r.n_units, r.n_removed, r.removed_chars) for r in line_dedup.op4_line_dedup(spark, SF).collect()}
    assert got == want
