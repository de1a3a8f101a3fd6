"""Two writes of one table give the same files, also where the ranges' bounds come from a sample."""

from plumbline.llm import warc


def test_same_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE", 5)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    made = [warc.write_archive(df, f"file://{tmp_path}/{k}", roll=200_000, shards=8) for k, df in enumerate((pages, pages.repartition(7), pages.orderBy("url")))]
    assert made[0] == made[1] == made[2] and len(made[0]) >= 8
    assert max(x["records"] for x in made[0]) < 4 * min(x["records"] for x in made[0] if x["name"].endswith("-00000.warc.gz"))
    got = warc.read_archive(spark, f"file://{tmp_path}/2", payloads=False)
    assert got.count() == pages.count() == sum(x["records"] for x in made[2])


def test_one_id_in_several_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SAMPLE", 50)
    rows = [(1, "u", f"page {k}") for k in range(300)] + [(2, "u", "page 7"), (2, "u", None), (None, "u", "page 7"), (3, None, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc.write_archive(pages, f"file://{tmp_path}/a", shards=4)
    assert len(made) >= 4
    got = warc.read_archive(spark, f"file://{tmp_path}/a").collect()
    assert sorted(repr((r.page_id, r.record_type, r.refers_to)) for r in got if r.page_id != 1) == sorted(map(repr, [(2, "revisit", 1), (2, "response", None), (None, "response", None), (3, "revisit", 2)]))
    assert {bytes(r.payload).decode() for r in got if r.page_id == 1} == {f"page {k}" for k in range(300)}
