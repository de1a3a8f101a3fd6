"""Positions in parts against a sort, with ties and nulls, and as many parts as it takes."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import sampling


@pytest.mark.parametrize("parts, sample", [(64, 100), (5, 3), (1, 1)])
def test_positions(spark, parts, sample):
    df = spark.range(3000).select(F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") * 7919 % 97).cast("double")).alias("v"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("k")).repartition(5)
    got = sampling.positions(df, ["v", "k"], parts=parts, sample=sample).collect()
    want = sorted(df.collect(), key=lambda r: (r.v is not None, r.v or 0.0, r.k))
    assert [(r.v, r.k) for r in sorted(got, key=lambda r: r.position)] == [tuple(r) for r in want]
    assert sorted(r.position for r in got) == list(range(1, 3001))
    assert sampling.positions(df.limit(0), ["v", "k"]).count() == 0


def test_strata_of_their_own_size(spark):
    df = spark.range(100).withColumn("s", (F.col("id") % 3).cast("string"))
    got = {r.s: r["count"] for r in sampling.stratified(df, "s", "id", {"0": 7, "1": 2}).groupBy("s").count().collect()}
    assert got == {"0": 7, "1": 2}
    assert sampling.stratified(df, "s", "id", {"0": 7, "1": 2}, strict=True).count() == 9
    with pytest.raises(Exception, match="too few rows of 1"):
        sampling.stratified(df, "s", "id", {"0": 7, "1": 60}, strict=True).collect()
