"""The answers of one small file are found by several tasks."""

from pyspark.sql import functions as F

from plumbline.operators import assemble, assembly_catalogue

SF = "/root/testdata/sf0.001"


def test_answers_are_spread(spark):
    made, questions, step_answers, originals = assembly_catalogue._inputs(spark, SF)
    rows = assemble.answered(assemble.joined(made.drop("step_answers", "event_id"), questions, step_answers, originals))
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1
