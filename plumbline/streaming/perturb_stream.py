"""Perturbation of a stream of programs: only operators that need one row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import perturb
from plumbline.sources import schemas


def read_programs(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(schemas.PROGRAMS).csv(folder, header=True, escape='"')


def perturbed_stream(programs: DataFrame) -> DataFrame:
    rows = programs.select("question_id", "question_text", "decomposition", F.lit(None).cast("double").alias("number"))
    made = rows.mapInPandas(perturb._run, perturb.SCHEMA)
    return made.where(F.forall(F.map_values("checks"), lambda c: c))
