"""Joins of predictions with originals, indicators, and the reports over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import first_number, once
from plumbline.operators.perturb import parts_of_id


def predictions(raw: DataFrame) -> DataFrame:
    """qid, f1, em, answer of rows that call the id qid or query_id; the last of repeated ids stays."""
    ids = [F.col(c) for c in ("qid", "query_id") if c in raw.columns]
    answer = F.col("answer.value") if "answer" in raw.columns and raw.schema["answer"].dataType.typeName() == "struct" else F.col("answer") if "answer" in raw.columns else F.lit(None).cast("string")
    rows = raw.select(F.coalesce(*ids).alias("qid"), F.struct(F.col("f1").cast("double").alias("f1"), F.col("em").cast("double").alias("em"), answer.cast("string").alias("answer")).alias("p"), F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("qid").agg(F.max_by("p", "at").alias("p")).select("qid", "p.*")


def with_originals(generated: DataFrame, original: DataFrame) -> DataFrame:
    """Generated predictions with those of the example that they were made from."""
    gen = parts_of_id(generated, "qid")
    same = [c for c in original.columns if c != "qid"]
    renamed = gen.withColumnsRenamed({c: f"{c}_gen" for c in same if c in gen.columns})
    return renamed.join(original.select(F.col("qid").alias("base_id"), *[F.col(c).alias(f"{c}_orig") for c in same]), "base_id")


def constraint_met(prediction: Column, constraint: Column, original: Column) -> Column:
    """Whether a prediction is what a constraint asks for; null where that can't be told."""
    def met(x: Column) -> Column:
        p, o = x["p"], x["o"]
        return (
            F.when(constraint == "boolean", F.coalesce(F.lower(prediction).isin("yes", "no"), F.lit(False)))
            .when(constraint == "arithmetic", p.isNotNull())
            .when((constraint == ">=") & o.isNotNull(), F.coalesce(p >= o, F.lit(False)))
            .when((constraint == "<=") & o.isNotNull(), F.coalesce(p <= o, F.lit(False)))
            .cast("int")
        )

    return once(F.struct(first_number(prediction).alias("p"), first_number(original).alias("o")), met)


# What the aggregate of the same values must be after another operator takes its place.
CONSTRAINTS = {
    "min-max": ">=", "max-min": "<=", "sum-min": "<=", "sum-max": "<=", "avg-min": "<=", "avg-max": ">=",
    "sum-difference": "<=", "difference-sum": ">=",
}


def constraint_of(kind: Column, info: Column) -> Column:
    """The constraint on the answer of a perturbed program, from its transform; null if there is none."""
    pair = F.regexp_extract(info, r"^\d+-([a-z]+)-([a-z]+)", 1), F.regexp_extract(info, r"^\d+-([a-z]+)-([a-z]+)", 2)
    known = F.create_map(*[F.lit(x) for item in CONSTRAINTS.items() for x in item])
    new = F.get(F.split(info, "-"), F.lit(2))
    return F.when(kind.isin("op_replace_aggregate", "op_replace_arithmetic"), known[F.concat_ws("-", *pair)]).when((kind == "change_last_step") & new.isin("boolean", "arithmetic"), new)


def both_right(threshold: float | None = 0.8) -> Column:
    """Whether original and generated answers are right: F1 over a threshold, or exact matches."""
    if threshold is None:
        return ((F.col("em_orig") == 1) & (F.col("em_gen") == 1)).cast("int")
    return ((F.col("f1_orig") > threshold) & (F.col("f1_gen") > threshold)).cast("int")


def right_and_met(threshold: float | None = 0.8) -> Column:
    """Answer rows: both right. Constraint rows (with score_gen): the original right and the constraint met."""
    orig = F.col("f1_orig") > threshold if threshold is not None else F.col("em_orig") == 1
    return F.when(F.col("score_gen").isNull(), both_right(threshold)).otherwise((orig & (F.col("score_gen") == 1)).cast("int"))


def consistency(rows: DataFrame, group: str = "base_id", indicator: str = "indicator") -> DataFrame:
    """Share of groups of which every member's indicator is 1."""
    return rows.groupBy(group).agg(F.min(indicator).alias("all_right")).agg(F.avg("all_right").alias("consistency"), F.count("*").alias("n_groups"))


def by_transform(rows: DataFrame, score: str, key: str = "transform_base") -> DataFrame:
    return rows.groupBy(key).agg(F.round(F.avg(score), 3).alias("mean_score"), F.count(score).alias("n")).orderBy(F.desc("n"), key)


def overall(rows: DataFrame, score: str, once_per: list[str] | None = None) -> DataFrame:
    return (rows.dropDuplicates(once_per) if once_per else rows).agg(F.round(F.avg(score), 3).alias("mean_score"))


def together(answers: DataFrame, constraints: DataFrame, only_answered: bool = True) -> DataFrame:
    """Answer and constraint rows as one table; columns that one of them lacks are null."""
    if only_answered:
        constraints = constraints.join(answers.select("base_id").distinct(), "base_id", "left_semi")
    return answers.unionByName(constraints, allowMissingColumns=True)


def merged_prunes(column: Column) -> Column:
    return F.when(column.startswith("prune"), F.lit("prune_step")).otherwise(column)
