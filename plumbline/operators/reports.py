"""Reports as DataFrames, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import assemble, evaluate


def of_examples(info: DataFrame) -> dict[str, DataFrame]:
    return {"by transform": assemble.counters(info), "by what answered": assemble.answered_by_counts(info)}


def _consistency(rows: DataFrame, right) -> DataFrame:
    """Shares of original examples of which every row is right, by exact match and by F1."""
    em, f1 = (evaluate.consistency(rows.withColumn("indicator", right(t))).select(F.round("consistency", 3).alias(name)) for name, t in (("em", None), ("f1", 0.8)))
    return em.join(f1)  # a row each


def _once(rows: DataFrame, key: str) -> DataFrame:
    """Scores of originals by a column, each original once for each of its values."""
    return evaluate.by_transform(rows.select("base_id", "f1_orig", key).distinct(), "f1_orig", key)


def of_answers(generated: DataFrame, original: DataFrame, merge_prunes: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows of both predictions (qid, f1, em) together, and their reports."""
    rows = evaluate.with_originals(generated, original)
    if merge_prunes:
        rows = rows.withColumn("transform_base", evaluate.merged_prunes(F.col("transform_base")))
    return rows, {
        "generated": evaluate.overall(generated, "f1"), "original": evaluate.overall(original, "f1"), "generated by transform": evaluate.by_transform(rows, "f1_gen"),
        "original by transform": _once(rows, "transform_base"), "consistency": _consistency(rows, evaluate.both_right),
    }


def of_constraints(predictions: DataFrame, info: DataFrame, original: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows of predictions(qid, prediction) that a constraint of info judges, with their originals (qid, f1, em), and reports."""
    judged = assemble.constraint_predictions(predictions, info)
    rows = assemble.constraints_with_originals(judged, original).withColumns({"f1_gen": F.lit(None).cast("double"), "em_gen": F.lit(None).cast("double")})
    return rows, {
        "generated": evaluate.overall(judged, "score_gen"), "original": evaluate.overall(original, "f1"), "generated by constraint": evaluate.by_transform(judged, "score_gen", "constraint"),
        "original by constraint": _once(rows, "constraint"), "consistency": _consistency(rows, evaluate.right_and_met),
    }


def of_both(answers: DataFrame, constraints: DataFrame) -> dict[str, DataFrame]:
    return {"consistency": _consistency(evaluate.together(answers.withColumn("score_gen", F.lit(None).cast("double")), constraints), evaluate.right_and_met)}
