"""Writers, each one distributed write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import from_marks


def perturbed_csv(made: DataFrame, path: str) -> None:
    """The file of perturbations: the original program, the perturbed one and the transform; without the questions that rules rewrote."""
    made.select("id", "question", F.col("orig_decomposition").alias("decomposition"), F.col("decomposition").alias("transformation"), F.col("transformation").alias("type")).write.csv(path, header=True, escape='"')


def augmented_csv(made: DataFrame, path: str, split: str = "train") -> None:
    """Rewritten questions as a program file."""
    rows = made.where("transformed_question IS NOT NULL")
    rows.select(F.col("id").alias("question_id"), F.col("transformed_question").alias("question_text"), "decomposition", F.to_json("operators").alias("operators"), F.lit(split).alias("split")).write.csv(path, header=True, escape='"')


def parsed_as_programs(parsed: DataFrame, marks: bool = True) -> DataFrame:
    """Parser output (qid, question, decomposition array) as rows of a program file."""
    steps = F.transform("decomposition", lambda t: F.concat(F.lit("return "), from_marks(t) if marks else t))
    return parsed.select(F.col("qid").alias("question_id"), F.col("question").alias("question_text"), F.array_join(steps, " ;").alias("decomposition"), F.lit("").alias("operators"), F.lit("dev").alias("split"))


def parser_input(questions: DataFrame, dataset: str, split: str = "dev") -> DataFrame:
    """question_id, source of flat questions(passage_id, query_id, question)."""
    parts = ["passage_id", "query_id"] if dataset != "hotpotqa" else ["query_id"]
    return questions.select(F.concat_ws("_", F.lit(dataset.upper().removesuffix("QA")), F.lit(split), *parts).alias("question_id"), F.col("question").alias("source"))


def nested_json(flat: DataFrame, path: str) -> None:
    """Flat questions as one line a passage: passage_id, passage, qa_pairs."""
    qa = F.array_sort(F.collect_list(F.struct("query_id", "question", "answer")), lambda a, b: F.when(a["query_id"] < b["query_id"], -1).when(a["query_id"] > b["query_id"], 1).otherwise(0))
    flat.groupBy("passage_id", "passage").agg(qa.alias("qa_pairs")).write.json(path)


def numeric_json(parts: list[DataFrame], path: str) -> None:
    """question_id, number of several sources, a line each; where two have one id, the later source counts."""
    every = parts[0].withColumn("_at", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("_at", F.lit(k)))
    every.groupBy("question_id").agg(F.max_by("number", "_at").alias("number")).write.json(path)


def parser_inputs(parts: dict[str, DataFrame], path: str, split: str = "dev") -> None:
    """One file of the parser's input from flat questions of several data sets."""
    rows = [parser_input(df, dataset, split) for dataset, df in parts.items()]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    out.write.csv(path, header=True, escape='"')


def example_files(info: DataFrame, path: str, failures: bool = False) -> None:
    """Example info (or the rows that failed) and constraints, as JSON lines in two folders."""
    from plumbline.operators.assemble import kept_examples

    kept, constraints = kept_examples(info, failures)
    kept.write.json(f"{path}_example_info{'_failure_cases' if failures else ''}")
    constraints.select("qid", "constraint", "orig_answer_texts").write.json(f"{path}_constraints")
