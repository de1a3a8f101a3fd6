"""spark-submit entry: python -m plumbline.cli <command> ...; see --help for the commands."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import assemble, evaluate, perturb, predict, reports, sampling
from plumbline.sources import readers, schemas, writers


def _perturb(spark: SparkSession, a: argparse.Namespace) -> None:
    programs = readers.programs(spark, a.input_file)
    numbers = spark.read.json(a.numeric_qa_file) if a.numeric_qa_file else None
    made = perturb.filtered(perturb.perturbed(programs, numbers), programs)
    if a.limit_append_boolean_step_per_program >= 0:
        made = perturb.capped(made, "append_boolean_step", a.limit_append_boolean_step_per_program)
    writers.perturbed_csv(perturb.for_dataset(made, a.dataset_name), a.output_file)
    writers.augmented_csv(made, a.output_file + "_augmented_qs")


def _show(title: str, found: dict) -> None:
    for name, df in found.items():
        print(f"{title}: {name}")
        df.show(100, False)


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = constraints = None
    if a.gen_preds_path:
        read = [evaluate.predictions(readers.predictions(spark, p)) for p in (a.gen_preds_path, a.orig_preds_path)]
        rows, found = reports.of_answers(*read, merge_prunes=a.merge_prune_trans)
        if not a.only_merged:
            _show("answers", found)
    if a.gen_const_preds_path:
        predictions = evaluate.predictions(readers.predictions(spark, a.gen_const_preds_path)).select("qid", F.col("answer").alias("prediction"))
        constraints, found = reports.of_constraints(predictions, spark.read.json(a.example_info_file), evaluate.predictions(readers.predictions(spark, a.orig_const_preds_path)))
        if not a.only_merged:
            _show("constraints", found)
    if rows is not None and constraints is not None:
        _show("answers and constraints", reports.of_both(rows, constraints))


def _example_info(spark: SparkSession, a: argparse.Namespace) -> None:
    made = readers.transformed_programs(spark, a.qdmrs_path, a.dataset_name)
    rows = assemble.joined(made, readers.jsonl(spark, a.gen_qs_path, "QUESTIONS"), spark.read.schema(schemas.STEP_ANSWERS).json(a.pred_step_ans_path, multiLine=True), readers.originals(spark, a.orig_data_path, a.dataset_name))
    info = assemble.example_info(rows, a.dataset_name, a.allow_yes_no)
    writers.example_files(info, a.output_path, a.failures)
    _show("examples", reports.of_examples(info))


def _examples(spark: SparkSession, a: argparse.Namespace) -> None:
    info = spark.read.schema(assemble.INFO).json(a.example_info_path)
    if a.validated_qids_path:
        info = sampling.subset(info, readers.ids(spark, a.validated_qids_path), "qid")
    if a.sampling > -1:
        info = sampling.stratified(info, "transform_base", "qid", sampling.share_of(a.train_examples, a.sampling))
    out = assemble.as_squad(info) if a.data_format == "hotpot-squad" else assemble.as_drop(info, a.allow_yes_no or a.data_format == "iirc", a.append_yes_no)
    out.write.json(a.output_path)


def _subset(spark: SparkSession, a: argparse.Namespace) -> None:
    ids = readers.program_ids(spark, a.break_data_path, a.data_format)
    flat = readers.hotpot_questions(spark, a.orig_data_path) if a.data_format == "hotpot-squad" else readers.drop_questions(spark, a.orig_data_path)
    key = F.concat_ws("_", "passage_id", "query_id") if a.data_format == "drop" else F.col("query_id")
    kept = flat.withColumn("qid", key).join(ids, "qid", "left_semi").withColumn("answer", F.col("answers")[0])
    writers.nested_json(kept, a.output_path)


def _numeric(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.numeric_json([readers.numeric_answers_of(spark, path, dataset, a.split) for dataset, path in (x.split("=", 1) for x in a.file)], a.output_file)


def _parser_input(spark: SparkSession, a: argparse.Namespace) -> None:
    read = {"drop": readers.drop_questions, "iirc": readers.drop_questions, "hotpotqa": readers.hotpot_questions}
    writers.parser_inputs({dataset: read[dataset](spark, path) for dataset, path in (x.split("=", 1) for x in a.file)}, a.output_file)


def _programs(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.parsed_as_programs(readers.jsonl(spark, a.input_file, "PARSED")).write.csv(a.output_file, header=True, escape='"')


def _step_answers(spark: SparkSession, a: argparse.Namespace) -> None:
    predict.with_step_answers(spark.read.json(a.input_file), a.predictor).write.json(a.output_file)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="plumbline")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("perturb")
    p.add_argument("--input_file", required=True)
    p.add_argument("--output_file", required=True)
    p.add_argument("--numeric_qa_file")
    p.add_argument("--dataset_name", choices=("drop", "hotpotqa", "iirc"), required=True)
    p.add_argument("--limit_append_boolean_step_per_program", type=int, default=-1)
    p.set_defaults(run=_perturb)
    p = sub.add_parser("evaluate")
    for name in ("gen_preds_path", "orig_preds_path", "gen_const_preds_path", "orig_const_preds_path", "example_info_file"):
        p.add_argument(f"--{name}")
    p.add_argument("--merge_prune_trans", action="store_true")
    p.add_argument("--only_merged", action="store_true")
    p.set_defaults(run=_evaluate)
    p = sub.add_parser("example-info")
    for name in ("qdmrs_path", "gen_qs_path", "pred_step_ans_path", "orig_data_path", "output_path"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--dataset_name", choices=("drop", "hotpot-squad", "iirc"), required=True)
    p.add_argument("--allow_yes_no", action="store_true")
    p.add_argument("--failures", action="store_true")
    p.set_defaults(run=_example_info)
    p = sub.add_parser("examples")
    p.add_argument("--example_info_path", required=True)
    p.add_argument("--output_path", required=True)
    p.add_argument("--data_format", choices=("drop", "hotpot-squad", "iirc"), required=True)
    p.add_argument("--validated_qids_path")
    p.add_argument("--sampling", type=float, default=-1)
    p.add_argument("--train_examples", type=int, default=0)
    p.add_argument("--allow_yes_no", action="store_true")
    p.add_argument("--append_yes_no", action="store_true")
    p.set_defaults(run=_examples)
    p = sub.add_parser("subset")
    for name in ("break_data_path", "orig_data_path", "output_path"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--data_format", choices=("drop", "hotpot-squad", "iirc"), required=True)
    p.set_defaults(run=_subset)
    for command, run in (("numeric", _numeric), ("parser-input", _parser_input)):
        p = sub.add_parser(command)
        p.add_argument("--file", action="append", required=True, metavar="DATASET=PATH")
        p.add_argument("--split", default="dev")
        p.add_argument("--output_file", required=True)
        p.set_defaults(run=run)
    p = sub.add_parser("programs")
    p.add_argument("--input_file", required=True)
    p.add_argument("--output_file", required=True)
    p.set_defaults(run=_programs)
    p = sub.add_parser("step-answers")
    p.add_argument("--input_file", required=True)
    p.add_argument("--output_file", required=True)
    p.add_argument("--predictor", default="stub", choices=sorted(predict.REGISTRY))
    p.set_defaults(run=_step_answers)
    a = top.parse_args(argv)
    a.run(SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
