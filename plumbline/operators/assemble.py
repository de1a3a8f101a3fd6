"""Examples from perturbed programs: programs, generated questions, step answers and the original examples come together,
answers are found by rule or by evaluating the steps' answers, and what can't be an example of a data set is left out.

All joins are equi-joins by id. Rules are column expressions, computed once before one Arrow pass that judges answers,
compares two options, and evaluates the step answers of rows without a valid answer.

An answer is a number (`answer_number`) or texts (`answer_spans`); both are null where there is none. `answered_by` says
what found it: the transform's rule or `evaluation`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import once
from plumbline.operators import answers as rules
from plumbline.operators.evaluate import constraint_of
from plumbline.operators.perturb import operators_of, parts_of_id
from plumbline.sources.schemas import ANSWER

NUMBER, SPANS = "answer_number", "answer_spans"
#: What example files have of each example.
INFO = f"qid string, orig_id string, question string, transform_base string, transform_info string, passage_id string, passage string, generated_question string, {NUMBER} double, {SPANS} array<string>, answered_by string"
PAIR_OPS = ("sum", "difference", "multiplication")


def said(number: Column) -> Column:
    """A number as text, whole ones without a fraction."""
    return F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))


# ---------------------------------------------------------------- the join


def joined(made: DataFrame, questions: DataFrame, step_answers: DataFrame, originals: DataFrame) -> DataFrame:
    """made(id, orig_id, question, decomposition, transformed) with generated_question of questions(qid, questions), step_answers
    of step_answers(qid, step_answers), and of originals(query_id, passage_id, passage, answer_texts, numbers) the rest. Rows
    that lack a question or step answers are skipped; one whose original example is missing is an error when it is read."""
    rows = parts_of_id(made.withColumnRenamed("id", "qid"), "qid").drop("base_id")
    asked = questions.select("qid", F.element_at(F.element_at("questions", 1), 1).alias("generated_question"))
    known = originals.select(F.col("query_id").alias("orig_id"), F.lit(True).alias("_known"), "passage_id", "passage", F.col("answer_texts").alias("orig_answer_texts"), F.col("numbers").alias("orig_numbers"))
    out = rows.join(asked, "qid").join(step_answers.select("qid", "step_answers"), "qid").join(known, "orig_id", "left")
    lost = F.raise_error(F.concat(F.lit("no original example "), "orig_id")).cast("string")
    return out.withColumn("passage_id", F.when(F.col("_known").isNull(), lost).otherwise(F.col("passage_id"))).drop("_known")


def skipped(made: DataFrame, questions: DataFrame, step_answers: DataFrame) -> DataFrame:
    """Perturbed programs without a generated question or step answers."""
    there = questions.select(F.col("qid").alias("id")).join(step_answers.select(F.col("qid").alias("id")), "id", "left_semi")
    return made.join(there, "id", "left_anti")


# ---------------------------------------------------------------- answers


def _short(spans: list[str]) -> bool:
    return any(x.strip() for x in spans) and all(len(x.split(" ")) <= rules.MOST_WORDS for x in spans)


def valid(number: float | None, spans: list[str] | None, last_step: str) -> bool:
    """A number, or texts of eight words at most that aren't all blank; a step that asks whether needs yes or no."""
    if last_step.lower().startswith("if"):
        return spans in (["yes"], ["no"])
    return number is not None or bool(spans) and _short(spans)


def evaluated_value(steps: list[str], found: list[str | None]) -> tuple[float | None, list[str] | None]:
    """The value of the last step: a number or texts."""
    value = rules.evaluated(steps, [*found, *[None] * len(steps)][: len(steps)])[-1] if steps else None
    if isinstance(value, int | float):
        return float(value), None
    return None, None if value is None else [str(x) for x in value] if isinstance(value, list) else [str(value)]


def _decided(row: dict) -> tuple[float | None, list[str] | None, str | None]:
    """Number, texts and what found them."""
    kind, steps = row["kind"], row["transformed"] or []
    number, spans = row["number"], row["spans"]
    if kind in ("op_replace_comparison", "op_replace_superlative") and row["question"] and row["original"]:
        other = rules.other_option(rules.options_of(row["question"]), row["original"])
        spans = None if other is None else [other]
    if valid(number, spans, steps[-1] if steps else ""):
        return number, spans, kind
    number, spans = evaluated_value(steps, row["step_answers"] or [])
    return (number, spans, "evaluation") if valid(number, spans, steps[-1] if steps else "") else (None, None, None)


def _finish(batches):
    """The rules' answers come in the struct `_rule`; other columns stay as they are."""
    for batch in batches:
        at = batch.schema.get_field_index("_rule")
        found = [_decided(x) for x in batch.column(at).to_pylist()]
        names = [n for n in batch.schema.names if n != "_rule"]
        new = [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.float64(), pa.list_(pa.string()), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *new], names=[*names, NUMBER, SPANS, "answered_by"])


def _pairs(rows: DataFrame) -> DataFrame:
    """qid, low, high: the one pair of a passage's numbers that gives the original answer of a replaced arithmetic step."""
    some = rows.where("transform_base = 'op_replace_arithmetic'").select("qid", "orig_numbers", F.element_at("orig_answer_texts", 1).try_cast("double").alias("answer"), F.get(F.split("transform_info", "-"), F.lit(1)).alias("op"))
    some = some.where("answer IS NOT NULL AND orig_numbers IS NOT NULL").withColumnRenamed("orig_numbers", "numbers")
    found = [rules.number_pairs(some.where(F.col("op") == op), op) for op in PAIR_OPS]
    return found[0].unionByName(found[1]).unionByName(found[2])


def answered(rows: DataFrame) -> DataFrame:
    """rows of joined() with answer_number, answer_spans and answered_by. A rule's answer that isn't valid counts as none, and
    then, as without a rule, the steps are evaluated."""
    kind, info = F.col("transform_base"), F.split("transform_info", "-")
    part = lambda k: F.get(info, F.lit(k))
    original, first = F.element_at("orig_answer_texts", 1), F.get("step_answers", F.lit(0))
    last = F.element_at(F.split("decomposition", ";"), -1)
    pruned = F.when(kind.isin("prune_last_step", "prune_last_step_rm_unused", "prune_step"), rules.pruned_answer(F.col("transformed"), last, first, original, kind))
    of_100 = 100 - original.try_cast("double")
    hundred = F.coalesce(F.lower(last).contains("difference of 100 and #1") & (pruned == of_100.cast("string")), F.lit(False))
    text = (
        F.when(kind == "op_replace_boolean", rules.boolean_answer(original, part(1), part(2)))
        .when(kind == "append_boolean_step", rules.appended_answer(original, part(2), part(3)))
        .when(~hundred, pruned)
    )
    number = F.when(kind == "op_replace_arithmetic", rules.of_pair(part(2), F.col("low"), F.col("high"))).when(hundred, of_100)
    rule = F.struct(kind.alias("kind"), "transformed", "step_answers", "question", original.alias("original"), number.alias("number"), once(text, lambda t: F.when(t.isNotNull(), F.array(t))).alias("spans"))
    # rules and Python take longer than rows are wide: Spark would leave some MB of them to one task, and drops a repartition by the joined id
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    full = rows.join(_pairs(rows), "qid", "left").repartition(tasks, F.xxhash64("qid")).select(*rows.columns, rule.alias("_rule"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return full.mapInArrow(_finish, f"{kinds}, {NUMBER} double, {SPANS} array<string>, answered_by string")


# ---------------------------------------------------------------- formats


def drop_answer(question: Column, passage: Column, yes_no: bool) -> Column:
    """The answer structure of nested files, or null: texts must all be in question or passage; yes and no only where allowed."""
    number, spans = F.col(NUMBER), F.col(SPANS)
    date, none = F.struct(*[F.lit("").alias(c) for c in ("day", "month", "year")]), F.array().cast("array<string>")
    decided = (F.size(spans) == 1) & spans[0].isin("yes", "no")
    there = F.forall(spans, lambda s: question.contains(s) | passage.contains(s))
    fits = there | decided if yes_no else there & ~decided
    out = F.when(number.isNotNull(), F.struct(said(number).alias("number"), date.alias("date"), none.alias("spans"))).when(fits, F.struct(F.lit("").alias("number"), date.alias("date"), spans.alias("spans")))
    return out.cast(ANSWER)


def squad_answer(passage: Column) -> Column:
    """text and answer_start (-1 where the passage hasn't it)."""
    return rules.to_span(F.coalesce(said(F.col(NUMBER)), F.array_join(SPANS, ";")), passage)


def example_info(rows: DataFrame, dataset: str, allow_yes_no: bool = False) -> DataFrame:
    """rows of joined() with constraint and answer; `bad_form` are those whose answer the data set's format can't hold, and
    they lose it."""
    full = answered(rows).withColumn("constraint", constraint_of(F.col("transform_base"), F.col("transform_info")))
    if dataset == "hotpot-squad":
        span = squad_answer(F.col("passage"))
        good = span["text"].isin("yes", "no") | (span["answer_start"] > -1)
    else:
        good = drop_answer(F.col("question"), F.col("passage"), allow_yes_no or dataset == "iirc").isNotNull()
    found = F.col("answered_by").isNotNull()
    full = full.withColumn("bad_form", found & ~F.coalesce(good, F.lit(False)))
    return full.withColumns({c: F.when(~F.col("bad_form"), F.col(c)) for c in (NUMBER, SPANS, "answered_by")})


def kept_examples(info: DataFrame, failures: bool = False) -> tuple[DataFrame, DataFrame]:
    """(examples, constraints) whose generated question isn't the original one: examples with an answer (failures: without one)."""
    asked = info.where("generated_question IS NOT NULL AND generated_question <> question")
    answer = F.col("answered_by").isNotNull()
    return asked.where(~answer if failures else answer), asked.where("constraint IS NOT NULL")


def counters(info: DataFrame) -> DataFrame:
    """For each kind of transform how many rows have an answer, one of bad form, none, a constraint, both, and neither."""
    a, c = F.col("answered_by").isNotNull(), F.col("constraint").isNotNull()
    return info.groupBy("transform_base").agg(
        F.count("*").alias("n"), F.count_if(a).alias("answers"), F.count_if("bad_form").alias("bad_form"), F.count_if(~a & ~F.col("bad_form")).alias("no_answer"),
        F.count_if(c).alias("constraints"), F.count_if(a & c).alias("both"), F.count_if(~a & ~c).alias("neither"),
    )


def answered_by_counts(info: DataFrame) -> DataFrame:
    return info.where("answered_by IS NOT NULL").groupBy("answered_by").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- files


def as_drop(info: DataFrame, yes_no: bool = False, append_yes_no: bool = False) -> DataFrame:
    """A row a passage: passage_id, passage, wiki_url, qa_pairs. Examples whose answer doesn't fit are left out."""
    question = F.concat("generated_question", F.lit(" yes no" if append_yes_no else ""))
    flat = info.select("passage_id", "passage", F.struct(F.col("qid").alias("query_id"), question.alias("question"), drop_answer(F.col("question"), F.col("passage"), yes_no).alias("answer")).alias("qa")).where("qa.answer IS NOT NULL")
    return flat.groupBy("passage_id").agg(F.min("passage").alias("passage"), F.lit("").alias("wiki_url"), _by_id(F.collect_list("qa"), "query_id").alias("qa_pairs"))


def _by_id(items: Column, key: str) -> Column:
    return F.array_sort(items, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))


def as_squad(info: DataFrame) -> DataFrame:
    """A row a title: title, paragraphs(context, qas); a passage id is its title, an underscore and its number in it."""
    title, at = F.regexp_extract("passage_id", r"^(.*)_([^_]*)$", 1), F.regexp_extract("passage_id", r"^(.*)_([^_]*)$", 2)
    there = F.col("answered_by").isNotNull()
    qa = F.struct(F.col("qid").alias("id"), F.col("generated_question").alias("question"), F.when(there, F.array(squad_answer(F.col("passage")))).alias("answers"), F.when(there, F.lit(False)).alias("is_impossible"), F.when(there, F.lit(False)).alias("is_distant"))
    flat = info.select(title.alias("title"), at.alias("at"), "passage", qa.alias("qa"))
    paragraphs = flat.groupBy("title", "at").agg(F.min("passage").alias("context"), _by_id(F.collect_list("qa"), "id").alias("qas"))
    packed = F.array_sort(F.collect_list(F.struct(F.col("at").try_cast("int").alias("n"), "at", "context", "qas")), lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0))
    return paragraphs.groupBy("title").agg(F.transform(packed, lambda p: F.struct(p["context"].alias("context"), p["qas"].alias("qas"))).alias("paragraphs"))


# ---------------------------------------------------------------- constraints on predictions, known shapes


def constraint_predictions(predictions: DataFrame, info: DataFrame) -> DataFrame:
    """predictions(qid, prediction) with base_id, the transform's parts, constraint and score_gen; what can't be told is left out."""
    from plumbline.operators.evaluate import constraint_met

    asked = info.select("qid", "constraint", F.concat_ws(" ", "orig_answer_texts").alias("original"))
    rows = predictions.select("qid", "prediction").join(asked, "qid")
    rows = rows.withColumn("score_gen", constraint_met(F.col("prediction"), F.col("constraint"), F.col("original")).cast("double")).where("score_gen IS NOT NULL")
    return parts_of_id(rows.drop("original"), "qid")


def constraints_with_originals(predictions: DataFrame, original: DataFrame) -> DataFrame:
    """Rows of constraint_predictions with f1_orig and em_orig of original(qid, f1, em)."""
    return predictions.join(original.select(F.col("qid").alias("base_id"), F.col("f1").alias("f1_orig"), F.col("em").alias("em_orig")), "base_id")


def of_known_shape(made: DataFrame, programs: DataFrame, exempt: tuple[str, ...] = ("append_boolean",)) -> DataFrame:
    """Perturbations whose program has a shape (the steps' operators and their arguments' kinds) that some program has; kinds
    that begin with an exempt prefix stay."""
    shape = F.array_join("encodings", " ").alias("shape")
    known = operators_of(programs).select(shape).distinct()
    shapes = operators_of(made.select(F.col("id").alias("question_id"), "decomposition")).select(F.col("question_id").alias("id"), shape)
    fits = shapes.join(known, "shape", "left_semi").select("id").distinct()
    free = F.lit(False)
    for prefix in exempt:
        free = free | F.col("transformation").startswith(prefix)
    return made.where(free).unionByName(made.where(~free).join(fits, "id", "left_semi"))
