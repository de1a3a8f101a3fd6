"""Readers of program and question files, flat rows out; compressed files are opened by their extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import lead_standardized, number_of, numbers_in, standardized, to_marks
from plumbline.sources import schemas as s

DATASETS = {"drop": "drop", "hotpotqa": "hotpotqa", "hotpot-squad": "hotpotqa", "iirc": "iirc"}


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def programs(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Program files of five columns."""
    out = _csv(spark, path, s.PROGRAMS)
    return out.limit(limit) if limit is not None else out


def perturbations(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Perturbation files, optionally of one data set, with the transform's parts."""
    out = _csv(spark, path, s.PERTURBED)
    if dataset:
        out = out.where(F.lower("id").contains(DATASETS[dataset].removesuffix("qa")))
    parts = F.split("id", r"\+", 3)
    return out.withColumns({"orig_id": parts[0], "transform_base": F.get(parts, F.lit(1)), "transform_info": F.get(parts, F.lit(2))})


def transformed_programs(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """id, orig_id, question, decomposition, transformed (steps) and transformation of the rows of a data set in a file of
    perturbations. orig_id is the question's id in the data set's own file."""
    whole = F.split(F.split("id", r"\+", 2)[0], "_", 3)
    own = F.regexp_extract(whole[2], r"([^_]*)$", 1) if dataset == "iirc" else whole[2]
    rows = _csv(spark, path, s.PERTURBED).where(F.size(whole) == 3).where(F.lit(dataset).contains(F.lower(whole[0])))
    return rows.select("id", own.alias("orig_id"), "question", "decomposition", steps_of(F.col("transformation")).alias("transformed"), F.col("type").alias("transformation"))


def originals(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """query_id, passage_id, passage, answer_texts and numbers of the original examples of drop, iirc (as one file of nested
    passages each) or hotpot-squad."""
    numbers = F.transform(numbers_in(F.col("passage")), lambda x: x["v"])
    numbers = F.slice(numbers, F.lit(1), F.size(numbers) - 1)  # without the sentinel
    if dataset == "hotpot-squad":
        rows = hotpot_questions(spark, path)
        return rows.select("query_id", "passage_id", "passage", F.transform("answers", lambda a: a["text"]).alias("answer_texts"), numbers.alias("numbers"))
    gold = F.col("answers")[0]
    date = F.filter(F.array(gold["date"]["day"], gold["date"]["month"], gold["date"]["year"]), lambda x: F.coalesce(x, F.lit("")) != "")
    texts = F.when(F.coalesce(gold["number"], F.lit("")) != "", F.array(gold["number"])).when(F.size(gold["spans"]) > 0, gold["spans"]).otherwise(date)
    own = F.concat_ws("_", "passage_id", "query_id") if dataset == "drop" else F.col("query_id")
    return drop_questions(spark, path).select(own.alias("query_id"), "passage_id", "passage", texts.alias("answer_texts"), numbers.alias("numbers"))


def program_rows(spark: SparkSession, path: str, prefix: str = "", marks: bool = True) -> DataFrame:
    """question_id, source (the prefix and the question) and, of files of five columns, the steps; files of two columns
    have question_id and source alone."""
    if len(spark.read.csv(path, header=True).columns) == 2:
        rows = _csv(spark, path, s.PARSER_INPUT)
        return rows.select("question_id", F.concat(F.lit(prefix), F.col("source")).alias("source"), F.lit(None).cast("array<string>").alias("steps"))
    return _csv(spark, path, s.PROGRAMS).select("question_id", F.concat(F.lit(prefix), F.col("question_text")).alias("source"), steps_of(F.col("decomposition"), marks).alias("steps"))


def reverse_rows(spark: SparkSession, path: str, marks: bool = True) -> DataFrame:
    """question_id, steps and question of a program file, or of a file of perturbations, whose questions are those of the
    original examples; the header decides."""
    if "transformation" in spark.read.csv(path, header=True).columns:
        rows = _csv(spark, path, s.PERTURBED).select(F.col("id").alias("question_id"), "question", "decomposition", F.lit("perturbed").alias("kind"))
    else:
        rows = _csv(spark, path, s.PROGRAMS).select("question_id", F.col("question_text").alias("question"), "decomposition", F.lit("program").alias("kind"))
    return rows.select("question_id", steps_of(F.col("decomposition"), marks).alias("steps"), "question", "kind")


def program_ids(spark: SparkSession, path: str, data_format: str) -> DataFrame:
    """Distinct qid of a program file's rows whose data set's name is part of data_format; ids are dataset_split_qid."""
    parts = F.split("question_id", "_", 3)
    rows = _csv(spark, path, s.PROGRAMS).where(F.size(parts) == 3).where(F.lit(data_format).contains(F.lower(parts[0])))
    return rows.select(parts[2].alias("qid")).distinct()


def steps_of(text: Column, marks: bool = False) -> Column:
    """Texts of the steps: white space collapsed, `return` gone."""
    parts = F.split(F.regexp_replace(text, r"\s+", " "), ";")
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "return", ""), r"\s+", " ")))
    return F.transform(clean, to_marks) if marks else clean


def drop_questions(spark: SparkSession, path: str) -> DataFrame:
    """passage_id, passage, query_id, question, answers (gold, then validated) of a file that maps ids to passages."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", s.DROP)).alias("passage_id", "p"))
    return raw.select("passage_id", "p.passage", F.explode("p.qa_pairs").alias("q")).select(
        "passage_id", "passage", "q.query_id", "q.question", F.concat(F.array("q.answer"), F.coalesce("q.validated_answers", F.array().cast(f"array<{s.ANSWER}>"))).alias("answers")
    )


def _squad(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(s.SQUAD).json(path, multiLine=True)
    pages = raw.select(F.explode("data").alias("d")).select("d.title", F.posexplode("d.paragraphs").alias("at", "p"))
    return pages.select("title", "at", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))


def hotpot_questions(spark: SparkSession, path: str) -> DataFrame:
    """passage_id (title and number), passage, query_id, question, answers; negative examples left out."""
    rows = _squad(spark, path).where(~F.col("q.id").contains("NEGATIVE"))
    return rows.select(F.concat_ws("_", "title", "at").alias("passage_id"), F.col("context").alias("passage"), F.col("q.id").alias("query_id"), F.col("q.question").alias("question"), F.col("q.answers").alias("answers"))


def squad_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions with standardised texts; offsets move by what the standardised context lost at its start. Characters within
    a text keep their places, so an answer stays where it was."""
    rows = _squad(spark, path)
    rows = rows.withColumn("lead", F.length("context") - F.length(lead_standardized(F.col("context"))))
    moved = F.transform(F.coalesce("q.answers", F.array().cast(f"array<{s.SQUAD_ANSWER}>")), lambda a: F.struct(standardized(a["text"]).alias("text"), (a["answer_start"] - F.col("lead")).alias("answer_start")))
    return rows.select(F.col("q.id").alias("query_id"), standardized(F.col("q.question")).alias("question"), standardized(F.col("context")).alias("context"), moved.alias("answers"), F.coalesce("q.is_impossible", F.lit(False)).alias("is_impossible"), F.col("q.is_boolq").isNotNull().alias("is_boolq"))


def _spans(texts: Column) -> Column:
    date = F.struct(*[F.lit("").alias(c) for c in ("day", "month", "year")])
    return F.struct(F.lit("").alias("number"), date.alias("date"), texts.alias("spans"))


def iirc_as_drop(spark: SparkSession, path: str, append_yes_no: bool = False) -> DataFrame:
    """passage_id, passage, qa_pairs: answerable questions by the passages that they need."""
    q = spark.read.schema(s.IIRC).json(path, multiLine=True).select("pid", "text", F.explode("questions").alias("q")).where("q.answer.type NOT IN ('none', 'bad')")
    kind, value = F.col("q.answer.type"), F.col("q.answer.answer_value")
    date = F.struct(*[F.lit("").alias(c) for c in ("day", "month", "year")])
    number = F.struct(value.alias("number"), date.alias("date"), F.array().cast("array<string>").alias("spans"))
    answer = F.when(kind == "span", _spans(F.transform("q.answer.answer_spans", lambda a: a["text"]))).when(kind == "value", number).otherwise(_spans(F.array(value)))
    context = F.concat_ws(" ", F.transform("q.context", lambda c: c["text"]))
    passage = F.concat(F.col("text"), F.lit(" "), context, F.lit(" yes no" if append_yes_no else ""))
    names = F.array_distinct(F.concat(F.array("pid"), F.transform("q.context", lambda c: c["passage"])))
    flat = q.select(F.concat_ws("+", names).alias("passage_id"), passage.alias("passage"), F.struct(F.col("q.question").alias("question"), F.col("q.qid").alias("query_id"), answer.alias("answer")).alias("qa"))
    return flat.groupBy("passage_id").agg(F.max("passage").alias("passage"), F.array_sort(F.collect_list("qa"), lambda a, b: F.when(a["query_id"] < b["query_id"], -1).when(a["query_id"] > b["query_id"], 1).otherwise(0)).alias("qa_pairs"))


def boolq_as_drop(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One passage a question, `? yes no` after it; ids are the name and the number of the line."""
    lines = spark.read.text(path).coalesce(1).select(F.from_json("value", s.BOOLQ).alias("q"), F.monotonically_increasing_id().alias("i"))
    qid = F.concat_ws("_", F.lit(name), "i")
    answer = _spans(F.array(F.when(F.col("q.answer"), "yes").otherwise("no")))
    return lines.select(qid.alias("passage_id"), F.concat("q.passage", F.lit(" yes no")).alias("passage"), F.array(F.struct(F.concat("q.question", F.lit("? yes no")).alias("question"), qid.alias("query_id"), answer.alias("answer"))).alias("qa_pairs"))


def squad_as_drop(spark: SparkSession, path: str) -> DataFrame:
    """Answerable questions; validated answers are the other distinct ones."""
    rows = _squad(spark, path).where(~F.coalesce("q.is_impossible", F.lit(False)))
    texts = F.transform("q.answers", lambda a: a["text"])
    more = F.transform(F.coalesce("q.plausible_answers", F.array().cast(f"array<{s.SQUAD_ANSWER}>")), lambda a: a["text"])
    rest = F.array_except(F.array_union(texts, more), F.array(texts[0]))
    return rows.select(F.concat_ws("_", "title", "at").alias("passage_id"), F.col("context").alias("passage"), F.col("q.id").alias("query_id"), F.col("q.question").alias("question"), _spans(F.array(texts[0])).alias("answer"), F.transform(rest, lambda t: _spans(F.array(t))).alias("validated_answers"))


def numeric_answers(rows: DataFrame, id_col: str, answer_col: str, dataset: str, split: str = "dev") -> DataFrame:
    """question_id, number of the rows whose answer is a number."""
    number = number_of(F.col(answer_col))
    return rows.select(F.concat_ws("_", F.lit(dataset), F.lit(split), F.col(id_col)).alias("question_id"), number.alias("number")).where("number IS NOT NULL")


def numeric_answers_of(spark: SparkSession, path: str, dataset: str, split: str = "dev") -> DataFrame:
    """question_id, number of a file of one of four data sets: HOTPOT, DROP, CWQ, IIRC."""
    if dataset == "DROP":
        rows = drop_questions(spark, path).select(F.concat_ws("_", "passage_id", "query_id").alias("id"), F.col("answers")[0]["number"].alias("answer"))
    elif dataset == "IIRC":
        q = spark.read.schema(s.IIRC).json(path, multiLine=True).select("pid", F.explode("questions").alias("q"))
        answer = F.when(F.col("q.answer.type") == "value", F.col("q.answer.answer_value")).when(F.col("q.answer.type") == "span", F.col("q.answer.answer_spans")[0]["text"])
        rows = q.select(F.concat_ws("_", "pid", "q.qid").alias("id"), answer.alias("answer"))
    elif dataset == "CWQ":
        rows = spark.read.schema(s.CWQ).json(path, multiLine=True).select(F.col("ID").alias("id"), F.col("answers")[0]["answer"].alias("answer"))
    else:
        rows = spark.read.schema(s.HOTPOT).json(path, multiLine=True).select(F.col("_id").alias("id"), "answer")
    return numeric_answers(rows, "id", "answer", dataset, split)


def predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(s.PREDICTION).json(path)


def jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Model outputs: kind is QUESTIONS, STEP_ANSWERS or PARSED."""
    return spark.read.schema(getattr(s, kind)).json(path)


def ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("qid")).where("qid <> ''")


def by_question_id(flat: DataFrame, whole: bool = True) -> DataFrame:
    """Flat questions with question_id, by which they are joined: passage and query, or the query alone."""
    return flat.withColumn("question_id", F.concat_ws("_", "passage_id", "query_id") if whole else F.col("query_id"))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path, made and written first where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
