"""Rows of question files as typed instances, in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.spans import encoded, span_encoded, tokens_of

PAIR = "array<struct<start:int,end:int>>"
SCHEMA = f"query_id string, tokens array<string>, question_tokens array<string>, numbers array<double>, number_positions array<int>, passage_spans {PAIR}, question_spans {PAIR}, signs array<array<int>>, counts array<int>"


def instances(questions: DataFrame, passage_limit: int | None = None, question_limit: int | None = None) -> DataFrame:
    """questions(query_id, question, passage, answers) in the layout with spans, sign rows and counts; rows of whose answer
    nothing is found are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            out = []
            for i, q, p, a in zip(pdf["query_id"], pdf["question"], pdf["passage"], pdf["answers"], strict=True):
                row = encoded(q or "", p or "", [dict(x, spans=list(x["spans"]) if x["spans"] is not None else []) for x in (a if a is not None else [])], "drop", passage_limit, question_limit)
                if row:
                    pairs = {k: [{"start": s, "end": e} for s, e in row[k]] for k in ("passage_spans", "question_spans")}
                    out.append({"query_id": i} | row | pairs)
            yield pd.DataFrame(out, columns=names)

    return questions.select("query_id", "question", "passage", "answers").mapInPandas(run, SCHEMA)


_SPAN = "struct<start:int,end:int>"
SPAN_SCHEMA = f"query_id string, tokens array<string>, answer_span {_SPAN}, context_span {_SPAN}, yes_no_span {_SPAN}"


def span_instances(questions: DataFrame, limit: int = 512, training: bool = True, tokenizer=tokens_of) -> DataFrame:
    """questions(query_id, question, context, answers, is_impossible, is_boolq), as squad_questions gives them, as one sequence each."""
    names = [c.split()[0] for c in SPAN_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, q, c, a, impossible, boolq in zip(*(pdf[k] for k in ("query_id", "question", "context", "answers", "is_impossible", "is_boolq")), strict=True):
                first = a[0] if a is not None and len(a) else None
                row = span_encoded(q or "", c or "", first and first["text"], first and first["answer_start"], bool(impossible), bool(boolq), limit, tokenizer, training)
                if row:
                    out.append({"query_id": i, "tokens": row["tokens"]} | {k: dict(zip(("start", "end"), row[k], strict=True)) for k in names[2:]})
            yield pd.DataFrame(out, columns=names)

    return questions.select("query_id", "question", "context", "answers", "is_impossible", "is_boolq").mapInPandas(run, SPAN_SCHEMA)


def parser_pairs(rows: DataFrame, separator: str = "@@SEP@@", start: str = "@@START@@") -> DataFrame:
    """program_rows as pairs for a parser: the question, and the steps with the separator between them after a start token
    (null where there are no steps)."""
    return rows.select("question_id", "source", F.when(F.col("steps").isNotNull(), F.concat_ws(" ", F.lit(start), F.array_join("steps", f" {separator} "))).alias("target"))


def question_pairs(rows: DataFrame, separator: str = "@@SEP@@", start: str = "@@START@@") -> DataFrame:
    """reverse_rows as pairs for a question generator: the steps, and the question after a start token (null for perturbed
    programs, whose question isn't known)."""
    known = F.when(F.col("kind") == "program", F.concat_ws(" ", F.lit(start), "question"))
    return rows.select("question_id", F.array_join("steps", f" {separator} ").alias("source"), known.alias("target"), F.col("question").alias("original"))
