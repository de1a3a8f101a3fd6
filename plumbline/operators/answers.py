"""Answers of perturbed programs: by rule from the original answer, or by evaluating the steps' answers."""

from __future__ import annotations

import re
from datetime import datetime
from difflib import SequenceMatcher
from functools import lru_cache

from dateutil import parser as dates
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import first_number, once
from plumbline.plans.program import boundary_references, recognise

MOST_WORDS = 8
_NO_YEAR = datetime(1, 1, 1)


def number_pairs(rows: DataFrame, op: str) -> DataFrame:
    """qid, low, high of rows(qid, numbers, answer) where one pair of the numbers, and no other, gives the answer.
    100 counts as a number of each row. Whole answers below ten are left out: they may be counts."""
    numbers = rows.where(~((F.col("answer") % 1 == 0) & (F.col("answer") < 10))).select("qid", "answer", F.posexplode(F.concat("numbers", F.array(F.lit(100.0)))).alias("i", "v"))
    a, b = numbers.alias("a"), numbers.alias("b")
    gives = {"sum": F.col("a.v") + F.col("b.v"), "difference": F.abs(F.col("a.v") - F.col("b.v")), "multiplication": F.col("a.v") * F.col("b.v")}[op]
    pairs = a.join(b, F.expr("a.qid = b.qid AND a.i < b.i")).where(gives == F.col("a.answer"))
    pairs = pairs.select(F.col("a.qid").alias("qid"), F.least("a.v", "b.v").alias("low"), F.greatest("a.v", "b.v").alias("high")).distinct()
    return pairs.groupBy("qid").agg(F.count("*").alias("n"), F.first("low").alias("low"), F.first("high").alias("high")).where("n = 1").drop("n")


def of_pair(op: Column, low: Column, high: Column) -> Column:
    return F.when(op == "sum", low + high).when(op == "difference", F.abs(low - high)).when(op == "multiplication", low * high).when((op == "division") & (low > 0), high / low)


def boolean_answer(original: Column, old: Column, new: Column) -> Column:
    """both-and to either-or keeps the answer; other wordings turn a decided one."""
    turned = F.when(original == "yes", F.lit("no")).when(original == "no", F.lit("yes"))
    return (
        F.when(~original.isin("yes", "no"), F.lit(None).cast("string"))
        .when((old == "logical_and") & (new == "logical_or"), original)
        .when((old == "logical_and") & new.isin("true", "false") & (original == "yes"), turned)
        .when((old == "logical_or") & new.isin("true", "false") & (original == "no"), turned)
    )


def appended_answer(original: Column, how: Column, value: Column) -> Column:
    def told(x: Column) -> Column:
        holds = F.when(how == "lower", x["o"] < x["v"]).when(how == "higher", x["o"] > x["v"]).when(how == "equal", x["o"] == x["v"])
        return F.when(holds, F.lit("yes")).when(~holds, F.lit("no"))

    return once(F.struct(first_number(original).alias("o"), first_number(value).alias("v")), told)


def pruned_answer(transformed: Column, last: Column, first_answer: Column, original: Column, kind: Column) -> Column:
    """The first step's answer where it is the result; 100 less the original for a last step `difference of 100 and #1`."""
    counting = F.lower(F.element_at(transformed, -1)).isin("the number of #1", "number of #1", "numberof #1", "the amount of #1", "amount of #1")
    given = (F.coalesce(first_answer, F.lit("")) != "")
    return (
        F.when(counting & first_answer.try_cast("double").isNotNull(), first_answer)
        .when((kind == "prune_last_step") & F.lower(last).contains("difference of 100 and #1"), (100 - original.try_cast("double")).cast("string"))
        .when((F.size(transformed) == 1) & given, first_answer)
    )


def to_span(answer: Column, passage: Column) -> Column:
    return F.struct(answer.alias("text"), (F.position(answer, passage) - 1).cast("int").alias("answer_start"))


# ---------------------------------------------------------------- evaluation of step answers, row by row


@lru_cache(1 << 14)
def typed(text: str | None) -> tuple[object, str]:
    """(value, kind): a number, a date (with or without its year), the number that comes first, or none."""
    bare = re.sub(r"[,%£$]", "", text or "").strip()
    for pattern, kind, make in ((r"[-+]?\d+", "int", int), (r"[-+]?\d*\.\d+", "float", float)):
        if re.fullmatch(pattern, bare):
            return make(bare), kind
    try:
        return dates.parse(bare, default=_NO_YEAR), "date"
    except (ValueError, OverflowError):
        pass
    first = (bare.split() or [""])[0]
    if re.fullmatch(r"[-+]?\d+(\.\d+)?", first):
        return (float(first), "float") if "." in first else (int(first), "int")
    return text, "none"


def comparable(values: list[tuple[object, str]]) -> bool:
    kinds = {k for _, k in values}
    if kinds <= {"int", "float"}:
        return bool(values)
    return kinds == {"date"} and len({v.year == 1 for v, _ in values}) == 1


def evaluated(steps: list[str], answers: list[str | None]) -> list[object]:
    """Steps' answers, those that are missing computed from the ones before: unions, arithmetic, comparisons, comparisons
    of truth, and counts whose step already has a number. None where a step can't be told."""
    out: list[object] = []
    for text, given in zip(steps, answers, strict=True):
        step = recognise(text)
        refs = [out[r] if r < len(out) else None for r in boundary_references(text)]
        if given not in (None, ""):
            out.append(given)
        elif step.op is None or not refs or None in refs:
            out.append(None)
        else:
            out.append(_step(step, [out[r - 1] for r in step.refs]))
    return out


def _step(step, values: list) -> object:
    kinds = [typed(str(v)) for v in values]
    numbers = [v for v, k in kinds if k in ("int", "float")]
    if step.op == "union":
        return [str(v) for v in values]
    if step.op == "aggregate" and step.args[0] == "count":
        return numbers[0] if numbers else None
    if step.op == "arithmetic" and len(numbers) == len(values):
        first, *rest = numbers
        if step.args[0] == "division":
            return first / rest[0] if rest[0] else None
        product = first
        for x in rest:
            product *= x
        return {"sum": sum(numbers), "difference": abs(first - sum(rest)), "multiplication": product}[step.args[0]]
    if step.op == "comparison" and comparable(kinds) and step.args[0] in ("min", "max") and len({v for v, _ in kinds}) > 1:
        best = (min if step.args[0] == "min" else max)(v for v, _ in kinds)
        return step.args[1:][[v for v, _ in kinds].index(best)]
    if step.op == "boolean" and numbers and (m := re.search(r"(higher|lower) than|the same as", step.args[-1])):
        right = numbers[1] if len(numbers) > 1 else typed(step.args[-1].split(m[0])[1].strip())[0]
        if isinstance(right, int | float):
            return "yes" if {"higher": numbers[0] > right, "lower": numbers[0] < right, None: numbers[0] == right}[m[1]] else "no"
    return None


def other_option(options: list[str], answer: str, least: float = 0.5) -> str | None:
    """Of two options the one that an answer is less like, if it is like the other."""
    like = [SequenceMatcher(None, o.lower(), answer.lower()).ratio() for o in options]
    return options[like.index(min(like))] if len(options) == 2 and max(like) >= least and like[0] != like[1] else None


def options_of(question: str) -> list[str]:
    """`Which ..., A or B?`: the two options."""
    m = re.search(r"(?:,|:)\s*(?:the )?([^,:?]+?),? or (?:the )?([^,?]+)\??$", question) or re.search(r"\b(?:between|of) ([^,?]+?) (?:and|or) ([^,?]+)\??$", question)
    return [m[1].strip(), m[2].strip()] if m else []
