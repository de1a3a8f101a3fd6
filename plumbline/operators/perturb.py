"""Perturbations: rules that make new programs from one, question rewrites, and filters on what comes out.

A rule takes an Example and yields (kind, info, program, question). All rules run in one pass over the rows
(`perturbed`, mapInPandas): programs are short, so the work is in Python's string handling and not in Spark's operators;
what follows (operator statistics, filters, dedup) are DataFrame operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.plans.program import COMPARATORS, Program, Step, changed, comparator, encoding, is_valid, made, parse, references, without_step

ID_SEP, INFO_SEP = "+", "-"
NARROW = ("filter", "superlative", "comparative")
KEPT_BY_PRUNE = ("filter", "project", "aggregate", "superlative", "comparative", "sort")
ARITHMETIC = ("sum", "difference", "multiplication", "division")
# Opposite words of comparison questions, in the order in which they are tried.
OPPOSITE = {
    "young": "old", "first": "second", "short": "long", "lower": "bigger", "smaller": "larger", "small": "big", "low": "high", "less": "more",
    "old": "young", "second": "first", "long": "short", "bigger": "lower", "larger": "smaller", "big": "small", "high": "low", "more": "less",
    "fewer": "more", "large": "small",
}
# Words that make a difference one of time.
TIME_WORDS = ("when", "date", "year", "years", "month", "months", "day", "days", "hour", "hours")
#: Thresholds of appended conditions besides those around a known answer.
THRESHOLDS = ("two", "17")


@dataclass(frozen=True)
class Example:
    id: str
    question: str
    program: Program
    number: float | None = None


Made = tuple[str, str, Program, str | None]


def _info(*parts) -> str:
    return INFO_SEP.join(map(str, parts))


# ---------------------------------------------------------------- question rewrites


_OPPOSED = re.compile(rf"(?<!\S)({'|'.join(OPPOSITE)})", re.I)


def flipped_question(question: str) -> str | None:
    """The first word that begins like one of the table, turned wherever the question has it in lower case."""
    found = _OPPOSED.search(question)
    return found and question.replace(found[1].lower(), OPPOSITE[found[1].lower()])


#: Shapes of questions for a number, and what asks instead whether that many are; the first that fits counts.
_COUNTING = tuple(
    (re.compile(shape, re.I | re.S), says)
    for shape, says in (
        (r"\s*how many\s+(?P<what>(?:(?!\b(?:do|does|did)\b).)*?)\s*\b(?:do|does|did)\b\s*(?P<who>(?:(?!\b(?:do|does|did)\b).)*?)\?*", "If {who} {condition} {what}?"),
        (r"(?P<lead>.*?\S)\s*how many\s+(?P<what>(?:(?!\b(?:do|does|did)\b).)*?)\s*\b(?:do|does|did)\b\s*(?P<who>(?:(?!\b(?:do|does|did)\b).)*?)\?*", "If {lead} {what} {who} {condition}?"),
        (r"(?P<lead>.*)how many(?P<what>.*?) were there(?P<rest>.*)", "If there were {lead}{condition}{what}{rest}"),
        (r"(?P<lead>.*)how many(?P<rest>.*)", "If {lead}{condition}{rest}"),
    )
)


def conditional_question(question: str, condition: str) -> str | None:
    """A question for a number, asked once, as a question whether that many are."""
    if len(re.findall("how many", question, re.I)) != 1:
        return None
    found, says = next((m, says) for shape, says in _COUNTING if (m := shape.fullmatch(question)))
    out = says.format(condition=condition, **found.groupdict())
    return " ".join(out.split()) if "{who}" in says else out


def neither_question(question: str) -> str | None:
    """A question about two things as one about neither; one about an ability asks what is done."""
    joint = re.compile(r"(?<= )and(?= )|And(?= )")
    if not joint.search(question):
        return None
    verb, _, rest = joint.sub(lambda m: {"a": "n", "A": "N"}[m[0][0]] + "or", question).strip().partition(" ")
    return " ".join(["Do" if verb.lower() == "can" else verb, "neither", *re.sub(r"(?<= )both ", "", f" {rest}").split()])


# ---------------------------------------------------------------- rules


def _last(e: Example) -> tuple[int, Step]:
    return len(e.program.steps) - 1, e.program.steps[-1]


def _swap(e: Example, kind: str, at: int, new: str, question: str | None = None, *, label: str | None = None, says: str | None = None) -> Made:
    i, step = _last(e)
    args = (*step.args[:at], new, *step.args[at + 1 :])
    return f"op_replace_{kind}", _info(i, says or step.args[at], label or new), changed(e.program, i, made(step.op, *args)), question


def replace_operator(e: Example) -> Iterator[Made]:
    """Other operators for the last step."""
    i, step = _last(e)
    a = step.args
    if step.op == "aggregate" and a[0] in ("min", "max", "sum", "avg"):
        yield from (_swap(e, "aggregate", 0, op) for op in ("min", "max", "count") if op != a[0])
    elif step.op == "arithmetic":
        for op in ARITHMETIC:
            if op != a[0]:
                one = _swap(e, "arithmetic", 0, op)
                yield one
                if op == "difference" and len(e.program.steps) in (3, 5) and e.program.ops[:2] == ["select", "select"]:
                    x, y, *rest = one[2].steps
                    yield one[0], one[1] + "_VARIANT", Program((y, x, *rest)), None
    elif step.op == "comparison":
        other = {"min": "max", "max": "min", "true": "false", "false": "true"}.get(a[0])
        if other:
            yield _swap(e, "comparison", 0, other, flipped_question(e.question))
    elif step.op == "comparative":
        op, value = comparator(a[2])
        if value is not None:
            number = bool(re.fullmatch(r"-?\d+(\.\d+)?", value))
            group = ("=", "!=", ">", ">=", "<", "<=") if op in (">", ">=", "<", "<=") or number and op in ("=", "!=") else next((x for x in (("=", "!="), ("start", "end")) if op in x), ())
            yield from (_swap(e, "comparative", 2, f"{COMPARATORS[o][0]} {value}", label=o, says=op) for o in group if o != op)
    elif step.op == "superlative":
        yield from (_swap(e, "superlative", 0, op) for op in ("min", "max") if op != a[0])
    elif step.op == "boolean" and a[0] in ("logical_and", "logical_or"):
        yield _swap(e, "boolean", 0, "logical_or" if a[0] == "logical_and" else "logical_and")
        new = "true" if a[1] == "false" else "false"
        yield _swap(e, "boolean", 1, new, neither_question(e.question) if new == "false" else None, says=a[0])


def prune_last(e: Example) -> Iterator[Made]:
    i, step = _last(e)
    if i and step.op in KEPT_BY_PRUNE:
        yield "prune_last_step", step.op, Program(e.program.steps[:-1]), None
    elif i:
        yield "prune_last_step_rm_unused", step.op, without_step(e.program, i + 1), None


def prune_step(e: Example) -> Iterator[Made]:
    for number, step in enumerate(e.program.steps, 1):
        if step.op in NARROW:
            yield "prune_step", str(number), without_step(e.program, number), None


def change_last(e: Example) -> Iterator[Made]:
    """A last arithmetic or min/max comparison of two steps becomes another kind of step."""
    i, step = _last(e)
    if step.op not in ("arithmetic", "comparison") or step.op == "comparison" and step.args[0] not in ("min", "max"):
        return
    refs = [a.strip() for a in step.args if re.fullmatch(r"#\d*", a.strip())]
    if len(refs) != 2:
        return
    new = [("union", made("union", *refs))]
    new += [(c.replace(" ", "_"), made("boolean", refs[0], f"is {c} {refs[1]}")) for c in ("higher than", "lower than", "the same as")]
    new += [(op, made("comparison", op, *refs)) for op in ("max", "min")] if step.op == "arithmetic" else [(op, made("arithmetic", op, *refs)) for op in ARITHMETIC]
    for label, s in new:
        yield "change_last_step", _info(i + 1, step.op, s.op, label), changed(e.program, i, s), None


#: What is compared with besides THRESHOLDS: a known answer and its neighbours, its multiples and its parts.
NEAR = (lambda x: x + 1, lambda x: x + 2, lambda x: x, lambda x: 0, lambda x: 2 * x, lambda x: x / 2, lambda x: abs(x - 1), lambda x: abs(x - 2))


def thresholds(number: float | None) -> list[str]:
    """Values to compare with, each once."""
    near = [] if number is None or number < 0 else [str(int(value(number))) for value in NEAR]
    return list(dict.fromkeys([*THRESHOLDS, *near]))


def append_boolean(e: Example) -> Iterator[Made]:
    i, step = _last(e)
    if step.op != "aggregate":
        return
    for value in thresholds(e.number):
        for phrase, says in (("lower than", f"less than {value}"), ("higher than", f"more than {value}"), ("equal to", value)):
            s = made("boolean", f"#{i + 1}", f"is {phrase} {value}")
            yield "append_boolean_step", _info(i + 2, step.op, phrase.split()[0], value), Program((*e.program.steps, s)), conditional_question(e.question, says)


RULES = (replace_operator, prune_last, prune_step, change_last, append_boolean)


def perturbations(e: Example) -> list[Made]:
    return [x for rule in RULES for x in rule(e)]


# ---------------------------------------------------------------- filters on one program


def no_time_sum(kind: str, info: str, program: Program) -> bool:
    return not ("difference-sum" in info and any(w in program.text() for w in TIME_WORDS))


def no_self_difference(kind: str, info: str, program: Program) -> bool:
    """Decided by the first difference: its two steps must differ, and so must their texts."""
    for s in program.steps:
        if s.op == "arithmetic" and s.args[0] == "difference" and len(s.args) > 2:
            a, b = (int(x[1:]) - 1 for x in s.args[1:3])
            return a != b and program.steps[a].text != program.steps[b].text
    return True


def no_single_noun(kind: str, info: str, program: Program) -> bool:
    return len(program.steps) != 1 or len(program.steps[0].text.split()) >= 3


CHECKS = {"time_diff_sum": no_time_sum, "self_diff": no_self_difference, "single_noun_phrase": no_single_noun}

SCHEMA = "id string, orig_id string, question string, orig_decomposition string, decomposition string, transformation string, type string, info string, transformed_question string, operators array<string>, checks map<string,boolean>"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for i, question, text, number in zip(pdf["question_id"], pdf["question_text"], pdf["decomposition"], pdf["number"], strict=True):
            program = parse(text or "", strict=False)
            if not is_valid(program):
                continue
            for kind, info, new, asked in perturbations(Example(i, question or "", program, None if pd.isna(number) else float(number))):
                out.append((f"{i}{ID_SEP}{kind}{ID_SEP}{info}", i, question, text, new.text(), f"{kind}{ID_SEP}{info}", kind, info, asked, [s.op for s in new.steps], {n: f(kind, info, new) for n, f in CHECKS.items()}))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def perturbed(programs: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """All perturbations of programs(question_id, question_text, decomposition); numbers(question_id, number): known answers."""
    rows = programs.select("question_id", "question_text", "decomposition")
    rows = rows.join(numbers.select("question_id", F.col("number").cast("double").alias("number")), "question_id", "left") if numbers is not None else rows.withColumn("number", F.lit(None).cast("double"))
    return rows.mapInPandas(_run, SCHEMA).dropDuplicates(["id"])


def operators_of(programs: DataFrame) -> DataFrame:
    """question_id, operators, encodings and valid of programs(question_id, decomposition)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse(t or "") for t in pdf["decomposition"]]
            yield pd.DataFrame({"question_id": pdf["question_id"], "operators": [[o or "none" for o in p.ops] for p in parsed], "encodings": [[encoding(s) for s in p.steps] for p in parsed], "valid": [is_valid(p) for p in parsed]})

    return programs.select("question_id", "decomposition").mapInPandas(run, "question_id string, operators array<string>, encodings array<string>, valid boolean")


def operator_shares(programs: DataFrame) -> DataFrame:
    """For each operator in how many programs it is, and what share of all."""
    ops = operators_of(programs)
    n = ops.agg(F.count("*")).scalar()
    return ops.select(F.explode(F.array_distinct("operators")).alias("operator")).groupBy("operator").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / n)


def filtered(made_: DataFrame, programs: DataFrame, percent: float = 0.15, checks: tuple[str, ...] = tuple(CHECKS), exempt: tuple[str, ...] = ()) -> DataFrame:
    """Perturbations that pass the checks and whose operators all occur in at least `percent` percent of the programs."""
    good = F.collect_set("operator")
    known = operator_shares(programs).where(F.col("share") * 100 >= percent).agg(good).scalar()  # at most fourteen
    common = F.size(F.array_except("operators", known)) == 0
    for prefix in exempt:
        common = common | F.col("type").startswith(prefix)
    return made_.where(common).where(F.forall(F.array(*[F.lit(c) for c in checks]), lambda c: F.coalesce(F.col("checks")[c], F.lit(True))))


def for_dataset(made_: DataFrame, dataset: str) -> DataFrame:
    """Without the kinds that make bad examples for a data set."""
    parts, bad = F.split("info", INFO_SEP), F.lit(False)
    if dataset in ("drop", "iirc", "hotpotqa"):
        bad = (F.col("type") == "op_replace_aggregate") | (F.col("type") == "prune_last_step") & (F.element_at(parts, -1) != "project")
    if dataset in ("drop", "iirc"):
        bad = bad | (F.col("type") == "prune_step")
    change, new, label = F.col("type") == "change_last_step", F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    if dataset == "drop":
        bad = bad | change & (new != "arithmetic")
    if dataset in ("iirc", "hotpotqa"):
        bad = bad | change & ((new != "boolean") | (label != "the_same_as"))
    return made_.where(~F.coalesce(bad, F.lit(False)))


def capped(made_: DataFrame, kind: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` perturbations of a kind for each example, chosen by a seeded digest."""
    rank = F.row_number().over(W.partitionBy("orig_id", "type").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "id")), "id"))
    return made_.withColumn("_rank", rank).where((F.col("type") != kind) | (F.col("_rank") <= most)).drop("_rank")


def parts_of_id(df: DataFrame, column: str = "id") -> DataFrame:
    """base_id, transform_base, transform_info of a perturbed id."""
    parts = F.split(column, r"\+", 3)
    return df.withColumns({"base_id": parts[0], "transform_base": F.coalesce(F.get(parts, F.lit(1)), F.lit("")), "transform_info": F.coalesce(F.get(parts, F.lit(2)), F.lit(""))})


__all__ = ["Example", "capped", "filtered", "for_dataset", "operator_shares", "operators_of", "parts_of_id", "perturbations", "perturbed", "references"]
