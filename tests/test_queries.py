"""Every query with SQL against DuckDB on sf0.001, and operators that SQL can't express."""

import glob
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.functions import text as tx
from plumbline.operators import answers, evaluate, perturb, predict, sampling
from plumbline.operators.catalogue import _programs
from plumbline.plans.compiler import answer
from plumbline.plans.grounding import Ungrounded
from plumbline.sources import readers, writers

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    q = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in q.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == want


def test_unknown_phrases(spark):
    with pytest.raises(Ungrounded, match="customers"):
        answer(spark, SF, "return dragons")
    with pytest.raises(Ungrounded):
        answer(spark, SF, "return customers ;return wings of #1")


def test_filters(spark):
    made, programs = perturb.perturbed(_programs(spark)), _programs(spark)
    assert made.count() > perturb.filtered(made, programs).count() > 0
    assert perturb.capped(made, "append_boolean_step", 1).where("type = 'append_boolean_step'").groupBy("orig_id").count().agg(F.max("count")).first()[0] == 1
    assert perturb.for_dataset(made, "drop").where("type = 'op_replace_aggregate' OR type = 'prune_step'").count() == 0


def test_numbers(spark):
    cases = {"1,000": 1000.0, "45%": 45.0, "three hundred": 300.0, "two thousand five": 2005.0, "": None, "and": None, "cat": None, "-2.5": -2.5, "one hundred and two": 102.0}
    df = spark.createDataFrame(list(cases.items()), "t string, want double")
    assert [r.got for r in df.select(tx.number_of(F.col("t")).alias("got")).collect()] == list(cases.values())
    one = spark.createDataFrame([("It cost 3 million", " a b ​", "&amp; x.:12-3", "Élan")], "a string, b string, c string, d string")
    got = one.select(tx.first_number(F.col("a")), tx.standardized(F.col("b")), tx.standardized_well(F.col("c")), tx.without_accents(F.col("d"))).first()
    assert tuple(got) == (3e6, "a b", "& x.", "Elan")
    assert tx.valid_spans("the big - cat sat".split(), ["big", "cat"], frozenset("-")) == [(1, 3)]


def test_answers(spark):
    df = spark.createDataFrame([("yes", "logical_and", "logical_or", "yes"), ("yes", "logical_and", "false", "no"), ("no", "logical_and", "true", None), ("no", "logical_or", "false", "yes"), ("maybe", "logical_or", "true", None)], "o string, a string, b string, want string")
    assert df.where(~answers.boolean_answer(F.col("o"), F.col("a"), F.col("b")).eqNullSafe(F.col("want"))).count() == 0
    assert answers.evaluated(["a", "b", "the difference of #1 and #2", "which is highest of #1 , #2", "#1 , #2", "if #1 is higher than #2"], ["3", "1,000", None, None, None, None])[2:] == [997, "#2", ["3", "1,000"], "no"]
    assert answers.typed("July 4, 2001")[1] == "date" and answers.typed("45 %") == (45, "int")
    assert answers.other_option(["Ann Lee", "Bob"], "ann lee") == "Bob" and answers.options_of("Who is older, Ann or Bob?") == ["Ann", "Bob"]
    kinds = [("op_replace_aggregate", f"2-{a}-{b}", c) for (a, b), c in ((k.split("-"), v) for k, v in evaluate.CONSTRAINTS.items() if "diff" not in k)] + [("op_replace_arithmetic", "2-difference-sum", ">="), ("change_last_step", "3-comparison-boolean-higher_than", "boolean"), ("prune_step", "2", None)]
    df = spark.createDataFrame(kinds, "k string, i string, want string")
    assert df.where(~evaluate.constraint_of(F.col("k"), F.col("i")).eqNullSafe(F.col("want"))).count() == 0


def test_consistency(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "base_id string, indicator int")
    assert evaluate.consistency(df).first().consistency == 0.5


def test_sampling(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 3)
    assert [r["count"] for r in sampling.stratified(df, "s", "id", 5).groupBy("s").count().collect()] == [5, 5, 5]
    with pytest.raises(Exception, match="too few"):
        sampling.stratified(df, "s", "id", 50, strict=True).collect()
    nested = spark.createDataFrame([(1, [("a", 1), ("b", 2)]), (2, [("c", 3)])], "p int, qs array<struct<q:string, n:int>>")
    got = sampling.subset_nested(nested, "qs", "q", spark.createDataFrame([("b",)], "q string")).collect()
    assert [(r.p, [x.q for x in r.qs]) for r in got] == [(1, ["b"])]


def test_files(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"p1": {"passage": "Ann won 3.", "wiki_url": "", "qa_pairs": [{"question": "How many?", "query_id": "q1", "answer": {"number": "3", "date": {}, "spans": []}}]}}')
    got = readers.drop_questions(spark, str(tmp_path / "d.json")).first()
    assert (got.passage_id, got.query_id, got.answers[0].number) == ("p1", "q1", "3")
    (tmp_path / "s.json").write_text('{"version": "1", "data": [{"title": "T", "paragraphs": [{"context": " Ann ran.", "qas": [{"id": "x", "question": "Who?", "is_impossible": false, "answers": [{"text": "Ann", "answer_start": 1}]}, {"id": "NEGATIVE1", "question": "?", "answers": []}]}]}]}')
    assert [r.passage_id for r in readers.hotpot_questions(spark, str(tmp_path / "s.json")).collect()] == ["T_0"]
    assert readers.squad_questions(spark, str(tmp_path / "s.json")).where("query_id = 'x'").first().answers[0].answer_start == 0
    (tmp_path / "b.jsonl").write_text('{"question": "is it", "answer": true, "passage": "p", "title": "t"}\n')
    assert readers.boolq_as_drop(spark, str(tmp_path / "b.jsonl"), "dev").first().qa_pairs[0].answer.spans == ["yes"]
    made = perturb.perturbed(_programs(spark))
    writers.perturbed_csv(made, str(tmp_path / "out"))
    assert readers.perturbations(spark, str(tmp_path / "out")).count() == made.count()


def test_predictor(spark):
    rows = spark.createDataFrame([("a", ["Ann", "number of #1"], "Ann ran far"), ("b", ["x of #2", "y of #1"], "p")], "qid string, steps array<string>, passage string")
    got = {r.qid: r for r in predict.with_step_answers(rows, "stub").collect()}
    assert got["a"].step_answers == ["Ann", "3"] and got["b"].error == "cyclic or too long"
