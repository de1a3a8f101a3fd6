"""Assembly of examples: answers by rule and by evaluation, formats, joins, known shapes, files."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import assemble, perturb
from plumbline.sources import readers, writers

#: transform, original answer, transformed steps, step answers, numbers -> answer, what found it
CASES = [
    ("op_replace_boolean+2-logical_and-false", "yes", ["if both #1 and #2 are false"], [None], None, "no", "op_replace_boolean"),
    ("op_replace_boolean+2-logical_and-true", "no", ["if #1 is red"], [None], None, None, None),
    ("append_boolean_step+3-aggregate-higher-two", "5 dogs", ["dogs", "number of #1", "if #2 is higher than two"], [None] * 3, None, "yes", "append_boolean_step"),
    ("prune_last_step+project", "3", ["old dogs", "number of #1"], ["7", None], None, "7", "prune_last_step"),
    ("prune_last_step+aggregate-x100", "38.5", ["the share"], ["a"], None, "61.5", "prune_last_step"),
    ("prune_step+2", "x", ["the old dogs"], ["Rex"], None, "Rex", "prune_step"),
    ("prune_step+2", "x", ["the old dogs"], ["one two three four five six seven eight nine"], None, None, None),
    ("change_last_step+3-comparison-union-union", "x", ["a", "b", "#1 , #2"], ["Ann", "Rex", None], None, "Ann|Rex", "evaluation"),
    ("change_last_step+3-comparison-boolean-lower_than", "x", ["a", "b", "if #1 is lower than #2"], ["3", "4", None], None, "yes", "evaluation"),
    ("op_replace_arithmetic+3-sum-difference", "25", ["a", "b", "the difference of #1 and #2"], [None] * 3, [10.0, 15.0, 40.0], "5", "op_replace_arithmetic"),
    ("op_replace_arithmetic+3-sum-difference", "25", ["a", "b", "the difference of #1 and #2"], [None] * 3, [10.0, 15.0, 20.0, 5.0], None, None),
    ("op_replace_comparison+3-min-max", "Rex", ["a", "b", "which is highest of #1 , #2"], [None] * 3, None, "Ann", "op_replace_comparison"),
    ("op_replace_aggregate+1-min-max", "3", ["a", "highest of #1"], [None, None], None, None, None),
]


def parts(spark):
    made, questions, steps, originals = [], [], [], []
    for k, (how, original, transformed, given, numbers, _, _) in enumerate(CASES):
        last = "the difference of 100 and #1" if how.endswith("x100") else "number of #1"
        made.append((f"o{k}+{how}", f"o{k}", "Who is older, Ann or Rex?", f"return a ;return {last}", transformed, how))
        questions.append((made[-1][0], [["Ann and the dogs?", "other"]]))
        steps.append((made[-1][0], given))
        originals.append((f"o{k}", f"T_{k}", "Ann has Rex, a dog of 7.", [original], numbers))
    return (
        spark.createDataFrame(made, "id string, orig_id string, question string, decomposition string, transformed array<string>, transformation string"),
        spark.createDataFrame(questions, "qid string, questions array<array<string>>"),
        spark.createDataFrame(steps, "qid string, step_answers array<string>"),
        spark.createDataFrame(originals, "query_id string, passage_id string, passage string, answer_texts array<string>, numbers array<double>"),
    )


def test_answers(spark):
    made, questions, steps, originals = parts(spark)
    got = {r.passage_id: r for r in assemble.answered(assemble.joined(made, questions, steps, originals)).withColumn("said", F.coalesce(assemble.said(F.col("answer_number")), F.array_join("answer_spans", "|"))).collect()}
    assert len(got) == len(CASES)
    for k, case in enumerate(CASES):
        assert (got[f"T_{k}"].said, got[f"T_{k}"].answered_by) == case[5:], case
    with pytest.raises(Exception, match="no original example"):
        assemble.joined(made, questions, steps, originals.limit(3)).collect()
    assert assemble.skipped(made, questions.where("qid NOT LIKE 'o3+%'"), steps).select("orig_id").collect() == [("o3",)]


def test_formats_and_files(spark, tmp_path):
    info = assemble.example_info(assemble.joined(*parts(spark)), "hotpot-squad")
    by = {r.passage_id: r for r in info.collect()}
    assert by["T_3"].bad_form is False and by["T_4"].bad_form and by["T_4"].answered_by is None and by["T_9"].constraint == "<="
    counts = {r.transform_base: r for r in assemble.counters(info).collect()}
    assert sum(r.n for r in counts.values()) == len(CASES) and counts["prune_step"].answers == 1 and counts["op_replace_aggregate"].constraints == 1
    page = assemble.as_squad(info.where("answered_by IS NOT NULL")).first()
    assert page.title == "T" and all(p.context[q.answers[0].answer_start :].startswith(q.answers[0].text) for p in page.paragraphs for q in p.qas if q.answers[0].answer_start >= 0)
    drop = assemble.example_info(assemble.joined(*parts(spark)), "drop", allow_yes_no=False)
    assert {r.passage_id for r in assemble.as_drop(drop).collect()} == {"T_3", "T_4", "T_5", "T_7", "T_9", "T_11"}
    writers.example_files(drop, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x_constraints")).count() == 4
    assert {r.answered_by: r.n for r in assemble.answered_by_counts(info).collect()}["prune_step"] == 1


def test_known_shapes(spark):
    programs = spark.createDataFrame([("p", "", "return dogs ;return number of #1")], "question_id string, question_text string, decomposition string")
    made = spark.createDataFrame([("a", "return cats ;return number of #1", "prune_step+1"), ("b", "return cats ;return color of #1", "prune_step+2"), ("c", "return x ;return y of #1 ;return z of #2", "append_boolean_step+1")], "id string, decomposition string, transformation string")
    assert sorted(r.id for r in assemble.of_known_shape(made, programs).collect()) == ["a", "c"]
    assert perturb.operators_of(programs).first().valid


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text('question_id,question_text,decomposition,operators,split\nDROP_dev_p1_q1,How many?,"return  dogs ;return number of #1",,dev\nHOTPOT_dev_h_1,Who?,return x,,dev\nodd,?,return y,,dev\n')
    (tmp_path / "two.csv").write_text("question_id,source\na,What?\n")
    (tmp_path / "t.csv").write_text("id,question,decomposition,transformation,type\na+prune_step+1,Q?,return dogs,prune_step+1,prune_step\n")
    rows = {r.question_id: r for r in readers.program_rows(spark, str(tmp_path / "p.csv"), "ask: ").collect()}
    assert rows["DROP_dev_p1_q1"].steps == ["dogs", "number of @@1@@"] and rows["DROP_dev_p1_q1"].source == "ask: How many?"
    assert readers.program_rows(spark, str(tmp_path / "two.csv")).first().asDict() == {"question_id": "a", "source": "What?", "steps": None}
    assert [readers.reverse_rows(spark, str(tmp_path / f)).first().kind for f in ("p.csv", "t.csv")] == ["program", "perturbed"]
    assert [r.qid for r in readers.program_ids(spark, str(tmp_path / "p.csv"), "drop").collect()] == ["p1_q1"]
    assert [r.qid for r in readers.program_ids(spark, str(tmp_path / "p.csv"), "hotpot-squad").collect()] == ["h_1"]
    (tmp_path / "h.json").write_text('[{"_id": "1", "answer": "two hundred"}, {"_id": "2", "answer": "cat"}]')
    (tmp_path / "c.json").write_text('[{"ID": "3", "answers": [{"answer": "1,000"}]}, {"ID": "4", "answers": [{"answer": null}]}]')
    (tmp_path / "i.json").write_text('[{"pid": "p", "text": "", "questions": [{"qid": "q", "question": "", "context": [], "answer": {"type": "value", "answer_value": "7"}}, {"qid": "r", "question": "", "context": [], "answer": {"type": "span", "answer_spans": [{"text": "nine"}]}}]}]')
    (tmp_path / "d.json").write_text('{"p1": {"passage": "", "wiki_url": "", "qa_pairs": [{"question": "", "query_id": "q1", "answer": {"number": "3", "date": {}, "spans": []}}, {"question": "", "query_id": "q2", "answer": {"number": "", "date": {}, "spans": ["x"]}}]}}')
    found = [readers.numeric_answers_of(spark, str(tmp_path / f), d) for f, d in (("h.json", "HOTPOT"), ("d.json", "DROP"), ("c.json", "CWQ"), ("i.json", "IIRC"))]
    assert [[tuple(r) for r in sorted(x.collect())] for x in found] == [[("HOTPOT_dev_1", 200.0)], [("DROP_dev_p1_q1", 3.0)], [("CWQ_dev_3", 1000.0)], [("IIRC_dev_p_q", 7.0), ("IIRC_dev_p_r", 9.0)]]
    writers.numeric_json([*found, found[0].withColumn("number", F.lit(1.0))], str(tmp_path / "n"))
    assert {r.question_id: r.number for r in spark.read.json(str(tmp_path / "n")).collect()}["HOTPOT_dev_1"] == 1.0


def test_offsets_after_standardising(spark, tmp_path):
    context = "\\t\u00a0A &amp; B  won it."
    (tmp_path / "s.json").write_text('{"version": "1", "data": [{"title": "T", "paragraphs": [{"context": "%s", "qas": [{"id": "x", "question": " Who? ", "answers": [{"text": "won", "answer_start": 13}]}]}]}]}' % context)
    got = readers.squad_questions(spark, str(tmp_path / "s.json")).first()
    assert got.question == "Who?" and got.context[got.answers[0].answer_start :].startswith(got.answers[0].text) and got.answers[0].answer_start == 11


def test_keys_and_cache(spark, tmp_path):
    flat = spark.createDataFrame([("p", "q")], "passage_id string, query_id string")
    assert [readers.by_question_id(flat, w).first().question_id for w in (True, False)] == ["p_q", "q"]
    made = []
    make = lambda: made.append(1) or flat
    assert [readers.cached(spark, str(tmp_path / "c"), make).count() for _ in range(2)] == [1, 1] and made == [1]


def test_sari_of_targets(spark):
    from plumbline.functions import metrics

    row = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"], [["a", "b", "d"]]), (["a"], ["b"], [["a"], ["b"], []]), (["a"], ["a"], [])], "s array<string>, p array<string>, t array<array<string>>")
    got = row.select(*[v.alias(k) for k, v in metrics.sari_of_targets(F.col("s"), F.col("p"), F.col("t")).items()]).collect()
    assert got[0].sari == 1.0 and abs(got[1].delete - (0.5 + 3) / 4) < 1e-12 and abs(got[1]["add"] - 1.0) < 1e-12 and got[2].delete == 1.0
    one = row.limit(1).select(metrics.sari(F.col("s"), F.col("p"), F.get("t", F.lit(0))).alias("x")).first().x
    assert abs(one - got[0].sari) < 1e-12


def test_sequences(spark):
    from plumbline.functions.spans import span_encoded
    from plumbline.operators import encode
    from plumbline.sources import schemas

    row = span_encoded("Who ran", "Then Ann Lee ran, and Ann Lee won.", "Ann Lee", 22)
    assert row["tokens"][:4] == ["[CLS]", "yes", "no", "@@YES_NO_SEP@@"] and row["yes_no_span"] == (1, 2)
    a, b = row["answer_span"]
    assert row["tokens"][a : b + 1] == ["Ann", "Lee"] and row["tokens"][b + 1] == "won" and row["tokens"][row["context_span"][0]] == "Then"
    assert span_encoded("Who", "Nobody", "Ann", 0) is None and span_encoded("Who", "Nobody", "Ann", 0, training=False)["answer_span"] == (-1, -1)
    assert span_encoded("Who", "Nobody", None, None, impossible=True)["answer_span"] == (0, 0)
    assert span_encoded("is it", "x", "no", None, boolq=True)["answer_span"] == (2, 2)
    short = span_encoded("Who " * 3, "a " * 50 + "Ann", "Ann", 100, limit=20, training=False)
    assert len(short["tokens"]) == 20 and short["answer_span"] == (-1, -1) and span_encoded("Who", "a " * 50 + "Ann", "Ann", 100, limit=20) is None
    rows = spark.createDataFrame([("a", "Who", "Then Ann", [("Ann", 5)], False, False), ("b", "Who", "x", [], True, False), ("c", "Who", "x", [], False, False), (None, None, None, None, None, None)], f"query_id string, question string, context string, answers array<{schemas.SQUAD_ANSWER}>, is_impossible boolean, is_boolq boolean")
    got = {r.query_id: r for r in encode.span_instances(rows).collect()}
    assert got.keys() == {"a", "b"} and got["a"].tokens[got["a"].answer_span.start] == "Ann" and got["b"].answer_span.start == 0


def test_pairs(spark):
    from plumbline.operators import encode

    rows = spark.createDataFrame([("p", "ask: Q", ["dogs", "number of @@1@@"]), ("q", "ask: R", None)], "question_id string, source string, steps array<string>")
    assert {r.question_id: r.target for r in encode.parser_pairs(rows).collect()} == {"p": "@@START@@ dogs @@SEP@@ number of @@1@@", "q": None}
    rows = spark.createDataFrame([("p", ["dogs"], "Q?", "program"), ("q", ["cats"], "R?", "perturbed")], "question_id string, steps array<string>, question string, kind string")
    assert {r.question_id: (r.source, r.target) for r in encode.question_pairs(rows).collect()} == {"p": ("dogs", "@@START@@ Q?"), "q": ("cats", None)}
