"""The command line from a file of programs to examples and reports."""

import json

from plumbline import cli
from plumbline.sources import readers


def test_from_programs_to_examples(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "p.csv").write_text('question_id,question_text,decomposition,operators,split\nDROP_dev_p1_q1,How many dogs did Ann see?,"return dogs ;return #1 that are old ;return number of #2",,dev\nHOTPOT_dev_h1,Is the jar full?,"return jars ;return if #1 is full",,dev\n')
    cli.main(["perturb", "--input_file", at("p.csv"), "--output_file", at("made"), "--dataset_name", "drop"])
    made = readers.transformed_programs(spark, at("made"), "drop").collect()
    assert made and all(r.orig_id == "p1_q1" and r.decomposition.startswith("return dogs") for r in made)
    asked = [r for r in made if "append_boolean_step" in r.transformation]
    assert asked and asked[0].transformed[-1].startswith("if #3 is")
    (tmp_path / "q.jsonl").write_text("".join(json.dumps({"qid": r.id, "questions": [["If they are few?"]]}) + "\n" for r in made))
    (tmp_path / "s.json").write_text(json.dumps([{"qid": r.id, "step_answers": [None] * len(r.transformed)} for r in made]))
    (tmp_path / "d.json").write_text('{"p1": {"passage": "Ann saw 5 dogs.", "wiki_url": "", "qa_pairs": [{"question": "How many dogs did Ann see?", "query_id": "q1", "answer": {"number": "5", "date": {}, "spans": []}}]}}')
    cli.main(["example-info", "--qdmrs_path", at("made"), "--gen_qs_path", at("q.jsonl"), "--pred_step_ans_path", at("s.json"), "--orig_data_path", at("d.json"), "--output_path", at("x"), "--dataset_name", "drop", "--allow_yes_no"])
    info = spark.read.json(at("x_example_info")).collect()
    assert {r.qid for r in info} == {r.id for r in asked}
    assert all(r.answer_spans[0] == ("yes" if r.qid.endswith(("lower-17", "higher-two")) else "no") for r in info)
    cli.main(["examples", "--example_info_path", at("x_example_info"), "--output_path", at("out"), "--data_format", "drop", "--allow_yes_no"])
    one = spark.read.json(at("out")).first()
    assert one.passage_id == "p1" and len(one.qa_pairs) == len(info)
    cli.main(["subset", "--break_data_path", at("p.csv"), "--orig_data_path", at("d.json"), "--output_path", at("sub"), "--data_format", "drop"])
    assert spark.read.json(at("sub")).count() == 1
    cli.main(["numeric", "--file", f"DROP={at('d.json')}", "--output_file", at("n")])
    assert spark.read.json(at("n")).first().number == 5.0
    cli.main(["parser-input", "--file", f"drop={at('d.json')}", "--output_file", at("pi")])
    assert spark.read.csv(at("pi"), header=True).first().question_id == "DROP_dev_p1_q1"
    (tmp_path / "g.jsonl").write_text("".join(json.dumps({"qid": r.qid, "f1": 1.0, "em": 1.0, "answer": {"value": "yes"}}) + "\n" for r in info))
    (tmp_path / "o.jsonl").write_text(json.dumps({"query_id": "DROP_dev_p1_q1", "f1": 0.9, "em": 0.0, "answer": {"value": "5"}}) + "\n")
    (tmp_path / "c.json").write_text(json.dumps({"qid": asked[0].id, "constraint": "boolean", "orig_answer_texts": ["5"]}) + "\n")
    capsys.readouterr()
    cli.main(["evaluate", "--gen_preds_path", at("g.jsonl"), "--orig_preds_path", at("o.jsonl"), "--gen_const_preds_path", at("g.jsonl"), "--orig_const_preds_path", at("o.jsonl"), "--example_info_file", at("c.json")])
    said = capsys.readouterr().out
    assert said.count("consistency") == 3 and "constraints: generated by constraint" in said and "|0.0|1.0|" in said
