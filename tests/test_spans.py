from plumbline.functions import spans as sp
from plumbline.operators.encode import instances
from plumbline.sources import schemas
from plumbline.streaming import perturb_stream


def test_numbers_and_signs():
    numbers, places = sp.passage_numbers("Ann ran 3 miles and two million steps in 10".split())
    assert numbers == [3.0, 2e6, 10.0, 0.0] and places == [2, 5, 9, -1]
    assert [1, 0, 1, 0] in sp.sign_rows(numbers, [13.0]) and [2, 0, 1, 0] in sp.sign_rows(numbers, [7.0])
    assert sp.count_labels([3.0, 12.0, 2.5]) == [3]


def test_spans():
    assert sp.char_spans("cat, concat cat", "cat", near=12) == [sp.Span(12, 14), sp.Span(0, 2)]
    assert sp.token_span(sp.tokens_of("the big cat"), sp.Span(4, 10)) == sp.Span(1, 2)
    assert sp.Span(1, 4).covers(sp.Span(2, 4)) and not sp.Span(2, 4).has(1)
    assert sp.interpreted("a b | c |".split(), "|") == ["a b", "c"]
    assert sp.whole_words(["un", "##do", "it"], lambda p: p.startswith("##")) == [[0, 1], [2]]


def test_layouts():
    answer = [{"number": "", "date": {}, "spans": ["Ann"]}]
    assert sp.encoded("Who ran", "Then Ann ran", answer, "squad")["span"] == (1, 1)
    assert sp.encoded("Who ran", "Then Ann ran", answer, "bert")["spans"] == [(4, 4)]
    row = sp.encoded("How many", "She had 5 and 3 .", [{"number": "8", "date": {}, "spans": []}])
    assert row["passage_spans"] == [(-1, -1)] and row["signs"] == [[1, 1, 0]] and row["counts"] == [8]
    assert sp.encoded("Who", "Nobody", answer) is None
    assert sp.answer_texts({"number": "", "date": {"day": "4", "month": "July", "year": ""}, "spans": []}) == ("date", ["July", "4"])


def test_instances(spark):
    rows = spark.createDataFrame([("a", "Who ran", "Then Ann ran", [("", None, ["Ann"])]), ("b", "Who", "x", [("", None, ["y"])])], f"query_id string, question string, passage string, answers array<{schemas.ANSWER}>")
    got = instances(rows).collect()
    assert [r.query_id for r in got] == ["a"] and got[0].passage_spans[0].start == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text('question_id,question_text,decomposition,operators,split\np,How many cats?,"return big red cats ;return number of #1",,dev\n')
    out = perturb_stream.perturbed_stream(perturb_stream.read_programs(spark, str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("type = 'append_boolean_step'").count() == 6
