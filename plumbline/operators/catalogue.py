"""Queries over the test tables for the operators outside the program compiler, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import metrics
from plumbline.functions import text as tx
from plumbline.operators import answers, evaluate, perturb, sampling
from plumbline.plans.compiler import answer as compiled
from plumbline.plans.program import boundary_references, parse

#: Programs, the operators of their steps, and whether they are valid. The operators are written out by hand: the SQL of the
#: queries over them takes them from here, and never from the recogniser.
EXPECTED = (
    ("return lakes ;return depth of #1 ;return #1 where #2 is highest ;return country of #3", "select project superlative project", True),
    ("return bakeries ;return #1 in Lyon ;return breads of #2 ;return number of #3 for each #2 ;return #2 where #4 is more than 12", "select filter project group comparative", True),
    ("return trams ;return #1 that are red ;return #1 that are old ;return number of #2 ;return number of #3 ;return the sum of #4 and #5", "select filter filter aggregate aggregate arithmetic", True),
    ("return bridges ;return length of #1 ;return highest of #2 ;return lowest of #2 ;return the difference of #3 and #4", "select project aggregate aggregate arithmetic", True),
    ("return Ada Hill ;return birthday of #1 ;return Ben Dale ;return birthday of #3 ;return which is lowest of #2 , #4", "select project select project comparison", True),
    ("return the tall jar ;return if #1 is glass ;return if #1 is full ;return if both #2 and #3 are true", "select boolean boolean boolean", True),
    ("return choirs ;return orchestras ;return towns in both #1 and #2 ;return #3 besides Bonn", "select select intersection discard", True),
    ("return songs ;return length of #1 ;return #1 sorted by #2", "select project sort", True),
    ("return poets ;return painters ;return #1 , #2", "select select union", True),
    ("return kites ;return price of #1 ;return sum of #2", "select project aggregate", True),
    ("return owls ;return nest of #3", "select project", False),
    ("return foxes ;return wolves ;return number of #1", "select select aggregate", False),
)
SAMPLES = tuple(text for text, _, _ in EXPECTED)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _programs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"p{i}", f"How many of {i}?", t) for i, t in enumerate(SAMPLES)], "question_id string, question_text string, decomposition string")


_VALUES = "(VALUES " + ", ".join(f"('p{i}', '{t}')" for i, t in enumerate(SAMPLES)) + ") v(question_id, decomposition)"
_STEPS = f"(SELECT question_id, i - 1 AS step, trim(regexp_replace(list[i], '^ *return ', '')) AS t FROM (SELECT question_id, string_split(decomposition, ';') AS list, unnest(range(1, len(string_split(decomposition, ';')) + 1)) AS i FROM {_VALUES}))"


def program_ops(spark, sf_dir):
    return perturb.operators_of(_programs(spark)).select("question_id", F.array_join("operators", " ").alias("ops"))


_OPS = " UNION ALL ".join(f"SELECT 'p{i}' AS question_id, '{ops}' AS ops" for i, (_, ops, _) in enumerate(EXPECTED))
_VALID = " UNION ALL ".join(f"SELECT 'p{i}' AS question_id, {valid} AS valid" for i, (_, _, valid) in enumerate(EXPECTED))


def program_refs(spark, sf_dir):
    steps = _programs(spark).select("question_id", F.posexplode(F.transform(F.split("decomposition", ";"), lambda s: F.trim(F.regexp_replace(s, "^ *return ", "")))).alias("step", "t"))
    return steps.select("question_id", F.col("step").cast("long").alias("step"), F.explode(F.regexp_extract_all("t", F.lit("#([0-9]+)"), F.lit(1)).cast("array<long>")).alias("ref"))


def program_reach(spark, sf_dir):
    """Closure of the references: each round doubles the paths' lengths and keeps a pair once; programs have ten steps at most."""
    reach = program_refs(spark, sf_dir).select("question_id", "step", (F.col("ref") - 1).alias("need")).distinct()
    for _ in range(4):
        further = reach.alias("a").join(reach.alias("b"), F.expr("a.question_id = b.question_id AND a.need = b.step")).select("a.question_id", "a.step", "b.need")
        reach = reach.union(further).distinct()
    return reach


def program_valid(spark, sf_dir):
    return perturb.operators_of(_programs(spark)).select("question_id", "valid")


def op_distribution(spark, sf_dir):
    return perturb.operator_shares(_programs(spark)).select("operator", "n", F.round("share", 6).alias("share"))


def perturbed(spark, sf_dir):
    return perturb.for_dataset(perturb.perturbed(_programs(spark)), "hotpotqa").select("id", "decomposition", "type")


def perturbed_answers(spark, sf_dir, program, kind):
    """Every perturbation of a kind, compiled: exact answers, which the original answer alone does not give."""
    made = [(info, p) for k, info, p, _ in perturb.perturbations(perturb.Example("x", "", parse(program))) if k == kind]
    out = None
    for info, p in made:
        one = compiled(spark, sf_dir, p).select(F.lit(info).alias("info"), F.col("answer").cast("double").alias("answer") if kind != "append_boolean_step" else F.col("answer"))
        out = one if out is None else out.unionByName(one)
    return out


def number_pairs(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("numbers"), F.sum("l_quantity").alias("s"), F.count("*").alias("n")).where("n > 1")
    pairs = answers.number_pairs(rows.select(F.col("l_orderkey").alias("qid"), "numbers", (F.col("numbers")[0] + F.col("numbers")[1]).alias("answer")), "sum")
    return pairs.select("qid", "low", "high")


def consistency(spark, sf_dir):
    return evaluate.consistency(_t(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 1, 1).otherwise(0).alias("indicator")), "user_id").select(F.round("consistency", 9).alias("consistency"), "n_groups")


def _scores(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select(F.concat_ws("+", F.col("conv_id").cast("string"), F.concat(F.lit("turn"), (F.col("turn") % 3).cast("string")), F.col("turn").cast("string")).alias("qid"), ((F.length("text") % 100) / 100).alias("f1"), F.when(F.length("text") % 3 == 0, 1.0).otherwise(0.0).alias("em"))


def gen_orig_join(spark, sf_dir):
    original = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("qid"), F.col("quality").cast("double").alias("f1"), F.col("toxic").cast("double").alias("em"))
    rows = evaluate.with_originals(_scores(spark, sf_dir), original)
    return rows.select("base_id", "transform_base", "transform_info", F.round("f1_gen", 4).alias("f1_gen"), "f1_orig", evaluate.both_right(0.5).alias("right"))


def score_by_transform(spark, sf_dir):
    return evaluate.by_transform(perturb.parts_of_id(_scores(spark, sf_dir), "qid"), "em")


def union_missing(spark, sf_dir):
    a = _t(spark, sf_dir, "events").select("event_id", "event_type")
    return a.unionByName(_t(spark, sf_dir, "labels").select(F.col("doc_id").alias("event_id"), "quality"), allowMissingColumns=True)


def constraint_check(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("p"), F.col("value").cast("string").alias("v"), F.element_at(F.array(*map(F.lit, ("boolean", "arithmetic", ">=", "<="))), (F.col("event_id") % 4 + 1).cast("int")).alias("c"))
    return rows.select("event_id", evaluate.constraint_met(F.when(F.col("c") == "boolean", F.col("p")).otherwise(F.col("v")), F.col("c"), F.lit("10")).alias("met"))


def stratified(spark, sf_dir):
    return sampling.stratified(_t(spark, sf_dir, "documents"), "lang", "doc_id", 25, seed=7).select("doc_id", "lang")


def semi_subset(spark, sf_dir):
    return sampling.subset(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").where("quality = 0"), "doc_id").select("doc_id", "source")


def nested_regroup(spark, sf_dir):
    nested = sampling.regrouped(_t(spark, sf_dir, "conversations"), ["conv_id"], "turn", ["turn", "role"], "turns")
    return nested.select("conv_id", F.size("turns").cast("long").alias("n"), F.array_join(F.transform("turns", lambda t: t["role"]), ",").alias("roles"))


def _turns(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return c.alias("a").join(c.alias("b"), F.expr("a.conv_id = b.conv_id AND b.turn = a.turn + 1")).select("a.conv_id", "a.turn", F.col("a.text").alias("x"), F.col("b.text").alias("y"))


def token_f1(spark, sf_dir):
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(metrics.token_f1(F.col("x"), F.col("y")), 6).alias("f1"), metrics.exact(F.col("x"), F.col("y")).alias("em"))


def sari_unigrams(spark, sf_dir):
    x, y, t = (F.split(F.lower(c), " ") for c in ("x", "y", "z"))
    rows = _turns(spark, sf_dir).withColumn("z", F.concat_ws(" ", "y", F.substring("x", 1, 50)))
    parts = metrics.sari_parts(x, y, t, 1)
    return rows.select("conv_id", "turn", *[F.round(v, 6).alias(k) for k, v in parts.items()])


def sari(spark, sf_dir):
    """SARI over n = 1..4 of a turn (source), the one after it (prediction) and the one after that (target)."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn") - 2, "text").toDF("conv_id", "turn", "z")
    x, y, z = (F.split(F.lower(k), " ") for k in ("x", "y", "z"))
    return _turns(spark, sf_dir).join(c, ["conv_id", "turn"]).select("conv_id", "turn", F.round(metrics.sari(x, y, z), 6).alias("sari"))


def sari_targets(spark, sf_dir):
    """SARI of a turn, the one after it as prediction, and two targets: the turn after that, and the turn with that."""
    c = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn") - 2, "text").toDF("conv_id", "turn", "z")
    x, y, z, xz = (F.split(F.lower(k), " ") for k in (F.col("x"), F.col("y"), F.col("z"), F.concat_ws(" ", "x", "z")))
    rows = _turns(spark, sf_dir).join(c, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", *[F.round(v, 6).alias(k) for k, v in metrics.sari_of_targets(x, y, F.array(z, xz)).items()])


def span_scores(spark, sf_dir):
    """Spans of the first `an` and `the` of benchmark items as predictions of each other, unknown where an item has none."""
    at = lambda w: F.locate(w, F.col("text")) - 1
    rows = _t(spark, sf_dir, "benchmark").select((at("an") % 5).alias("start"), (at("an") % 3).alias("end"), F.when(at("the") < 0, -1).otherwise(at("the") % 5).alias("gold_start"), (at("the") % 3).alias("gold_end"))
    return metrics.span_accuracy(rows, no_answer=True).select(*[F.round(c, 6).alias(c) for c in ("start_acc", "end_acc", "span_acc")], "n")


def find_spans(spark, sf_dir):
    return _t(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.all_offsets(F.col("text"), F.lit("an")).cast("array<long>")).alias("offset"))


def json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def best_answer(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", "event_id")).alias("best_event"))


def standardize(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace(tx.standardized(F.col("text")), r"[ \n\t]+", " ")).alias("digest"))


_NORM = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"
_PAIRS = "(SELECT a.conv_id, a.turn, substr(a.text, 1, 400) AS x, substr(b.text, 1, 400) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len({0}) - n + 2, 1)), lambda i: array_to_string({0}[i:i + n - 1], chr(1))))"
_SARI_TARGETS = (
    "WITH w AS (SELECT a.conv_id, a.turn, string_split(lower(a.text), ' ') AS s, string_split(lower(b.text), ' ') AS p, string_split(lower(c.text), ' ') AS t, string_split(lower(a.text || ' ' || c.text), ' ') AS u "
    "FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2), "
    "g AS (SELECT conv_id, turn, n, " + ", ".join(f"{_GRAMS.format(x)} AS {x}" for x in "sptu") + " FROM w, range(1, 5) r(n)), "
    "k AS (SELECT *, (len(t) > 0)::INTEGER + (len(u) > 0)::INTEGER AS k, list_distinct(list_concat(t, u)) AS every, list_filter(p, lambda x: list_contains(s, x)) AS kept, list_filter(s, lambda x: NOT list_contains(p, x)) AS gone, list_filter(p, lambda x: NOT list_contains(s, x)) AS added FROM g), "
    "c AS (SELECT *, len(list_filter(added, lambda x: list_contains(every, x)))::DOUBLE AS ah, len(added) AS asel, len(list_filter(every, lambda x: NOT list_contains(s, x))) AS arel, "
    + ", ".join(f"CASE WHEN k > 0 THEN (len(list_filter({x}, lambda x: list_contains(t, x))) + len(list_filter({x}, lambda x: list_contains(u, x)))) / k ELSE 0 END AS {y}" for x, y in (("kept", "kh"), ("s", "krel"), ("gone", "dh")))
    + " FROM k), r AS (SELECT conv_id, turn, CASE WHEN asel > 0 THEN ah / asel ELSE 1 END AS p1, CASE WHEN arel > 0 THEN ah / arel ELSE 1 END AS r1, CASE WHEN len(kept) > 0 THEN kh / len(kept) ELSE 1 END AS p2, CASE WHEN krel > 0 THEN kh / krel ELSE 1 END AS r2, CASE WHEN len(gone) > 0 THEN (len(gone) - dh) / len(gone) ELSE 1 END AS d FROM c), "
    "m AS (SELECT conv_id, turn, avg(CASE WHEN p1 > 0 AND r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END) AS a, avg(CASE WHEN p2 > 0 AND r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0 END) AS k, avg(d) AS d FROM r GROUP BY 1, 2) "
    'SELECT conv_id, turn, round(a, 6) AS "add", round(k, 6) AS keep, round(d, 6) AS "delete", round((a + k + d) / 3, 6) AS sari FROM m'
)
_PRICES = "return orders ;return total price of #1 ;"
_AGG = _PRICES + "return average of #2"
_ARITH = _PRICES + "return highest of #2 ;return lowest of #2 ;return the sum of #3 and #4"

#: name -> (query, SQL or None)
OPERATIONS = {
    "program_ops": (program_ops, _OPS),
    "program_refs": (program_refs, f"SELECT question_id, step, unnest(regexp_extract_all(t, '#([0-9]+)', 1))::BIGINT AS ref FROM {_STEPS}"),
    "program_reach": (program_reach, f"WITH RECURSIVE e AS (SELECT question_id, step, unnest(regexp_extract_all(t, '#([0-9]+)', 1))::BIGINT - 1 AS need FROM {_STEPS}), r AS (SELECT question_id, step, need FROM e UNION SELECT r.question_id, r.step, e.need FROM r JOIN e ON r.question_id = e.question_id AND r.need = e.step) SELECT * FROM r"),
    "program_valid": (program_valid, _VALID),
    "op_distribution": (op_distribution, f"WITH o AS (SELECT question_id, unnest(list_distinct(string_split(ops, ' '))) AS operator FROM ({_OPS})) SELECT operator, count(*) AS n, round(count(*) / {len(SAMPLES)}, 6) AS share FROM o GROUP BY 1"),
    "perturbed": (perturbed, None),
    "perturb_aggregate": (partial(perturbed_answers, program=_AGG, kind="op_replace_aggregate"), "SELECT '2-avg-min' AS info, min(o_totalprice) AS answer FROM orders UNION ALL SELECT '2-avg-max', max(o_totalprice) FROM orders UNION ALL SELECT '2-avg-count', count(*) FROM orders"),
    "perturb_arithmetic": (
        partial(perturbed_answers, program=_ARITH, kind="op_replace_arithmetic"),
        "SELECT '4-sum-difference' AS info, max(o_totalprice) - min(o_totalprice) AS answer FROM orders UNION ALL SELECT '4-sum-multiplication', max(o_totalprice) * min(o_totalprice) FROM orders UNION ALL SELECT '4-sum-division', max(o_totalprice) / min(o_totalprice) FROM orders",
    ),
    "perturb_append": (
        partial(perturbed_answers, program="return nations ;return number of #1", kind="append_boolean_step"),
        " UNION ALL ".join(f"SELECT '3-aggregate-{w}-{t}' AS info, CASE WHEN count(*) {o} {v} THEN 'yes' ELSE 'no' END AS answer FROM nation" for t, v in (("two", 2), ("17", 17)) for w, o in (("lower", "<"), ("higher", ">"), ("equal", "="))),
    ),
    "number_pairs": (
        number_pairs,
        "WITH g AS (SELECT l_orderkey AS qid, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4), e AS (SELECT qid, v[1] + v[2] AS answer, list_append(v, 100.0) AS v FROM g), "
        "n AS (SELECT qid, answer, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e WHERE NOT (answer % 1 = 0 AND answer < 10)), "
        "p AS (SELECT DISTINCT a.qid, least(a.x, b.x) AS low, greatest(a.x, b.x) AS high FROM n a JOIN n b ON a.qid = b.qid AND a.i < b.i WHERE a.x + b.x = a.answer) SELECT qid, min(low) AS low, min(high) AS high FROM p GROUP BY qid HAVING count(*) = 1",
    ),
    "consistency": (consistency, "SELECT round(avg(m), 9) AS consistency, count(*) AS n_groups FROM (SELECT user_id, min(CASE WHEN value > 1 THEN 1 ELSE 0 END) AS m FROM events GROUP BY 1)"),
    "gen_orig_join": (
        gen_orig_join,
        "SELECT conv_id::VARCHAR AS base_id, 'turn' || (turn % 3) AS transform_base, turn::VARCHAR AS transform_info, round((length(text) % 100) / 100, 4) AS f1_gen, quality::DOUBLE AS f1_orig, CASE WHEN quality > 0.5 AND (length(text) % 100) / 100 > 0.5 THEN 1 ELSE 0 END AS \"right\" FROM conversations JOIN labels ON conv_id = doc_id",
    ),
    "score_by_transform": (score_by_transform, "SELECT 'turn' || (turn % 3) AS transform_base, round(avg(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END), 3) AS mean_score, count(*) AS n FROM conversations GROUP BY 1"),
    "union_missing": (union_missing, "SELECT event_id, event_type, NULL::INTEGER AS quality FROM events UNION ALL SELECT doc_id, NULL, quality FROM labels"),
    "constraint_check": (constraint_check, "SELECT event_id, CASE event_id % 4 WHEN 0 THEN (lower(event_type) IN ('yes', 'no'))::INTEGER WHEN 1 THEN 1 WHEN 2 THEN (value >= 10)::INTEGER ELSE (value <= 10)::INTEGER END AS met FROM events"),
    "stratified_sample": (stratified, "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS k FROM documents) WHERE k <= 25"),
    "semi_subset": (semi_subset, "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)"),
    "nested_regroup": (nested_regroup, "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1"),
    "token_f1": (
        token_f1,
        f"WITH p AS (SELECT conv_id, turn, {_NORM.format('x')} AS x, {_NORM.format('y')} AS y FROM {_PAIRS}), w AS (SELECT conv_id, turn, x, y, list_filter(string_split(x, ' '), lambda w: w <> '') AS a, list_filter(string_split(y, ' '), lambda w: w <> '') AS b FROM p), "
        "o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda t: least(len(list_filter(a, lambda v: v = t)), len(list_filter(b, lambda v: v = t))))), 0)::DOUBLE AS s FROM w) "
        "SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN (len(a) = len(b))::INTEGER WHEN s = 0 THEN 0 ELSE 2 * s / (len(a) + len(b)) END, 6) AS f1, (x = y)::INTEGER AS em FROM o",
    ),
    "sari_unigrams": (
        sari_unigrams,
        f"WITH p AS (SELECT conv_id, turn, list_distinct(string_split(lower(x), ' ')) AS s, list_distinct(string_split(lower(y), ' ')) AS p, list_distinct(string_split(lower(y || ' ' || substr(x, 1, 50)), ' ')) AS t FROM {_PAIRS}), "
        "c AS (SELECT conv_id, turn, len(list_filter(p, lambda w: NOT list_contains(s, w))) AS sel, len(list_filter(t, lambda w: NOT list_contains(s, w))) AS rel, len(list_filter(p, lambda w: NOT list_contains(s, w) AND list_contains(t, w))) AS hit, "
        "len(list_filter(p, lambda w: list_contains(s, w))) AS ksel, len(list_filter(t, lambda w: list_contains(s, w))) AS krel, len(list_filter(p, lambda w: list_contains(s, w) AND list_contains(t, w))) AS khit, "
        "len(list_filter(s, lambda w: NOT list_contains(p, w))) AS dsel, len(list_filter(s, lambda w: NOT list_contains(p, w) AND NOT list_contains(t, w))) AS dhit FROM p), "
        "r AS (SELECT conv_id, turn, CASE WHEN sel > 0 THEN hit / sel ELSE 1 END AS p1, CASE WHEN rel > 0 THEN hit / rel ELSE 1 END AS r1, CASE WHEN ksel > 0 THEN khit / ksel ELSE 1 END AS p2, CASE WHEN krel > 0 THEN khit / krel ELSE 1 END AS r2, CASE WHEN dsel > 0 THEN dhit / dsel ELSE 1 END AS d FROM c) "
        'SELECT conv_id, turn, round(CASE WHEN p1 > 0 AND r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END, 6) AS "add", round(CASE WHEN p2 > 0 AND r2 > 0 THEN 2 * p2 * r2 / (p2 + r2) ELSE 0 END, 6) AS keep, round(d, 6) AS "delete" FROM r',
    ),
    "sari": (sari, None),
    "sari_targets": (sari_targets, _SARI_TARGETS),
    "span_scores": (
        span_scores,
        "WITH r AS (SELECT (position('an' IN text) - 1) % 5 AS s, (position('an' IN text) - 1) % 3 AS e, position('the' IN text) - 1 AS g FROM benchmark), k AS (SELECT s, e, g % 5 AS gs, g % 3 AS ge FROM r WHERE g >= 0 AND g % 5 <> 0) "
        "SELECT round(avg((s = gs)::INTEGER), 6) AS start_acc, round(avg((e = ge)::INTEGER), 6) AS end_acc, round(avg((s = gs AND e = ge)::INTEGER), 6) AS span_acc, count(*) AS n FROM k",
    ),
    "find_spans": (find_spans, "SELECT item_id, unnest(list_filter(range(0, length(text) - 1), lambda i: substr(text, i + 1, 2) = 'an'))::BIGINT AS \"offset\" FROM benchmark"),
    "json_props": (json_props, "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"),
    "best_answer": (best_answer, "SELECT user_id, arg_max(event_id, row(value, event_id)) AS best_event FROM events GROUP BY 1"),
    "standardize": (standardize, "SELECT doc_id, md5(regexp_replace(trim(text, ' ' || chr(10) || chr(9)), '[ ' || chr(10) || chr(9) || ']+', ' ', 'g')) AS digest FROM documents"),
}

QUERIES = {f"q_{name}": q for name, (q, _) in OPERATIONS.items()}
SQL = {f"q_{name}": sql for name, (_, sql) in OPERATIONS.items() if sql}

__all__ = ["OPERATIONS", "QUERIES", "SQL", "boundary_references"]
