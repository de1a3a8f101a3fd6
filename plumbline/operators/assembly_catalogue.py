"""Queries of the example assembly over the events table, with their SQL. Each event is a perturbed program of its user's
example: its kind goes by the event's number, the original answer by the user's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import assemble, evaluate


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """made, questions, step_answers, originals."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.floor("value").cast("string").alias("whole"))
    i = F.col("event_id")
    pick = lambda by, *options: F.element_at(F.array(*options), (by + 1).cast("int"))
    word = lambda *ws: [F.lit(w) for w in ws]
    k = i % 6
    how, limit = pick(F.floor(i / 6) % 3, *word("lower", "higher", "equal")), (i % 97).cast("string")
    turned = F.when(i % 4 < 2, "logical_or").otherwise("false")
    kind = pick(k, *word("append_boolean_step", "op_replace_boolean", "prune_step", "change_last_step", "op_replace_aggregate", "op_replace_arithmetic"))
    info = pick(k, F.concat(F.lit("2-aggregate-"), how, F.lit("-"), limit), F.concat(F.lit("1-logical_and-"), turned), F.lit("2"), F.lit("3-comparison-boolean-higher_than"), F.lit("1-min-max"), F.lit("3-sum-difference"))
    steps = lambda *xs: F.array(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    transformed = pick(k, steps("number of parts", F.concat(F.lit("if #1 is "), how, F.lit(" than "), limit)), steps("a", "b", "if both #1 and #2 are false"), steps("the parts"), steps("a", "b", "#1 , #2"), steps("parts", "prices of #1", "highest of #2"), steps("a", "b", "the difference of #1 and #2"))
    none = F.lit(None).cast("string")
    given = pick(k, steps(none, none), steps(none, none, none), steps(F.when(i % 5 != 0, F.col("event_type")).otherwise("")), steps(F.col("event_type"), F.col("whole"), none), steps(none, none, F.col("whole")), steps(none, none, none))
    base = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = e.select("event_id", base.alias("orig_id"), F.concat_ws("+", base, kind, F.concat_ws("-", info, i.cast("string"))).alias("id"), F.concat(F.lit("What of "), base, F.lit("?")).alias("question"), F.lit("return parts ;return x of #1").alias("decomposition"), transformed.alias("transformed"), given.alias("step_answers"), F.concat_ws("+", kind, info).alias("transformation"))
    asked = F.when(i % 11 == 0, F.col("question")).otherwise(F.concat(F.lit("And "), F.col("question")))
    questions = rows.where(i % 13 != 0).select(F.col("id").alias("qid"), F.array(F.array(asked)).alias("questions"))
    users = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.floor(F.max("value")).cast("double").alias("v"), F.count("*").cast("double").alias("n"), F.min("event_type").alias("t1"), F.max("event_type").alias("t2"))
    answer = F.when(F.col("user_id") % 3 == 0, "yes").when(F.col("user_id") % 3 == 1, "no").otherwise((F.col("v") + F.col("n")).cast("long").cast("string"))
    originals = users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("query_id"), F.concat(F.lit("T"), (F.col("user_id") % 7).cast("string"), F.lit("_"), F.col("user_id").cast("string")).alias("passage_id"), F.concat_ws(" ", F.lit("Passage"), "t1", "t2").alias("passage"), F.array(answer).alias("answer_texts"), F.array("v", "n").alias("numbers"))
    return rows, questions, rows.select(F.col("id").alias("qid"), "step_answers"), originals


def _info(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, questions, step_answers, originals = _inputs(spark, sf_dir)
    return assemble.example_info(assemble.joined(made.drop("step_answers", "event_id"), questions, step_answers, originals), "drop", allow_yes_no=True)


def _said() -> F.Column:
    return F.coalesce(assemble.said(F.col(assemble.NUMBER)), F.array_join(assemble.SPANS, "|"))


def example_info(spark, sf_dir):
    return _info(spark, sf_dir).select("qid", "passage_id", _said().alias("answer"), "answered_by", "constraint", "bad_form")


def example_counts(spark, sf_dir):
    return assemble.counters(_info(spark, sf_dir))


def examples_kept(spark, sf_dir):
    kept, constraints = assemble.kept_examples(_info(spark, sf_dir))
    return kept.select("qid", F.lit("answer").alias("file")).unionByName(constraints.select("qid", F.lit("constraint").alias("file")))


def examples_skipped(spark, sf_dir):
    made, questions, step_answers, _ = _inputs(spark, sf_dir)
    return assemble.skipped(made, questions, step_answers).select("id")


def examples_drop(spark, sf_dir):
    nested = assemble.as_drop(assemble.kept_examples(_info(spark, sf_dir))[0], yes_no=True, append_yes_no=True)
    one = F.transform("qa_pairs", lambda q: F.concat_ws("=", q["query_id"], q["question"], F.when(q["answer"]["number"] != "", q["answer"]["number"]).otherwise(F.array_join(q["answer"]["spans"], "|"))))
    return nested.select("passage_id", "passage", F.size("qa_pairs").cast("long").alias("n"), F.md5(F.array_join(one, ";")).alias("digest"))


def examples_squad(spark, sf_dir):
    nested = assemble.as_squad(assemble.kept_examples(_info(spark, sf_dir))[0])
    flat = nested.select("title", F.posexplode("paragraphs").alias("at", "p")).select("title", F.col("at").cast("long").alias("at"), "p.context", F.explode("p.qas").alias("q"))
    return flat.select("title", "at", "q.id", F.col("q.answers")[0]["text"].alias("text"), F.col("q.answers")[0]["answer_start"].alias("answer_start"))


def constraint_scores(spark, sf_dir):
    """Predictions are the users' counts of events; originals' scores go by the user's number."""
    info = assemble.kept_examples(_info(spark, sf_dir))[1]
    events = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    predictions = info.select("qid", F.substring_index("qid", "+", 1).alias("u")).join(events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("u"), F.col("n").cast("string").alias("prediction")), "u")
    original = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("qid"), (F.col("user_id") % 2).cast("double").alias("f1"), (F.col("user_id") % 2).cast("double").alias("em"))
    rows = assemble.constraints_with_originals(assemble.constraint_predictions(predictions, info), original)
    rows = rows.withColumns({"f1_gen": F.lit(None).cast("double"), "em_gen": F.lit(None).cast("double")})
    return rows.select("qid", "base_id", "transform_base", "score_gen", evaluate.right_and_met(0.8).alias("right"))


_ROWS = """
WITH u AS (
  SELECT user_id, floor(max(value)) AS v, count(*)::DOUBLE AS n, 'Passage ' || min(event_type) || ' ' || max(event_type) AS passage FROM events GROUP BY 1
), o AS (
  SELECT *, CASE user_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE (v + n)::BIGINT::VARCHAR END AS a FROM u
), p AS (
  SELECT user_id, min(lo) AS lo, min(hi) AS hi FROM (
    SELECT DISTINCT user_id, least(x, y) AS lo, greatest(x, y) AS hi
    FROM (SELECT user_id, v AS x, n AS y, v + n AS s FROM o UNION ALL SELECT user_id, v, 100, v + n FROM o UNION ALL SELECT user_id, n, 100, v + n FROM o) WHERE x + y = s AND s >= 10 AND user_id % 3 = 2
  ) GROUP BY 1 HAVING count(*) = 1
), e AS (
  SELECT event_id AS i, user_id, event_type AS t, floor(value)::BIGINT::VARCHAR AS w, event_id % 6 AS k, ['lower', 'higher', 'equal'][event_id // 6 % 3 + 1] AS how, event_id % 97 AS lim,
         CASE WHEN event_id % 4 < 2 THEN 'logical_or' ELSE 'false' END AS turned,
         ['append_boolean_step', 'op_replace_boolean', 'prune_step', 'change_last_step', 'op_replace_aggregate', 'op_replace_arithmetic'][event_id % 6 + 1] AS kind
  FROM events
), q AS (
  SELECT e.*, o.v, o.n, o.a, o.passage, p.lo, p.hi, 'T' || (e.user_id % 7) || '_' || e.user_id AS passage_id,
         'u' || e.user_id || '+' || kind || '+' || CASE k WHEN 0 THEN '2-aggregate-' || how || '-' || lim WHEN 1 THEN '1-logical_and-' || turned WHEN 2 THEN '2' WHEN 3 THEN '3-comparison-boolean-higher_than' WHEN 4 THEN '1-min-max' ELSE '3-sum-difference' END || '-' || i AS qid
  FROM e JOIN o USING (user_id) LEFT JOIN p USING (user_id)
), f AS (
  SELECT *, CASE k
      WHEN 0 THEN CASE WHEN user_id % 3 = 2 THEN CASE WHEN how = 'lower' AND v + n < lim OR how = 'higher' AND v + n > lim OR how = 'equal' AND v + n = lim THEN ['yes'] ELSE ['no'] END END
      WHEN 1 THEN CASE WHEN a = 'yes' AND turned = 'false' THEN ['no'] WHEN a IN ('yes', 'no') AND turned = 'logical_or' THEN [a] END
      WHEN 2 THEN CASE WHEN i % 5 <> 0 THEN [t] END
      WHEN 3 THEN [t, w]
      WHEN 4 THEN [w] END AS spans,
    CASE WHEN k = 5 THEN hi - lo END AS num, CASE k WHEN 3 THEN 'evaluation' WHEN 4 THEN 'evaluation' ELSE kind END AS by_,
    CASE k WHEN 3 THEN 'boolean' WHEN 4 THEN '>=' WHEN 5 THEN '<=' END AS "constraint"
  FROM q WHERE i % 13 <> 0
), g AS (
  SELECT *, spans IS NOT NULL OR num IS NOT NULL AS found,
    num IS NOT NULL OR spans IN (['yes'], ['no']) OR len(list_filter(spans, lambda s: NOT contains(passage, s) AND NOT contains('What of u' || user_id || '?', s))) = 0 AS fits
  FROM f
), info AS (
  SELECT *, found AND NOT coalesce(fits, FALSE) AS bad_form, CASE WHEN found AND fits THEN by_ END AS answered_by,
    CASE WHEN found AND fits THEN coalesce(num::BIGINT::VARCHAR, array_to_string(spans, '|')) END AS answer
  FROM g
)
"""

#: name -> (query, SQL)
OPERATIONS = {
    "example_info": (example_info, _ROWS + 'SELECT qid, passage_id, answer, answered_by, "constraint", bad_form FROM info'),
    "example_counts": (
        example_counts,
        _ROWS + "SELECT kind AS transform_base, count(*) AS n, count(answer) AS answers, count(*) FILTER (bad_form) AS bad_form, count(*) FILTER (answer IS NULL AND NOT bad_form) AS no_answer, "
        'count("constraint") AS constraints, count(*) FILTER (answer IS NOT NULL AND "constraint" IS NOT NULL) AS "both", count(*) FILTER (answer IS NULL AND "constraint" IS NULL) AS neither FROM info GROUP BY 1',
    ),
    "examples_kept": (examples_kept, _ROWS + "SELECT qid, 'answer' AS file FROM info WHERE i % 11 <> 0 AND answer IS NOT NULL UNION ALL SELECT qid, 'constraint' FROM info WHERE i % 11 <> 0 AND \"constraint\" IS NOT NULL"),
    "examples_skipped": (examples_skipped, _ROWS + "SELECT qid AS id FROM q WHERE i % 13 = 0"),
    "examples_drop": (
        examples_drop,
        _ROWS + "SELECT passage_id, passage, count(*) AS n, md5(string_agg(qid || '=And What of u' || user_id || '? yes no=' || answer, ';' ORDER BY qid)) AS digest FROM info WHERE i % 11 <> 0 AND answer IS NOT NULL GROUP BY 1, 2",
    ),
    "examples_squad": (
        examples_squad,
        _ROWS + "SELECT 'T' || (user_id % 7) AS title, dense_rank() OVER (PARTITION BY user_id % 7 ORDER BY user_id) - 1 AS at, qid AS id, replace(answer, '|', ';') AS text, (position(replace(answer, '|', ';') IN passage) - 1)::INTEGER AS answer_start FROM info WHERE i % 11 <> 0 AND answer IS NOT NULL",
    ),
    "constraint_scores": (
        constraint_scores,
        _ROWS + ", c AS (SELECT *, CASE k WHEN 3 THEN 0.0 WHEN 4 THEN CASE WHEN user_id % 3 = 2 THEN (n >= v + n)::INTEGER END ELSE CASE WHEN user_id % 3 = 2 THEN (n <= v + n)::INTEGER END END::DOUBLE AS score_gen FROM info WHERE i % 11 <> 0 AND \"constraint\" IS NOT NULL) "
        "SELECT qid, 'u' || user_id AS base_id, kind AS transform_base, score_gen, CASE WHEN user_id % 2 = 1 AND score_gen = 1 THEN 1 ELSE 0 END AS \"right\" FROM c WHERE score_gen IS NOT NULL",
    ),
}

QUERIES = {f"q_{name}": q for name, (q, _) in OPERATIONS.items()}
SQL = {f"q_{name}": sql for name, (_, sql) in OPERATIONS.items()}
