"""The seam for models: a predictor answers batches of (question, passage); steps are answered round by round.

A predictor is made once a task by a factory, so that a model is loaded where it runs. Nothing here knows what it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.program import boundary_references, fill_references, reachable

Predictor = Callable[[list[str], list[str]], list[str | None]]
REGISTRY: dict[str, Callable[[], Predictor]] = {}
MOST_ROUNDS = 10
#: Questions that a predictor gets at once; requests that the HTTP client has open, and how often it sends one.
BATCH, AT_ONCE, TRIES = 256, 8, 3


def register(name: str):
    def add(factory: Callable[[], Predictor]):
        REGISTRY[name] = factory
        return factory

    return add


@register("stub")
def stub() -> Predictor:
    """Deterministic: the number of a passage's words for `how many`, else its first capitalised word."""

    def predict(questions: list[str], passages: list[str]) -> list[str | None]:
        found = [re.search(r"\b[A-Z]\w*", p or "") for p in passages]
        return [str(len((p or "").split())) if "number" in q.lower() or "how many" in q.lower() else m[0] if m else None for q, p, m in zip(questions, passages, found, strict=True)]

    return predict


@register("http")
def http() -> Predictor:
    """A service at PREDICTOR_URL: AT_ONCE requests at a time, each over a connection that stays open for its thread; one that
    fails for want of a connection or by the server's fault is sent again, TRIES times in all."""
    import json
    import os
    import threading
    import time
    from concurrent.futures import ThreadPoolExecutor
    from http.client import HTTPConnection, HTTPException, HTTPSConnection
    from urllib.parse import urlsplit

    place = urlsplit(os.environ["PREDICTOR_URL"])
    kept, pool = threading.local(), ThreadPoolExecutor(AT_ONCE)

    def ask(question: str, passage: str) -> str | None:
        body = json.dumps({"question": question, "passage": passage}).encode()
        for attempt in range(1, TRIES + 1):
            try:
                if not hasattr(kept, "line"):
                    kept.line = (HTTPSConnection if place.scheme == "https" else HTTPConnection)(place.netloc, timeout=60)
                kept.line.request("POST", f"{place.path.rstrip('/')}/predict", body, {"Content-Type": "application/json"})
                reply = kept.line.getresponse()
                said = reply.read()
                if reply.status < 400:
                    return json.loads(said).get("best_span_str")
                if reply.status < 500 or attempt == TRIES:
                    raise ValueError(f"the service says {reply.status}")
            except (OSError, HTTPException):
                kept.__dict__.pop("line", None)
                if attempt == TRIES:
                    raise
            time.sleep(0.2 * attempt)
        return None

    return lambda questions, passages: list(pool.map(ask, questions, passages))


def step_question(step: str) -> str:
    """A step as a question: what is the ...? unless it asks already."""
    text = step.strip()
    if re.match(r"(what|when|where|who|which|why|how|if|is|are|did|does|do)\b", text, re.I):
        return text if text.endswith("?") else text + "?"
    return f"what is {'' if re.match(r'(the|a|an) ', text) else 'the '}{text}?"


def answered_rows(rows: list[tuple[list[str], str]], predict: Predictor) -> list[tuple[list[str | None] | None, str | None]]:
    """Answers of the steps that each row's last one needs, and what went wrong. In rounds over all rows: a step is asked when all
    it names has an answer, BATCH questions at a time; where those fail together they are asked one by one, and a failure
    is its own row's."""
    answers: list[list | None] = [[None] * len(texts) for texts, _ in rows]
    wanted, asked, errors = [set() for _ in rows], [set() for _ in rows], [None] * len(rows)
    for k, (texts, _) in enumerate(rows):
        need = reachable(texts, MOST_ROUNDS) if texts else None
        if need is None:
            answers[k], errors[k] = None, "cyclic or too long" if texts else "no steps"
        else:
            wanted[k] = {len(texts) - 1} | {r for i, r in need if i == len(texts) - 1}

    def replies(part: list[tuple[int, int]]) -> list:
        questions = [step_question(fill_references(rows[k][0][i], answers[k])) for k, i in part]
        try:
            return predict(questions, [rows[k][1] for k, _ in part])
        except Exception as e:  # noqa: BLE001  whatever a model raises is told, not hidden
            return [e] if len(part) == 1 else [x for one in part for x in replies([one])]

    for _ in range(MOST_ROUNDS):
        ready = [(k, i) for k, (texts, _) in enumerate(rows) if errors[k] is None for i in sorted(wanted[k] - asked[k]) if all(r in asked[k] for r in boundary_references(texts[i]) if r < len(texts))]
        if not ready:
            break
        for a in range(0, len(ready), BATCH):
            part = ready[a : a + BATCH]
            for (k, i), said in zip(part, replies(part), strict=True):
                asked[k].add(i)
                if isinstance(said, Exception):
                    answers[k], errors[k] = None, repr(said)
                elif answers[k] is not None:
                    answers[k][i] = said
    return list(zip(answers, errors, strict=True))


def with_step_answers(rows: DataFrame, predictor: str) -> DataFrame:
    """rows(qid, steps array, passage) with step_answers; what goes wrong is said in `error` and leaves other rows alone."""
    factory = REGISTRY[predictor]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = factory()
        for pdf in batches:
            found = answered_rows([([] if x is None else list(x), p) for x, p in zip(pdf["steps"], pdf["passage"], strict=True)], predict)
            yield pd.DataFrame({"qid": pdf["qid"], "step_answers": [x for x, _ in found], "error": [e for _, e in found]})

    return rows.select("qid", "steps", "passage").mapInPandas(run, "qid string, step_answers array<string>, error string")


def best_of_windows(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """qid, answer of scored windows(qid, span, span_score, null_score): the best span, or none where the least null score beats it."""
    best = scored.groupBy("qid").agg(F.max_by("span", "span_score").alias("span"), F.max("span_score").alias("score"), F.min("null_score").alias("null_score"))
    return best.select("qid", F.when(F.col("null_score") - F.col("score") > threshold, F.lit("")).otherwise(F.col("span")).alias("answer"))
