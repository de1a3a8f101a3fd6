"""The pipeline against a brute-force version of each stage, and the entry module without the llm folders."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

from tests.conftest import ROOT, SF
from tests.llm.test_dedup import least, shingles
from tests.llm.test_text_ops import words

import corpus_pipeline
from plumbline.llm import quality
from plumbline.llm.tokens import Tokens


def test_stages(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    score = dict(zip(rows, model.score(list(rows.values())), strict=True))
    rows = {i: t for i, t in rows.items() if score[i] >= 0.3}
    steps = [set(rows)]
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    steps.append(set(first.values()))
    sets = {i: shingles(rows[i], 5) for i in steps[-1]}
    group = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    steps.append({least(g) for g in group.values()})
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[j : j + 13]) for j in range(max(1, len(w) - 12))} if w else set()
    clean = set()
    for i in steps[-1]:
        w, hit = words(rows[i]), set()
        for p in windows:
            for j in range(len(w) - len(p) + 1) if set(p) <= set(w) else ():
                if tuple(w[j : j + len(p)]) == p:
                    hit |= set(range(j, j + len(p)))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    steps.append(clean)
    now = docs
    for (_, stage), want in zip(corpus_pipeline.STAGES[:4], steps, strict=True):
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        assert now.columns == corpus_pipeline.COLUMNS and {r.doc_id for r in now.collect()} == want
    tokens = Tokens()
    pieces = corpus_pipeline.STAGES[4][1](spark, now, SF).collect()
    assert {r.doc_id for r in pieces} == clean
    assert sum(r.length for r in pieces) == sum(len(tokens.ids(rows[i])) + 1 for i in clean)


def test_entry_without_folders(tmp_path):
    keep = tmp_path / "repo"
    shutil.copytree(ROOT, keep, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert not Path(keep, "plumbline/llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=keep, check=True, env=os.environ | {"PYTHONPATH": str(keep)})
