"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of 13 words of the benchmark's items (a shorter item is one window); patterns of one length
form an automaton of their own. For each the block shift table tells from the last two words under the search window how
far it may jump without missing an occurrence; where the shift is 0, the bucket of that block holds the patterns that
end with it, the first word filters them, and the words themselves are compared.

Patterns are searched in blocks of at most MAX_PATTERNS, a pass over the documents each, so that what a task holds has a
bound however large the benchmark is.

Defined cases: a null text has no words (n_words 0, not contaminated); items without words match nothing; equal windows
of several items count for each of them; an item id that occurs on several rows is one item; a null item id is left
out; rows that share a document id are judged one by one; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import LOWER, UPPER, from_texts, table, written

WINDOW = 13
#: Windows of one pass: about 100 bytes of text each.
MAX_PATTERNS = 1_000_000
#: Bytes outside [\x00-\x2F\x3A-\x60\x7B-\x7F] make words once A-Z are lower-cased.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class WuManber:
    """Search for word patterns of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], int]):
        self.size = len(next(iter(patterns)))
        self.block = min(2, self.size)
        self.far = self.size - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, number in patterns.items():
            for end in range(self.block, self.size + 1):
                key = p[end - 1] if self.block == 1 else (p[end - 2], p[end - 1])
                self.shift[key] = min(self.shift.get(key, self.far), self.size - end)
            self.bucket.setdefault(key, {}).setdefault(p[0], []).append((list(p), number))

    def search(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        found, n, size, far = [], len(words), self.size, self.far
        if self.block == 1:
            return [(i, number) for i, w in enumerate(words) if w in self.bucket for _, number in self.bucket[w].get(w, ())]
        shift, bucket, end = self.shift.get, self.bucket, size - 1
        while end < n:
            jump = shift(key := (words[end - 1], words[end]), far)
            if jump:
                end += jump
                continue
            start = end - size + 1
            for p, number in bucket[key].get(words[start], ()):
                if words[start : end + 1] == p:
                    found.append((start, number))
            end += 1
        return found


def _automata(patterns: list[tuple[bytes, ...]]) -> list[WuManber]:
    by: dict[int, dict] = {}
    for number, p in enumerate(patterns):
        by.setdefault(len(p), {})[p] = number
    return [WuManber(x) for _, x in sorted(by.items())]


def _searcher(patterns: list[tuple[bytes, ...]], owners: list[list[str]]):
    """owners: the items of each pattern. Out: n_words, the hit words as sorted runs, the items."""

    def make():
        automata = _automata(patterns)

        def work(texts: list[str | None]) -> dict:
            counts, starts, ends, items = [], [], [], []
            for text in texts:
                words = words_of(text)
                spans, whose = [], set()
                for a in automata:
                    for start, number in a.search(words):
                        spans.append((start, start + a.size))
                        whose.update(owners[number])
                merged: list[list[int]] = []
                for s, e in sorted(spans):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
                counts.append(len(words))
                starts.append([s for s, _ in merged])
                ends.append([e for _, e in merged])
                items.append(sorted(whose))
            return {"n_words": counts, "starts": starts, "ends": ends, "items": items}

        return work

    return make


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list]]:
    """Patterns with their items, MAX_PATTERNS at a time at most; items come one by one and sorted, so that no more is held."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item_id is not null and text is not null").orderBy("text").toLocalIterator()
    block: dict[tuple[bytes, ...], set[str]] = {}
    sent = False
    for row in rows:
        for w in windows_of(words_of(row["text"])):
            if w not in block and len(block) >= MAX_PATTERNS:
                yield list(block), [sorted(x) for x in block.values()]
                block, sent = {}, True
            block.setdefault(w, set()).add(row["item"])
    if block or not sent:
        yield list(block), [sorted(x) for x in block.values()]


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: row (its number in this run), id, n_words, starts and ends of the hit runs of words, and the items that occur."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("__text"))
    fields = {"n_words": "long", "starts": "array<int>", "ends": "array<int>", "items": "array<string>"}
    blocks = _blocks(benchmark)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return from_texts(rows, _searcher(*block), fields)
    rows, out = written(rows, "numbered-texts"), None  # one numbering for all passes; each is done before the next block is made
    while block:
        one = written(from_texts(rows, _searcher(*block), fields), "pass")
        out, block, after = one if out is None else out.unionByName(one), after, next(blocks, None)
    flat = out.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    merged = flat.mapInPandas(_merge, "row long, n_words long, starts array<int>, ends array<int>, items array<string>")
    return rows.select("row", "id").join(merged, "row")


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        starts, ends = [], []
        for s, e in zip(pdf["starts"], pdf["ends"], strict=True):
            order = np.argsort(s, kind="stable")
            s, e = np.asarray(s, np.int64)[order], np.maximum.accumulate(np.asarray(e, np.int64)[order]) if len(s) else np.zeros(0, np.int64)
            new = np.ones(len(s), bool)
            new[1:] = s[1:] > e[:-1]
            starts.append(s[new].tolist())
            ends.append(e[np.append(new[1:], True)].tolist() if len(s) else [])
        yield pdf.assign(starts=starts, ends=ends)


def judged(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row the counts, the items' digest, and whether a twentieth of the words or more is hit."""
    hits = contaminated_spans(docs, benchmark, id_col, text_col)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return hits.select(
        F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), t AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM p) WHERE len(w) >= k)
), h AS (
  SELECT doc_id, i, t.k, item FROM t JOIN p USING (s) WHERE t.k = p.k
), n AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
