"""Removal of repeated lines and sentences by hashing.

Each text is cut at line feeds, and each line after its runs of `.`, `!` and `?`. Units are the lines of at least min_words words
(op4_unit_dedup: one, so every line that is not blank) and, since passages also come within longer lines, the sentences of at
least sentence_words words of lines that have several (none in repeated_lines). A unit is normalised (A-Z lower-cased, white space collapsed) and hashed to
128 bits. Units are grouped by digest over all documents; the earliest one, by document id and then by position, stays, and the
others go. Where they stood is kept as character offsets into the original text; a sentence within a line that goes isn't
listed again. A line takes its line feed with it.

A first scan numbers the rows in a table of the shared folder, a second writes a small row a unit. Which halves of digests occur
more than once is counted first, so that only units of these are ranked. Both groupings sum up by task
first, so a line that a third of all documents share sends a row a task, and the joins with the groups are ones that Spark can
split. Only the texts themselves are shuffled once more, to their spans, where they are cut and hashed.

Defined cases: null and empty texts have no units; blank lines and units of fewer words always stay; a null id comes after all
others, rows with one id are ranked by the digest of their text, and of equal rows one, any, counts as the first; each row gives a
row; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import BROADCAST_ROWS, LOWER, UPPER, from_texts, maybe_broadcast, table, written

MIN_WORDS, SENTENCE_WORDS = 5, 8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SENTENCE = re.compile(r"[^.!?]+[.!?]*|[.!?]+")


def _normal(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def units_of(text: str | None, min_words: int = MIN_WORDS, sentence_words: int | None = None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, 1 for a line or 0 for a sentence, digest) of the units."""
    out, at = [], 0

    def add(words: list[bytes], start: int, end: int, line: int) -> None:
        out.append((start, end, line, hashlib.blake2b(b" ".join(words), digest_size=16).digest()))

    for line in (text or "").split("\n"):
        words = _normal(line)
        if words and len(words) >= min_words:
            add(words, at, at + len(line), 1)
        if sentence_words and len(words) >= sentence_words:
            pieces = [m.span() for m in _SENTENCE.finditer(line)]
            for a, b in pieces if len(pieces) > 1 else ():
                some = _normal(line[a:b])
                if len(some) >= sentence_words:
                    add(some, at + a, at + b, 0)
        at += len(line) + 1
    return out


def _scan(min_words: int, sentence_words: int | None):
    """A row for each unit; the other columns are those of its document, by Arrow."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            keep = [n for n in batch.schema.names if n != "text"]
            for a in range(0, len(texts), 500):
                found = [units_of(t, min_words, sentence_words) for t in texts[a : a + 500]]
                of = pa.array(np.repeat(np.arange(a, a + len(found)), [len(x) for x in found]))
                flat = [u for x in found for u in x]
                columns = [batch.column(batch.schema.get_field_index(n)).take(of) for n in keep]
                columns += [pa.array([u[k] for u in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
                columns.append(pa.array(np.frombuffer(b"".join(u[3][:8] for u in flat), np.int64)))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "start", "end", "line", "digest", "half"])

    return run


def outermost(starts: list[int], ends: list[int], lines: list[int]) -> list[tuple[int, int, int]]:
    """Sorted spans without those inside a line that goes."""
    out: list[tuple[int, int, int]] = []
    for a, b, line in sorted(zip(starts, ends, lines, strict=True), key=lambda x: (x[0], -x[2])):
        if not (out and out[-1][2] and b <= out[-1][1]):
            out.append((a, b, line))
    return out


def without(text: str, starts: list[int], ends: list[int], lines: list[int] | None = None) -> str:
    """A text without its removed units; the line feed of a line goes with it. Without `lines` all are lines."""
    out, at = [], 0
    for a, b, line in zip(starts, ends, lines or [1] * len(starts), strict=True):
        out.append(text[at:a])
        at = min(len(text), b + line)
    return "".join(out) + text[at:]


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, sentence_words: int | None = SENTENCE_WORDS, texts: bool = False) -> DataFrame:
    """For each row: id, n_units, n_removed, removed_chars, starts and ends of what goes in the original text, and the SHA-256
    of what stays; with texts also that itself (kept_text)."""
    kind = dict(docs.dtypes)[id_col]
    body = F.col(text_col).cast("string")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), body.alias("text")), "numbered")
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "sha", "row", "start")
    units = rows.select("row", "id", F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 32)).alias("sha"), "text")
    units = written(units.mapInArrow(_scan(min_words, sentence_words), f"row long, id {kind}, sha binary, start int, end int, line int, digest binary, half long"), "units")
    # most units occur once: half of their digest tells so
    often = written(units.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"), "repeated-halves")
    more = units.join(F.broadcast(often) if often.count() <= 4 * BROADCAST_ROWS else often, "half").drop("half")
    more = written(more, "repeated-units")
    first = more.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first.row", "first.start").withColumnsRenamed({"row": "row1", "start": "start1"})
    first = written(first, "groups")
    later = more.select("digest", "row", "start", "end", "line").join(maybe_broadcast(first, first.count()), "digest").where("NOT (row = row1 AND start = start1)")
    gone = later.groupBy("row").agg(*(F.collect_list(c).alias(c) for c in ("start", "end", "line")))
    counts = units.groupBy("row").agg(F.count("*").alias("n_units"))

    def make():
        def work(pairs: list) -> dict:
            out: dict[str, list] = {k: [] for k in ("n_removed", "removed_chars", "starts", "ends", "kept_sha256", "kept_text")}
            for x in pairs:
                text, spans = x["text"] or "", outermost(x["start"], x["end"], x["line"]) if x["start"] else []
                kept = without(text, *([s[k] for s in spans] for k in range(3)))
                for name, v in zip(out, (len(spans), sum(b - a for a, b, _ in spans), [a for a, _, _ in spans], [b for _, b, _ in spans], hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest(), kept), strict=True):
                    out[name].append(v)
            return out

        return work

    fields = {"n_removed": "long", "removed_chars": "long", "starts": "array<int>", "ends": "array<int>", "kept_sha256": "string"} | ({"kept_text": "string"} if texts else {})
    full = rows.join(counts, "row", "left").join(gone, "row", "left").select(F.col("id").alias(id_col), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.struct("text", "start", "end", "line").alias("__text"))
    return from_texts(full, make, fields)


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines only: id, n_units, n_removed, removed_chars, starts, ends."""
    return repeated_units(docs, id_col, text_col, min_words, None).drop("kept_sha256")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines and no sentences; op4_unit_dedup is the registered query."""
    return repeated_lines(table(spark, sf_dir, "documents"), min_words=1)


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_units(table(spark, sf_dir, "documents"), min_words=1)
    spans = F.array_join(F.zip_with("starts", "ends", lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string"))), ",")
    return found.select("doc_id", "n_units", "n_removed", "removed_chars", spans.alias("spans"), "kept_sha256")


OP4_SQL = rf"""
WITH l AS (
  SELECT doc_id, k, n, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS pos
  FROM (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS k, len(x) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), p AS (
  SELECT doc_id, k, pos, j, m, piece, sum(length(piece)) OVER (PARTITION BY doc_id, k ORDER BY j) - length(piece) AS off
  FROM (SELECT doc_id, k, pos, unnest(x) AS piece, generate_subscripts(x, 1) AS j, len(x) AS m FROM (SELECT doc_id, k, pos, regexp_extract_all(line, '[^.!?]+[.!?]*|[.!?]+') AS x FROM l))
), u AS (
  SELECT doc_id, k, 1 AS line, pos AS a, pos + length(line) AS b, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w, 1 AS least_words, 0 AS j FROM l
  UNION ALL
  SELECT doc_id, k, 0, pos + off, pos + off + length(piece), regexp_extract_all(translate(piece, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), 8, j FROM p WHERE m > 1
), r AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, a) > 1 AS later FROM u WHERE len(w) >= least_words
), c AS (
  SELECT doc_id, count(*) AS n_units FROM r GROUP BY 1
), g AS (
  SELECT x.doc_id, x.k, x.j, x.a, x.b FROM r x WHERE later AND (line = 1 OR NOT EXISTS (SELECT 1 FROM r y WHERE y.doc_id = x.doc_id AND y.k = x.k AND y.line = 1 AND y.later))
), s AS (
  SELECT doc_id, count(*) AS n_removed, sum(b - a) AS removed_chars, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM g GROUP BY 1
), q AS (
  SELECT doc_id, k, string_agg(piece, '' ORDER BY j) AS line FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = p.doc_id AND g.k = p.k AND g.j = p.j AND g.j > 0) GROUP BY 1, 2
), t AS (
  SELECT l.doc_id, string_agg(coalesce(q.line, '') || CASE WHEN l.k < l.n THEN chr(10) ELSE '' END, '' ORDER BY l.k) AS kept
  FROM l LEFT JOIN q USING (doc_id, k) WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc_id = l.doc_id AND g.k = l.k AND g.j = 0) GROUP BY 1
)
SELECT d.doc_id, coalesce(n_units, 0)::BIGINT AS n_units, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed_chars, 0)::BIGINT AS removed_chars,
       coalesce(spans, '') AS spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM (SELECT doc_id FROM documents) d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""
