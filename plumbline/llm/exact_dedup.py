"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. One scan normalises each text and takes its SHA-256, whose first 64 bits are its fingerprint; each chunk of a task's
   rows sends every owner (a range of the fingerprint space) its sorted distinct fingerprints as Golomb-Rice
   coded gaps, with a bitmap of those that the chunk itself met more than once.
2. Owners decode what they get and answer each chunk with a bitmap: which of its fingerprints occur elsewhere too.
3. Chunks' rows and the answers meet again by chunk; rows whose bit is set are suspects.
4. Only suspects' texts are shuffled: equal texts of a task collapse to one representative first, then the
   representatives of a SHA-256 are compared byte by byte.

Text rows without a partner never leave their task. A group of copies sends one representative for each task, however
many rows it has.

Defined cases: a null text counts as empty; a null id sorts after all others and stays only if its whole group has null
ids (keep_id is then null); rows repeated with the same id count as rows of their own and all carry that id, so that
`kept` is true for each of them; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import BROADCAST_ROWS, maybe_broadcast, partitions, table, written

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_MANY = re.compile(b"  +")
#: Bytes of distinct normalised text a task holds before it passes its representatives on.
HELD_BYTES = 64 << 20
#: Documents of a chunk; their digests meet in one task.
CHUNK_ROWS = 200_000


def normalised(text: str | None) -> bytes:
    """UTF-8 with each run of ASCII white space as one space."""
    out = (text or "").encode("utf-8", "surrogatepass").translate(_SPACES)
    return _MANY.sub(b" ", out) if b"  " in out else out


def golomb_encode(values: np.ndarray) -> bytes:
    """Golomb-Rice code of sorted distinct uint64: a byte for the parameter, then quotients in unary, then remainders."""
    gaps = np.diff(values, prepend=np.uint64(0))
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.69)))) if len(gaps) else 0
    k = min(k, 63)
    high, low = gaps >> np.uint64(k), gaps & np.uint64((1 << k) - 1)
    if len(gaps) and int(high.max()) > 1 << 20:  # one far value would make the unary part long
        k = min(63, k + int(high.max()).bit_length())
        high, low = gaps >> np.uint64(k), gaps & np.uint64((1 << k) - 1)
    ends = np.cumsum(high.astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    bits = ((low[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if k else np.zeros(0, np.uint8)
    return bytes([k]) + np.packbits(np.concatenate([unary, bits])).tobytes()


def golomb_decode(payload: bytes, n: int) -> np.ndarray:
    k = payload[0]
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, offset=1))
    ends = np.flatnonzero(bits[: len(bits) - n * k])[:n]
    if len(ends) < n:
        raise ValueError("Golomb payload is short")
    high = np.diff(ends, prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.zeros(n, np.uint64)
    if k and n:
        at = int(ends[-1]) + 1
        low = (bits[at : at + n * k].reshape(n, k).astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum((high << np.uint64(k)) | low, dtype=np.uint64)


def _scan(owners: int):
    """Rows of kind 0: a document each; of kind 1: what a chunk of CHUNK_ROWS documents sends to an owner."""
    step = np.uint64((1 << 64) // owners + 1)

    def sent(chunk: str, seen: list[np.ndarray]) -> pd.DataFrame:
        prints, counts = np.unique(np.concatenate(seen), return_counts=True)
        edges = np.searchsorted(prints, np.arange(owners + 1, dtype=np.uint64) * step) if owners > 1 else np.array([0, len(prints)])
        edges[-1] = len(prints)
        out = [(o, a, b) for o, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        return pd.DataFrame(
            {
                "kind": 1, "task": chunk, "id": None, "sha": None, "owner": [o for o, _, _ in out], "n": [int(b - a) for _, a, b in out],
                "gaps": [golomb_encode(prints[a:b]) for _, a, b in out], "own": [np.packbits(counts[a:b] > 1).tobytes() for _, a, b in out],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, seen = uuid.uuid4().hex, []
        for pdf in batches:
            digests = [hashlib.sha256(normalised(x)).digest() for x in pdf["text"]]
            seen.append(np.frombuffer(b"".join(x[:8] for x in digests), ">u8").astype(np.uint64))
            yield pd.DataFrame({"kind": 0, "task": chunk, "id": pdf["id"], "sha": digests, "owner": 0, "n": 0, "gaps": None, "own": None})
            if sum(map(len, seen)) >= CHUNK_ROWS:
                yield sent(chunk, seen)
                chunk, seen = uuid.uuid4().hex, []
        if seen:
            yield sent(chunk, seen)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's answers: for each message a bitmap of the fingerprints that are met more than once anywhere."""
    sent = [golomb_decode(x, n) for x, n in zip(pdf["gaps"], pdf["n"], strict=True)]
    own = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(pdf["own"], pdf["n"], strict=True)]
    values, back, counts = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    twice = counts > 1
    np.logical_or.at(twice, back, np.concatenate(own))
    bits = np.split(twice[back], np.cumsum(pdf["n"])[:-1])
    return pd.DataFrame({"task": pdf["task"], "owner": pdf["owner"], "n": pdf["n"], "bits": [np.packbits(x).tobytes() for x in bits]})


def _mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A task's rows with their bit: the answers, in the owners' order, line up with the task's sorted distinct fingerprints."""
    prints = np.frombuffer(b"".join(x[:8] for x in rows["sha"]), ">u8").astype(np.uint64)
    answers = answers.sort_values("owner")
    bits = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(answers["bits"], answers["n"], strict=True)]) if len(answers) else np.zeros(0, np.uint8)
    at = np.searchsorted(np.unique(prints), prints)
    return pd.DataFrame({"id": rows["id"], "sha": rows["sha"], "suspect": bits[at].astype(bool)})


def _lesser(a, b):
    """The smaller id; None comes after all others."""
    return b if a is None or b is not None and b < a else a


def _collapse(read):
    """Equal suspect texts of a task become one row: the digest, the smallest id, how many, and the bytes. read: ids from text."""

    def flush(held: dict[bytes, list]) -> pd.DataFrame:
        return pd.DataFrame({"sha": list(held), "id": [None if x[0] is None else str(x[0]) for x in held.values()], "n": [x[1] for x in held.values()], "body": [x[2] for x in held.values()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, list] = {}
        size = 0
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                body, i = normalised(text), None if i is None else read(i)
                got = held.get(key := hashlib.sha256(body).digest())
                if got is None:
                    held[key] = [i, 1, body]
                    size += len(body)
                else:
                    if got[2] != body:
                        raise ValueError("two texts share a SHA-256")
                    got[0], got[1] = _lesser(got[0], i), got[1] + 1
            if size > HELD_BYTES:
                yield flush(held)
                held, size = {}, 0
        if held:
            yield flush(held)

    return run


def _verify(read):
    """Representatives come sorted by digest; each is compared with the first of its digest. One text is held at a time."""

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(s, None if i is None else str(i), n) for s, i, n in out], columns=["sha", "keep_id", "group_size"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha, body, low, n = None, None, None, 0
        out: list[tuple] = []
        for pdf in batches:
            for s, i, k, b in zip(pdf["sha"], pdf["id"], pdf["n"], pdf["body"], strict=True):
                i = None if i is None else read(i)
                if s == sha:
                    if b != body:
                        raise ValueError("two texts share a SHA-256")
                    low, n = _lesser(low, i), n + k
                else:
                    if sha is not None:
                        out.append((sha, low, n))
                    sha, body, low, n = s, b, i, k
            if len(out) > 10_000:
                yield frame(out)
                out = []
        if sha is not None:
            out.append((sha, low, n))
        yield frame(out)

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """For each row: id, keep_id, group_size, kept, text_sha256 (hex, of the normalised text). See the module's text for odd cases."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    kind = "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else "string"
    rows = docs.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").alias("text"))
    owners = owners or max(64, partitions(spark))
    text_id = F.col("id").cast("string")  # pandas would turn a batch's integers with a null into floats
    read = int if kind == "bigint" else str
    scan = written(rows.withColumn("id", text_id).mapInPandas(_scan(owners), f"kind int, task string, id string, sha binary, owner int, n int, gaps binary, own binary"), "prints")
    hashes = scan.where("kind = 0").select("task", "id", "sha")
    answers = scan.where("kind = 1").select("owner", "task", "n", "gaps", "own").groupBy("owner").applyInPandas(_answer, "task string, owner int, n int, bits binary")
    marked = written(hashes.groupBy("task").cogroup(answers.groupBy("task")).applyInPandas(_mark, "id string, sha binary, suspect boolean").withColumn("id", F.col("id").cast(kind)), "marked")
    suspects = marked.where("suspect").select("id").distinct()
    n = suspects.count()
    same = rows.alias("r").join(maybe_broadcast(suspects, n).alias("s"), F.expr("r.id <=> s.id"), "left_semi").withColumn("id", text_id).mapInPandas(_collapse(read), "sha binary, id string, n long, body binary")
    groups = same.repartition("sha").sortWithinPartitions("sha").mapInPandas(_verify(read), "sha binary, keep_id string, group_size long").where("group_size > 1").withColumn("keep_id", F.col("keep_id").cast(kind))
    groups = written(groups, "groups")
    sure = maybe_broadcast(groups, groups.count()) if n <= BROADCAST_ROWS else groups
    dup = marked.where("suspect").join(sure, "sha", "left")
    single = marked.where("not suspect").select("sha", "id", F.lit(None).cast(kind).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return dup.select("sha", "id", "keep_id", "group_size").unionByName(single).select(
        F.col("id").alias(id_col),
        F.when(F.coalesce("group_size", F.lit(1)) > 1, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.coalesce("group_size", F.lit(1)) > 1, F.col("id").eqNullSafe(F.col("keep_id"))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
