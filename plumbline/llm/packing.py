"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens in the order of its documents. Every window of `length` tokens is filled by a
round-robin over the queues: a queue gains its target share of the window as credit, spends whole tokens of it, and
carries the rest (its deficit) to the next window; tokens that no credit covers go to the queues with the largest
deficits, one each. A queue that runs dry leaves its share to the others.

The same rule deals at three levels, each with deficits carried from round to round. The driver deals the sources' totals to
tracts of TRACT_BLOCKS blocks (a number for each source and tract of 4 G tokens, which is broadcast); a task that cuts texts
deals a tract to its blocks when it comes to it, from the tract's totals; and each block is dealt to windows by one task. All
sizes are fixed, so a task holds a block (2 MB of ids) however large the input is. Deficits cross windows and partitions, and
a hot source is spread over all blocks. Only the last window of all can be short.

Documents are cut where a queue's turn ends. Positions in a queue come from running counts within each task and sums over
tasks, not from a global sort.

Defined cases: a null text is empty (its only id is the end id); a null source is a queue of its own; rows that share an
id are documents of their own; an empty table gives no pieces; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm._common import maybe_broadcast, table, written
from plumbline.llm.tokens import Tokens

LENGTH = 2048
END_ID = 1
#: Windows of a block, which one task holds, and blocks of a tract.
BLOCK_WINDOWS = 512
TRACT_BLOCKS = 4096


def deal(totals: np.ndarray, weights: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """Tokens of each queue (columns) in each round (rows) of `size` tokens, by deficit round-robin; the last round takes what is left."""
    left, credit = totals.astype(np.int64).copy(), np.zeros(len(totals))
    out = np.zeros((rounds, len(totals)), np.int64)
    for k in range(rounds):
        need = int(min(size, left.sum()))
        share = need
        while need > 0:
            active = left > 0
            w = np.where(active, weights, 0.0)
            credit += share * (w / w.sum() if w.sum() > 0 else active / active.sum())
            take = np.clip(np.floor(credit + 1e-9), 0, left).astype(np.int64)
            if (over := int(take.sum()) - need) > 0:  # credits carried from before add up to more than the round
                for s in np.argsort(credit - take, kind="stable"):
                    cut = min(over, int(take[s]))
                    take[s], over = take[s] - cut, over - cut
                    if not over:
                        break
            if not take.any():
                best = np.lexsort((np.arange(len(left)), -np.where(active, credit, -np.inf)))[: min(need, int(active.sum()))]
                take[best] = 1
            out[k] += take
            left -= take
            credit -= take
            need -= int(take.sum())
            share = 0 if (np.where(left > 0, credit, 0) >= 1).any() else max(0, need - int(active.sum()))
        credit[left == 0] = 0
    return out


def _tokenise(path: str | None, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, part, used = Tokens(path), TaskContext.get().partitionId(), {}
        for pdf in batches:
            for a in range(0, len(pdf), 1000):
                some = pdf.iloc[a : a + 1000]
                ids = [np.append(tokens.ids(x or ""), np.uint16(end_id)) for x in some["text"]]
                starts = []
                for s, x in zip(some["source"], ids, strict=True):
                    starts.append(used.get(s, 0))
                    used[s] = starts[-1] + len(x)
                yield pd.DataFrame({"part": part, "id": some["id"].to_numpy(), "source": some["source"].to_numpy(), "at": starts, "n": [len(x) for x in ids], "ids": [x.tobytes() for x in ids]})

    return run


def _before(rounds: np.ndarray) -> np.ndarray:
    """For each queue (rows) the tokens before each round, and after the last."""
    return np.concatenate([np.zeros((rounds.shape[1], 1), np.int64), np.cumsum(rounds, axis=0).T], axis=1)


def _cut(shipped, block: int, per: int):
    """shipped: the sources' numbers and the tokens of each source in each tract. A row of a document becomes one for each block that it reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, tracts = shipped.value
        edges, dealt = _before(tracts), {}

        def blocks(t: int) -> np.ndarray:
            if t not in dealt:
                if len(dealt) >= 8 + 2 * len(names):
                    dealt.clear()
                n = tracts[t]
                dealt[t] = _before(deal(n, n / n.sum(), block, -(-int(n.sum()) // block))) + edges[:, t : t + 1]
            return dealt[t]

        for pdf in batches:
            out = []
            for i, source, at, n, ids in zip(pdf["id"], pdf["source"], pdf["at"], pdf["n"], pdf["ids"], strict=True):
                s, done = names[source], 0
                while done < n:
                    t = int(np.searchsorted(edges[s], at + done, "right")) - 1
                    inner = blocks(t)[s]
                    b = int(np.searchsorted(inner, at + done, "right")) - 1
                    stop = min(n, int(inner[b + 1]) - at)
                    out.append((t * per + b, s, at + done, i, done, stop - done, n, ids[2 * done : 2 * stop]))
                    done = stop
            yield pd.DataFrame(out, columns=["block", "s", "at", "id", "start", "length", "n", "ids"])

    return run


def _fill(length: int, windows: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "at"], kind="stable")
        block = int(pdf["block"].iloc[0])
        sources, first = np.unique(pdf["s"].to_numpy(), return_index=True)
        lengths = pdf["length"].to_numpy()
        totals = np.add.reduceat(lengths, first)
        takes = deal(totals, totals / totals.sum(), length, -(-int(totals.sum()) // length))
        before = np.cumsum(takes, axis=1) - takes  # offset in the window of each source's part
        parts = []
        for k, (a, b) in enumerate(zip(first, [*first[1:], len(pdf)], strict=True)):
            rows = slice(a, b)
            ids = np.frombuffer(b"".join(pdf["ids"].iloc[rows]), np.uint16).astype("<u4")
            doc_end, turn_end = np.cumsum(lengths[rows]), np.cumsum(takes[:, k])
            ends = np.union1d(doc_end, turn_end[takes[:, k] > 0])
            begins = np.concatenate([[0], ends[:-1]])
            d, w = np.searchsorted(doc_end, ends, "left"), np.searchsorted(turn_end, ends, "left")
            raw = memoryview(ids).cast("B")
            parts.append(
                pd.DataFrame(
                    {
                        "id": pdf["id"].iloc[rows].to_numpy()[d], "start": pdf["start"].iloc[rows].to_numpy()[d] + begins - (doc_end - lengths[rows])[d], "length": ends - begins,
                        "ids_crc32": [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(begins.tolist(), ends.tolist(), strict=True)], "doc_tokens": pdf["n"].iloc[rows].to_numpy()[d],
                        "sequence_id": block * windows + w, "offset": before[w, k] + begins - (turn_end - takes[:, k])[w], "source": sources[k],
                    }
                )
            )
        return pd.concat(parts)

    return run


def packed(docs: DataFrame, length: int = LENGTH, mixture: dict[str, float] | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id") -> DataFrame:
    """Pieces of docs(id, text, source): id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_id.
    mixture: target weights of the sources; without it each source weighs as much as it has tokens, so that all queues end together."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("source"))
    tok = written(rows.mapInPandas(_tokenise(tokenizer, end_id), "part int, id string, source string, at long, n long, ids binary"), "tokens")
    sums = written(tok.groupBy("source", "part").agg(F.sum("n").alias("n")).select("source", "part", (F.sum("n").over(W.partitionBy("source").orderBy("part")) - F.col("n")).alias("base"), "n"), "sums")
    totals = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()
    names = {r["source"]: k for k, r in enumerate(totals)}
    n = np.array([r["n"] for r in totals], np.int64)
    weights = np.array([mixture.get(s[1:], 0.0) for s in names]) if mixture else n / max(1, n.sum())
    block = BLOCK_WINDOWS * length
    tracts = deal(n, weights, TRACT_BLOCKS * block, -(-int(n.sum()) // (TRACT_BLOCKS * block)))
    shipped = docs.sparkSession.sparkContext.broadcast((names, tracts))
    placed = tok.join(maybe_broadcast(sums.select("source", "part", "base"), sums.count()), ["source", "part"]).select("id", "source", (F.col("at") + F.col("base")).alias("at"), "n", "ids")
    pieces = placed.mapInPandas(_cut(shipped, block, TRACT_BLOCKS), "block long, s int, at long, id string, start long, length long, n long, ids binary")
    out = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source int"
    return pieces.groupBy("block").applyInPandas(_fill(length, BLOCK_WINDOWS), out).withColumn("id", F.col("id").cast(kind)).withColumnsRenamed({"id": id_col, "source": "source_id"})


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
