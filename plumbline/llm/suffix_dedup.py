"""Removal of repeated passages by run-length indexes.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id.

Distribution. Each window of `length` bytes is keyed by the least hash of its GRAM-byte substrings, so equal windows have
equal keys; neighbouring windows with one key form a context. A first exchange tells which keys more than one row has
(keys are sent to owners by hash range, once for a chunk where the chunk has them more often); documents without such a
key are done. Contexts of shared keys then go to the owner of their key, equal ones of a chunk once.

Index. An owner builds over the distinct contexts, in the order of their documents, the Burrows-Wheeler transform, and
keeps its runs with the suffix-array samples at the runs' first rows and at the rows before them (the last ones of the runs
before), and the common prefix lengths there (the irreducible ones). The suffix array itself is dropped. Matching statistics
are streamed from the samples along the text, with the position that each match leads to: where no run starts, the match is one
shorter than that of the position before and leads one position further. Positions that are chained by matches of at least
`length` are the occurrences of one string; those in documents after the first one's are marked.

Marks return to the chunk, are merged for each document, and the remaining bytes are hashed. A document whose whole text
occurs with a smaller id is marked as a whole, so that the index holds each text once.

Defined cases: a null text is empty; a row with a null id is never cut and cuts nothing; rows with the same id do not cut
each other; texts shorter than `length` stay; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import maybe_broadcast, mix, partitions, runs_of, table, written

LENGTH, GRAM = 50, 24
#: Bytes of text of a chunk, and of the blocks in which hashes are computed.
CHUNK, BLOCK = 12 << 20, 192 << 10
#: Bytes of contexts that are indexed together, up to twice as many where they have one key; an index takes about 80 times that.
INDEX_BYTES = 1 << 20
END = 0xF8  # this and the seven bytes above occur in no UTF-8
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def bytes_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def gram_hashes(b: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each `size`-byte substring, put together from halves."""
    by, have, n = _TABLE[b], {}, 1
    while n <= size:
        have[n] = by
        if 2 * n <= size:
            by = by[: len(by) - n] * np.uint64(pow(_BASE, n, 1 << 64)) + by[n:]
        n *= 2
    out, done = None, 0
    for n in sorted(have, reverse=True):
        while done + n <= size:
            part = have[n][done:]
            if out is None:
                out = part
            else:
                m = min(len(out), len(part))
                out = out[:m] * np.uint64(pow(_BASE, n, 1 << 64)) + part[:m]
            done += n
    return mix(out[: max(0, len(b) - size + 1)])


def window_keys(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The key of each window."""
    if len(b) < length:
        return np.zeros(0, np.uint64)
    h, w, n = gram_hashes(b, gram), length - gram + 1, 1
    while 2 * n <= w:
        h = np.minimum(h[: len(h) - n], h[n:])
        n *= 2
    return mix(np.minimum(h[: len(h) - (w - n)], h[w - n :]))  # least hashes are small; owners want even keys


def contexts(bodies: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key, of length - gram + 1 windows at most: document, key, first window, windows."""
    docs, keys, firsts, sizes, k = [], [], [], [], 0
    most = length - gram + 1
    while k < len(bodies):
        start, held = k, 0
        while k < len(bodies) and (k == start or held + len(bodies[k]) <= BLOCK):
            held += len(bodies[k])
            k += 1
        lengths = np.array([len(x) for x in bodies[start:k]], np.int64)
        key = window_keys(np.frombuffer(b"".join(bodies[start:k]), np.uint8), length, gram)
        if not len(key):
            continue
        begin, windows = np.cumsum(lengths) - lengths, np.maximum(lengths - length + 1, 0)
        at = np.repeat(begin, windows) + runs_of(windows)
        doc, key = np.repeat(np.arange(start, k), windows), key[at]
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        run = np.diff(first, append=len(key))
        if run.max() > most:  # periodic text
            pieces = -(-run // most)
            inner = runs_of(pieces)
            first = np.repeat(first, pieces) + inner * most
            run = np.minimum(most, np.repeat(run, pieces) - inner * most)
        docs.append(doc[first]), keys.append(key[first]), firsts.append(at[first] - begin[doc[first] - start]), sizes.append(run)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(docs, np.int64), join(keys, np.uint64), join(firsts, np.int64), join(sizes, np.int64)


def distinct_keys(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, key) in that order, and the number of each context among them."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    number = np.empty(len(d), np.int64)
    number[order] = np.cumsum(new) - 1
    return d[new], k[new], number


def _step(owners: int) -> int:
    return (1 << 64) // owners + 1


def _chunk_id(seq: int, ids: list, digests: list[bytes]) -> bytes:
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    return hashlib.blake2b(repr((part, seq, ids)).encode() + b"".join(digests), digest_size=16).digest()


def _five(x: np.ndarray, drop: int) -> bytes:
    return (x >> np.uint64(drop)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _send(owners: int, length: int, gram: int):
    step = _step(owners)
    drop = max(0, step.bit_length() - 40)

    def flush(ids: list, bodies: list[bytes], seq: int) -> pd.DataFrame:
        digests = [hashlib.sha256(x).digest() for x in bodies]
        chunk = _chunk_id(seq, ids, digests)
        doc, key, _, _ = contexts(bodies, length, gram)
        d, h, _ = distinct_keys(doc, key)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        local = np.zeros(len(h), bool)
        local[order[1:][same]] = True
        local[order[:-1][same]] = True
        rows = [(seq % owners, 0, chunk, 0, ids, digests, [len(x) for x in bodies], np.bincount(d, minlength=len(ids)).tolist(), np.packbits(local).tobytes(), None, None, None)]
        once, od, more = h[~local], d[~local], np.unique(h[local])
        bucket, more_bucket = (once // np.uint64(step)).astype(np.int32), (more // np.uint64(step)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        once, od, bucket = once[by], od[by], bucket[by]
        counts = np.bincount(bucket * len(ids) + od, minlength=owners * len(ids)).reshape(owners, len(ids)).astype("<u4")
        edge, more_edge = np.searchsorted(bucket, np.arange(owners + 1)), np.searchsorted(more_bucket, np.arange(owners + 1))
        for b in range(owners):
            x, y = once[edge[b] : edge[b + 1]], more[more_edge[b] : more_edge[b + 1]]
            if len(x) or len(y):
                base = np.uint64(b * step)
                rows.append((b, 1, chunk, b, None, None, None, None, None, counts[b].tobytes(), _five(x - base, drop), _five(y - base, drop)))
        return pd.DataFrame(rows, columns=["owner", "kind", "chunk", "b", "ids", "digests", "lengths", "sizes", "own", "counts", "once", "more"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, bodies, held, seq = [], [], 0, 0
        for pdf in batches:
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                ids.append(i)
                bodies.append(bytes_of(text))
                held += len(bodies[-1])
                if held >= CHUNK or len(ids) >= 20_000:
                    yield flush(ids, bodies, seq)
                    ids, bodies, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush(ids, bodies, seq)

    return run


_LISTS = ["kind", "chunk", "b", "ids", "digests", "lengths", "sizes", "own", "counts", "bits"]


def _own(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's answers: a bitmap of the keys that another chunk has too. Lists of documents pass through."""
    sent = pdf[pdf["kind"] == 1]
    out = [pdf[pdf["kind"] == 0].assign(bits=None)[_LISTS]]
    if len(sent):

        def wide(payload: bytes) -> np.ndarray:
            raw = np.frombuffer(payload, np.uint8).reshape(-1, 5)
            full = np.zeros((len(raw), 8), np.uint8)
            full[:, :5] = raw
            return full.view("<u8").ravel()

        once, more = [wide(x) for x in sent["once"]], [wide(x) for x in sent["more"]]
        values = np.concatenate(once + more)
        order = np.argsort(values, kind="stable")
        same = values[order][1:] == values[order][:-1]
        twice = np.zeros(len(values), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cut = np.cumsum([0, *map(len, once)])
        bits = [np.packbits(twice[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        out.append(pd.DataFrame({"kind": 1, "chunk": sent["chunk"].to_numpy(), "b": sent["b"].to_numpy(), "counts": sent["counts"].to_numpy(), "bits": bits}).reindex(columns=_LISTS).astype(object).where(lambda x: x.notna(), None))
    return pd.concat(out)


def _judge(pdf: pd.DataFrame) -> pd.DataFrame:
    lists, answers = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1].sort_values("b")
    if len(lists) != 1:
        raise ValueError("a chunk was sent twice with other rows; the input must give the same rows when it is read again")
    doc = lists.iloc[0]
    sizes = np.asarray(doc["sizes"], np.int64)
    mask = np.unpackbits(np.frombuffer(doc["own"], np.uint8), count=int(sizes.sum())).astype(bool)
    where = np.flatnonzero(~mask)
    if len(answers):
        counts = np.stack([np.frombuffer(x, "<u4") for x in answers["counts"]]).astype(np.int64)
        flat = counts.T.ravel()
        starts = (np.cumsum(flat) - flat).reshape(counts.T.shape)
        for k, raw in enumerate(answers["bits"]):
            n = counts[k]
            bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(n.sum())).astype(bool)
            mask[where[(np.repeat(starts[:, k], n) + runs_of(n))[bits]]] = True
    parts = np.split(mask, np.cumsum(sizes)[:-1])
    return pd.DataFrame({"id": doc["ids"], "digest": doc["digests"], "n_bytes": doc["lengths"], "shared": [int(x.sum()) for x in parts], "mask": [np.packbits(x).tobytes() if x.any() else None for x in parts]})


# ---------------------------------------------------------------- contexts to owners


def _pack(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(x := a.tobytes() if isinstance(a, np.ndarray) else a).to_bytes(8, "little") + x for a in arrays))


def _unpack(raw: bytes, kinds: tuple[str, ...]) -> list:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n] if kind == "b" else np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _ship(owners: int, length: int, gram: int):
    step = _step(owners)

    def flush(ids: list, digests: list[bytes], bodies: list[bytes], masks: list[bytes], seq: int) -> pd.DataFrame:
        chunk = _chunk_id(seq, ids, digests)
        doc, key, first, windows = contexts(bodies, length, gram)
        d, _, number = distinct_keys(doc, key)
        sizes = np.bincount(d, minlength=len(ids))
        shared = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=int(n)) for m, n in zip(masks, sizes, strict=True)]).astype(bool) if len(d) else np.zeros(0, bool)
        keep = shared[number]
        doc, key, first, windows = doc[keep], key[keep], first[keep], windows[keep]
        size = windows + length - 1
        seen: dict[bytes, int] = {}
        send = np.ones(len(doc), bool)
        blob = []
        for k, (x, a, n) in enumerate(zip(doc.tolist(), first.tolist(), size.tolist(), strict=True)):
            c = bodies[x][a : a + n]
            if ids[seen.setdefault(c, x)] < ids[x]:  # rows come in the order of their ids: a smaller one of this chunk has it all
                send[k] = False
            else:
                blob.append(c)
        marks = _pack(doc[~send].astype("<u4"), first[~send].astype("<u4"), (first + size)[~send].astype("<u4"))
        rows = [(seq % owners, 0, chunk, ids, digests, marks)]
        doc, key, first, size = doc[send], key[send], first[send], size[send]
        bucket = (key // np.uint64(step)).astype(np.int32)
        by = np.argsort(bucket, kind="stable")
        edge = np.searchsorted(bucket[by], np.arange(owners + 1))
        ranks = np.array(ids, object)
        for b in range(owners):
            at = by[edge[b] : edge[b + 1]]
            if len(at):
                local, back = np.unique(doc[at], return_inverse=True)
                rows.append((b, 1, chunk, ranks[local].tolist(), None, _pack(local.astype("<u4"), back.astype("<u4"), first[at].astype("<u4"), size[at].astype("<u4"), (key[at] & np.uint64(0xFFFF)).astype("<u2"), b"".join([blob[k] for k in at.tolist()]))))
        return pd.DataFrame(rows, columns=["owner", "kind", "chunk", "ids", "digests", "payload"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, seq = [], 0, 0
        for pdf in batches:
            for i, digest, text, mask in zip(pdf["id"], pdf["digest"], pdf["text"], pdf["mask"], strict=True):
                body = bytes_of(text)
                if hashlib.sha256(body).digest() != digest or held and held[-1][0] == i and held[-1][1] == digest:
                    continue  # another row with this id
                held.append((i, digest, body, mask))
                size += len(body)
                if size >= CHUNK or len(held) >= 20_000:
                    yield flush(*map(list, zip(*held, strict=True)), seq)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush(*map(list, zip(*held, strict=True)), seq)

    return run


# ---------------------------------------------------------------- the index


class RunLengthIndex:
    """Burrows-Wheeler transform of texts in runs, with samples at the runs' first rows. Each text ends in a mark of its
    own, its number in eights, so that no match goes on from text to text."""

    def __init__(self, texts: list[bytes]):
        self.mark = max(1, -(-len(texts).bit_length() // 3))
        marks = (END + ((np.arange(len(texts))[:, None] >> (3 * np.arange(self.mark)[::-1])) & 7)).astype(np.uint8).tobytes()
        ended = np.frombuffer(b"".join(x + marks[k * self.mark : (k + 1) * self.mark] for k, x in enumerate(texts)), np.uint8)
        self.n, self.longest = len(ended), max(map(len, texts)) + 2 * self.mark
        self.words = self._words(ended)
        sa = self._suffixes(self.longest)
        bwt = ended[sa - 1].astype(np.int16)
        bwt[sa == 0] = -1  # nothing stands before the first text
        heads = np.ones(self.n, bool)
        heads[1:] = bwt[1:] != bwt[:-1]
        rows = np.flatnonzero(heads)  # runs: samples at first rows and before, common prefix lengths
        self.samples = sa[rows]
        self.before = sa[rows - 1]
        self.lengths = self._common(self.samples, self.before)
        self.lengths[0] = 0
        self.last = int(sa[-1])

    def _words(self, b: np.ndarray) -> np.ndarray:
        """The eight bytes from each position on, big-endian."""
        out = np.concatenate([b, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
        for k in (1, 2, 4):
            out = (out[: len(out) - k] << np.uint64(8 * k)) | out[k:]
        return out[: len(b)]

    def _suffixes(self, depth: int) -> np.ndarray:
        """Suffixes in order, by doubling; the texts' own ends make them differ within `depth` bytes."""
        rank, have = None, 8
        order = np.argsort(self.words)
        key = self.words
        while True:
            ranked = key[order]
            new = np.zeros(self.n, np.uint64)
            new[1:] = ranked[1:] != ranked[:-1]
            rank = np.empty(self.n, np.uint64)
            rank[order] = np.cumsum(new)
            if have >= depth or int(rank[order[-1]]) == self.n - 1:
                return order
            step = min(have, depth - have)
            key = rank << np.uint64(32)
            key[: self.n - step] |= rank[step:] + np.uint64(1)
            order = np.argsort(key)
            have += step

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths, up to `longest`."""
        out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        while len(open_):
            x, y = i[open_] + out[open_], j[open_] + out[open_]
            inside = (x < self.n) & (y < self.n)
            diff = self.words[np.minimum(x, self.n - 1)] ^ self.words[np.minimum(y, self.n - 1)]
            same = np.where(diff == 0, 8, 0)
            for k in range(1, 8):
                same = np.where((diff != 0) & (diff >> np.uint64(64 - 8 * k) == 0), k, same)
            same[~inside] = 0
            out[open_] += same
            open_ = open_[(same == 8) & (out[open_] < self.longest)]
        return np.minimum(np.minimum(out, self.longest), self.n - np.maximum(i, j))

    def _sampled(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the run that starts at it or, else, at the last position before it, and how far before."""
        at = np.full(self.n, -1, np.int64)
        at[self.samples] = np.arange(self.n)[self.samples]
        where = np.maximum.accumulate(at)
        run = np.empty(self.n, np.int64)
        run[self.samples] = np.arange(len(self.samples))
        return np.where(where >= 0, run[where], -1), np.arange(self.n) - where

    def matches(self) -> tuple[np.ndarray, np.ndarray]:
        """For each position the longest match with the row before its own, and the position of that row."""
        run, far = self._sampled()
        head = run >= 0
        return np.where(head, np.maximum(self.lengths[run] - far, 0), 0), np.where(head, self.before[run] + far, -1)

    def statistics(self) -> np.ndarray:
        return self.matches()[0]

    @property
    def sa(self) -> np.ndarray:
        """The rows, from the last one back by the samples."""
        back, out, p = self.matches()[1], np.empty(self.n, np.int64), self.last
        for k in range(self.n - 1, -1, -1):
            out[k], p = p, int(back[p])
        return out


def marked_windows(texts: list[bytes], rank: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether each window of each text, in order, also occurs in a text with a smaller rank."""
    sizes = np.array([len(x) for x in texts], np.int64)
    index = RunLengthIndex(texts)
    full = sizes + index.mark
    left = np.maximum(np.repeat(np.cumsum(full) - index.mark, full) - np.arange(index.n), 0)
    match, back = index.matches()
    first = np.where(np.minimum(match, left) >= length, back, np.arange(index.n))
    while not np.array_equal(further := first[first], first):  # to the first row of each string's occurrences
        first = further
    whose = np.repeat(rank, full)
    least = np.full(index.n, np.iinfo(whose.dtype).max, whose.dtype)
    np.minimum.at(least, first, whose)
    least = least[first]
    return ((least < whose) & (left >= length))[left >= length]


def _marks(at: np.ndarray, blobs: list[bytes], source, place, owner, first, size, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the contexts `at`: which, from and to where in its document, is repeated. Equal contexts are indexed once, for the first document."""
    if not len(at):
        return at, at, at
    number: dict[bytes, int] = {}
    which = np.fromiter((number.setdefault(blobs[s][p : p + n], len(number)) for s, p, n in zip(source[at].tolist(), place[at].tolist(), size[at].tolist(), strict=True)), np.int64, len(at))
    low = np.full(len(number), owner[at].max(), np.int64)
    np.minimum.at(low, which, owner[at])
    texts, order = list(number), np.argsort(low, kind="stable")
    windows = marked_windows([texts[k] for k in order.tolist()], low[order], length)
    counts = np.array([len(texts[k]) - length + 1 for k in order.tolist()], np.int64)
    begin = np.empty(len(order), np.int64)
    begin[order] = np.cumsum(counts) - counts
    later = owner[at] > low[which]
    whole, some, own = at[later], at[~later], which[~later]
    n = size[some] - length + 1
    hit = windows[np.repeat(begin[own], n) + runs_of(n)]
    inner, occ = runs_of(n)[hit], np.repeat(some, n)[hit]
    new = np.ones(len(inner), bool)
    new[1:] = (occ[1:] != occ[:-1]) | (inner[1:] != inner[:-1] + 1)
    last = np.append(new[1:], True) if len(new) else new
    return np.concatenate([whole, occ[new]]), np.concatenate([first[whole], first[occ[new]] + inner[new]]), np.concatenate([(first + size)[whole], first[occ[last]] + inner[last] + length])


def _repeated(at: dict[str, np.ndarray], blobs: list[bytes], length: int, gram: int) -> list[tuple[np.ndarray, ...]]:
    """source, local, start, end of what is repeated in the contexts `at`. Equal keys have equal parts, so parts of the keys
    are indexed one after the other. Where one key has more than two indexes would hold, its contexts are cut anew by keys of
    longer grams, down to single windows; equal windows stay together."""
    share, found = 1 + int(at["size"].sum()) // INDEX_BYTES, []
    for k in range(share):
        some = {name: x[at["key"] % share == k] for name, x in at.items()}
        if gram < length and some["size"].sum() > 2 * INDEX_BYTES:
            longer = (gram + length + 1) // 2
            bodies = [blobs[s][p : p + n] for s, p, n in zip(some["source"].tolist(), some["place"].tolist(), some["size"].tolist(), strict=True)]
            of, key, first, windows = contexts(bodies, length, longer)
            finer = {name: x[of] for name, x in some.items()}
            finer |= {"place": finer["place"] + first, "first": finer["first"] + first, "size": windows + length - 1, "key": (key >> np.uint64(8)).astype(np.int64)}
            found += _repeated(finer, blobs, length, longer)
        else:
            o, a, b = _marks(np.arange(len(some["size"])), blobs, *(some[name] for name in ("source", "place", "owner", "first", "size")), length)
            found.append((some["source"][o], some["local"][o], a, b))
    return found


def _match(length: int, gram: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists, sent = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        columns = ["kind", "chunk", "ids", "digests", "payload"]
        out = [lists[columns]]
        if len(sent):
            parts = [_unpack(x, ("<u4", "<u4", "<u4", "<u4", "<u2", "b")) for x in sent["payload"]]
            ranks = np.unique(np.array([i for x in sent["ids"] for i in x], object))
            known = {i: k for k, i in enumerate(ranks.tolist())}
            at = {name: np.concatenate([p[k].astype(np.int64) for p in parts]) for name, k in (("first", 2), ("size", 3), ("key", 4))}
            at["owner"] = np.concatenate([np.array([known[i] for i in ids], np.int64)[p[1]] for p, ids in zip(parts, sent["ids"], strict=True)])
            at["local"] = np.concatenate([p[0][p[1]] for p in parts]).astype(np.int64)
            at["source"] = np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts])
            at["place"] = np.concatenate([np.cumsum(p[3].astype(np.int64)) - p[3] for p in parts])
            source, local, a, b = (np.concatenate(x) for x in zip(*_repeated(at, [p[5] for p in parts], length, gram), strict=True))
            by = np.argsort(source, kind="stable")
            edge = np.searchsorted(source[by], np.arange(len(sent) + 1))
            rows = []
            for k, chunk in enumerate(sent["chunk"]):
                x = by[edge[k] : edge[k + 1]]
                if len(x):
                    rows.append((1, chunk, None, None, _pack(local[x].astype("<u4"), a[x].astype("<u4"), b[x].astype("<u4"))))
            out.append(pd.DataFrame(rows, columns=columns))
        return pd.concat(out)

    return run


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of sorted intervals."""
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    return starts[new], reach[np.append(new[1:], True)]


def _gather(pdf: pd.DataFrame) -> pd.DataFrame:
    lists = pdf[pdf["kind"] == 0]
    if len(lists) != 1:
        raise ValueError("a chunk was sent twice with other rows; the input must give the same rows when it is read again")
    doc, start, end = (np.concatenate(x).astype(np.int64) for x in zip(*(_unpack(p, ("<u4", "<u4", "<u4")) for p in pdf["payload"]), strict=True))
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    out, edge = [], np.searchsorted(doc, np.arange(len(lists.iloc[0]["ids"]) + 1))
    for k, (i, digest) in enumerate(zip(lists.iloc[0]["ids"], lists.iloc[0]["digests"], strict=True)):
        if edge[k + 1] > edge[k]:
            a, b = merged(start[edge[k] : edge[k + 1]], end[edge[k] : edge[k + 1]])
            out.append((i, digest, a.tolist(), b.tolist()))
    return pd.DataFrame(out, columns=["id", "digest", "starts", "ends"])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for text, digest, a, b in zip(pdf["text"], pdf["digest"], pdf["starts"], pdf["ends"], strict=True):
            body = bytes_of(text)
            if hashlib.sha256(body).digest() == digest:
                kept = b"".join(body[x:y] for x, y in zip([0, *b], [*a, len(body)], strict=True))
                out.append((digest, int(np.sum(np.asarray(b) - np.asarray(a))), len(a), hashlib.sha256(kept).digest()))
        yield pd.DataFrame(out, columns=["digest", "n_removed", "n_spans", "kept"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(known, spans). known: id, digest, n_bytes of all rows with an id; spans: id, digest, starts, ends (bytes) of the distinct
    texts that lose some; where equal texts have several ids, spans are those of the smallest."""
    spark = docs.sparkSession
    kind, gram = dict(docs.dtypes)[id_col], min(GRAM, length)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    owners = max(64, partitions(spark))
    lists = f"kind int, chunk binary, b int, ids array<{kind}>, digests array<binary>, lengths array<long>, sizes array<int>, own binary"
    sent = rows.mapInPandas(_send(owners, length, gram), f"owner int, {lists}, counts binary, once binary, more binary")
    answers = sent.groupBy("owner").applyInPandas(_own, f"{lists}, counts binary, bits binary")
    known = written(answers.groupBy("chunk").applyInPandas(_judge, f"id {kind}, digest binary, n_bytes long, shared int, mask binary"), "keys")
    heads = known.where("shared > 0").groupBy("digest").agg(F.min(F.struct("id", "mask")).alias("h")).select("h.id", "digest", "h.mask")
    texts = rows.join(heads, "id").select("id", "digest", "text", "mask").sortWithinPartitions("id", "digest")
    shipped = texts.mapInPandas(_ship(owners, length, gram), f"owner int, kind int, chunk binary, ids array<{kind}>, digests array<binary>, payload binary")
    marks = shipped.groupBy("owner").applyInPandas(_match(length, gram), f"kind int, chunk binary, ids array<{kind}>, digests array<binary>, payload binary")
    spans = marks.groupBy("chunk").applyInPandas(_gather, f"id {kind}, digest binary, starts array<long>, ends array<long>")
    return known, written(spans, "spans")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """For each row: id, n_bytes, n_removed, n_spans, kept_sha256."""
    known, spans = repeated_spans(docs, id_col, text_col, length)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    cut = rows.join(spans, "id").select("text", "digest", "starts", "ends").mapInPandas(_cut, "digest binary, n_removed long, n_spans long, kept binary")
    cut = written(cut.dropDuplicates(["digest"]), "cut")
    copies = written(known.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("digest", "low"), "copies")
    out = known.select("id", "digest", "n_bytes").join(maybe_broadcast(copies, copies.count()), "digest", "left")
    first = out.where("low is null or id = low").join(cut, "digest", "left").select("id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept", "digest").alias("kept"))
    later = out.where("low is not null and id <> low").select("id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).alias("n_spans"), F.unhex(F.sha2(F.lit(""), 256)).alias("kept"))
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    other = rows.where("id is null").select("id", F.octet_length(body).cast("long").alias("n_bytes"), F.lit(0).alias("n_removed"), F.lit(0).alias("n_spans"), F.unhex(F.sha2(body, 256)).alias("kept"))
    return first.unionByName(later).unionByName(other).select(
        F.col("id").alias(id_col), "n_bytes", F.col("n_removed").cast("long").alias("n_removed"), F.col("n_spans").cast("long").alias("n_spans"), F.lower(F.hex("kept")).alias("kept_sha256")
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))
