"""Deterministic sharded WARC writer and reader.

Rows are sorted by id and payload digest over ranges, and each range is written by one task as gzip members of one record each.
The ranges' bounds are quantiles of the rows whose hash is 0 modulo a number that their count and the number of shards give, so
they depend on the rows alone, and equal ids with different payloads may fall in several ranges. A range rolls to the next file
when the compressed size passes a limit. Headers and digests are made anew from id, url and payload, so the same rows give
the same files. Files are written under temporary names, and their names come back as a table, one row a file; when all
tasks have succeeded, tasks rename the files of that table (a repeated attempt finds them renamed), and the manifest is
written last. What a lost or repeated task attempt left has no row and is removed. A folder without manifest isn't an archive.

Payloads that occur more than once are written once: the row with the smallest id is a response, the others revisit it.

Defined cases: a null payload is empty and a null url is `urn:none`; a row with a null id sorts first, is always a
response and is never revisited; rows repeated with one id are records of their own (all responses where that id is the
smallest of its payload); an empty table gives an archive without files; other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import partitions, shared_path, table, written

#: Compressed bytes after which a file is closed.
ROLL_BYTES = 64 << 20
#: Payloads shorter than this are always responses.
MIN_REVISIT_BYTES = 0
#: Rows a shard from which the ranges' bounds are taken.
SAMPLE = 50
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _fs(path: str):
    """The file system of a path and the path within it: any store that Arrow knows by its scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = sha1_base32(payload)
    http = HTTP if refers_to is not None else HTTP + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or 'urn:none', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(http)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, f'{refers_to}:{digest}')}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _writer(folder: str, roll: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        part, attempt = None, uuid.uuid4().hex
        out, rows, info, marks, files = None, [], {}, (None, {}), 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                rows.append(dict(info, sha256=info["sha256"].hexdigest()))
                out = None

        for pdf in batches:
            for at, kind, page_id, url, html, sha, refers in zip(*(pdf[c] for c in ("range", "kind", "page_id", "url", "html", "sha", "refers_to")), strict=True):
                page_id = None if page_id is None else int(page_id)
                if at != part:
                    close()
                    part, files = at, 0
                if kind == 0:
                    marks = (page_id, (marks[1] if marks[0] == page_id else {}) | {sha: int(refers)})
                    continue
                payload = html.encode("utf-8", "surrogatepass")
                refers = marks[1].get(sha) if page_id is not None and marks[0] == page_id else None
                if out is None:
                    final, files = f"part-{part:06d}-{files:05d}.warc.gz", files + 1
                    info = {"temp": f".tmp-{attempt}-{final}", "name": final, "records": 0, "bytes": 0, "sha256": hashlib.sha256()}
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{info['temp']}", compression=None)
                data = _gzip(record(page_id, url, payload, refers))
                out.write(data)
                info["records"] += 1
                info["bytes"] += len(data)
                info["sha256"].update(data)
                if info["bytes"] >= roll:
                    close()
        close()
        yield pd.DataFrame(rows, columns=["temp", "name", "records", "bytes", "sha256"])

    return run


def _digests(pages: DataFrame) -> DataFrame:
    """page_id, sha and size of each payload of pages(page_id, html)."""
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    return pages.select("page_id", F.sha2(body, 256).alias("sha"), F.octet_length(body).alias("size"))


def revisits(digests: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, sha, refers_to of the rows of digests(page_id, sha, size) whose payload a smaller id has too. They are summed up
    by each task before they are shuffled."""
    ids = digests.where("page_id is not null").where(F.col("size") >= min_bytes).select("page_id", "sha")
    groups = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("sha", "refers_to")
    return ids.join(groups, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to").distinct()


def _keys(ids, shas) -> np.ndarray:
    """Sixteen bytes that sort as (id, first half of the digest); null ids come first."""
    out = np.zeros((len(ids), 2), ">u8")
    out[:, 0] = np.asarray(ids, np.int64).astype(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1] = [int(x[:16], 16) for x in shas]
    return np.frombuffer(out.tobytes(), "S16")


def _range_of(digests: DataFrame, shards: int):
    """A function of id and digest: the number of the range. Some SAMPLE rows a shard come to the driver."""
    every = max(1, digests.count() // (SAMPLE * shards))
    some = digests.where("page_id is not null").where(F.pmod(F.xxhash64("page_id", "sha"), F.lit(every)) == 0).select("page_id", "sha").collect()
    keys = np.sort(_keys([x["page_id"] for x in some], [x["sha"] for x in some]))
    bounds = np.unique(keys[np.arange(1, shards) * len(keys) // shards]) if len(keys) else keys

    @F.pandas_udf("int")
    def number(ids: pd.Series, shas: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, _keys(ids, shas), "right").astype(np.int32))

    return lambda i, sha: F.when(i.isNull(), F.lit(0)).otherwise(number(F.coalesce(i.cast("long"), F.lit(-(1 << 63))), sha))


def _rename(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        for pdf in batches:
            for temp, name in zip(pdf["temp"], pdf["name"], strict=True):
                if fs.get_file_info(f"{base}/{temp}").is_file:
                    fs.move(f"{base}/{temp}", f"{base}/{name}")
                elif not fs.get_file_info(f"{base}/{name}").is_file:
                    raise FileNotFoundError(f"{base}/{temp}")
            yield pdf[["name"]]

    return run


def write_archive(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shards: int | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> list[dict]:
    """Write pages(page_id, url, html) to a new folder; returns the manifest, an entry a file. Which rows revisit others
    travels as rows of its own in the range sort, so that payloads are shuffled once."""
    spark, shards = pages.sparkSession, shards or partitions(pages.sparkSession)
    digests = written(_digests(pages), "digests")
    number = _range_of(digests, shards)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.lit(1).alias("kind"), "page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("sha"), F.lit(None).cast("string").alias("refers_to"))
    marks = revisits(digests, min_bytes).select(F.lit(0).alias("kind"), "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "sha", F.col("refers_to").cast("string").alias("refers_to"))
    ranged = rows.unionByName(marks).withColumn("range", number(F.col("page_id"), F.col("sha"))).repartitionById(shards, F.col("range")).sortWithinPartitions("range", "page_id", "sha", "kind", "url")
    ranged = ranged.withColumn("page_id", F.col("page_id").cast("string"))  # pandas would turn a batch's integers with a null into floats
    made = written(ranged.mapInPandas(_writer(folder, roll), "temp string, name string, records long, bytes long, sha256 string"), "files")
    made.repartition(shards).mapInPandas(_rename(folder), "name string").count()
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    from pyarrow.fs import FileSelector

    for f in fs.get_file_info(FileSelector(base)):
        if f.base_name.startswith(".tmp-"):
            fs.delete_file(f.path)
    manifest = [r.asDict() for r in made.select("name", "records", "bytes", "sha256").orderBy("name").collect()]
    with fs.open_output_stream(f"{base}/.tmp-manifest") as f:
        f.write(json.dumps(manifest).encode())
    fs.move(f"{base}/.tmp-manifest", f"{base}/manifest.json")
    return manifest


def records_in(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    z, got, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(chunk)
        if not data:
            break
        got.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(got)
            z, got = zlib.decompressobj(31), []
    if got:
        raise ValueError("the archive ends within a record")


def parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    named = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(named["Content-Length"])]
    if f"sha1:{sha1_base32(block)}" != named["WARC-Block-Digest"]:
        raise ValueError("block digest differs")
    payload, revisit = block.partition(b"\r\n\r\n")[2], named["WARC-Type"] == "revisit"
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest != sha1_base32(payload):
        raise ValueError("payload digest differs")
    return {
        "page_id": int(named["X-Page-ID"]) if "X-Page-ID" in named else None, "url": unquote(named["WARC-Target-URI"]), "payload_bytes": int(named["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": digest, "record_type": named["WARC-Type"], "refers_to": int(named["X-Refers-To-Page-ID"]) if revisit else None, "payload": None if revisit else payload,
    }


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _fs(folder)
        for pdf in batches:
            for name, n in zip(pdf["name"], pdf["records"], strict=True):
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for raw in records_in(f):
                        rows.append(parsed(raw))
                        seen, size = seen + 1, size + len(raw)
                        if not payloads:
                            rows[-1].pop("payload")
                        if len(rows) >= 5000 or payloads and size > 16 << 20:
                            yield _frame(rows)
                            rows, size = [], 0
                if seen != n:
                    raise ValueError(f"{name} has {seen} records, its manifest says {n}")
                if rows:
                    yield _frame(rows)

    return run


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, dtype=object)


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row for each record of the files in the manifest, a task for each file."""
    fs, base = _fs(folder)
    with fs.open_input_stream(f"{base}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    files = spark.createDataFrame([(x["name"], x["records"]) for x in manifest], "name string, records long").repartition(max(1, len(manifest)))
    return files.mapInPandas(_reader(folder, payloads), schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), folder)
    return read_archive(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SQL has SHA-1 as hex only; base32 is taken from its bits, five at a time.
OP7_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, list_reduce(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (((('0x' || substr(h, (i * 5 // 8) * 2 + 1, 2))::INTEGER * 256 + (CASE WHEN i * 5 // 8 < 19 THEN '0x' || substr(h, (i * 5 // 8) * 2 + 3, 2) ELSE '0' END)::INTEGER)
        >> (11 - (i * 5) % 8)) & 31)::INTEGER + 1, 1)), lambda x, y: x || y) AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       nullif(min(page_id) OVER w, page_id) AS refers_to
FROM b WINDOW w AS (PARTITION BY h, payload_bytes)
"""
