"""What several operators share: reading tables, tables in the shared folder, text and array helpers."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side with at most this many rows of two or three numbers (some tens of MB) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 500_000
#: The same for sides with texts or lists.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = f"file://{tempfile.gettempdir()}/checkpoints/plumbline"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended already
            return


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_written(spark: SparkSession, path: str) -> None:
    _remove(spark, path)
    _made[:] = [x for x in _made if x[1] != path]


#: Whether Spark removes the shuffle files of a query when that ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def released(spark: SparkSession) -> None:
    """Shuffle files of what the driver reads are removed once it has collected the plans, which it may not do for long by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder, which survives lost executors."""
    path = shared_path(df.sparkSession, name)
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_alone(df: DataFrame, name: str) -> DataFrame:
    """A table written as by written(), of which nothing but the table stays: the shuffle files go when the write ends."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_enough(df: DataFrame, *wide: str) -> DataFrame:
    """A broadcast of df where its rows and the bytes of its wide columns allow it."""
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum((F.octet_length(c) for c in wide), F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


TYPES = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(arrow_type(name[6:-1]))
    return pa.map_(pa.string(), pa.float64()) if name == "map<string,double>" else TYPES[name]


def from_texts(df: DataFrame, make, fields: dict[str, str], text: str = "__text") -> DataFrame:
    """df without its text column and with the fields; make() is called once a task and gives a function from a batch's texts
    to a list for each field. The other columns stay in Arrow, so they come back as they were, 64-bit ids beside nulls too."""
    names = [n for n in df.columns if n != text]
    types = {n: arrow_type(t) for n, t in fields.items()}

    def run(batches):
        work = make()
        for batch in batches:
            found = work(batch.column(batch.schema.get_field_index(text)).to_pylist())
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[n], t) for n, t in types.items())], names=[*names, *types])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.select(*names).dtypes), *(f"{n} {t}" for n, t in fields.items())])
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def learns(doc_id: str, mod: int, held: int):
    """Whether a row may be learnt from: crc32 of the id as text, mod `mod`, is not `held`; a null id is never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod != held, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift), elementwise over uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs_of(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, concatenated."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int64) - np.repeat(ends - lengths, lengths)
