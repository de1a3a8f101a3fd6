"""Reproducible samples and subsets of nested data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_by_digest(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def stratified(df: DataFrame, stratum: str, key: str, n: int | dict[str, int], seed: int = 0, strict: bool = False) -> DataFrame:
    """n rows of each stratum (or as many as a dictionary says), chosen by a seeded digest of the key. strict: a stratum with
    fewer rows is an error when the result is read."""
    rank = F.row_number().over(W.partitionBy(stratum).orderBy(*order_by_digest(key, seed)))
    largest = n if isinstance(n, int) else max(n.values(), default=0)
    out = df.withColumn("_rank", rank).where(F.col("_rank") <= largest)  # a literal bound: each task keeps so many of a stratum before rows are shuffled
    most = F.lit(n) if isinstance(n, int) else F.coalesce(F.create_map(*[F.lit(x) for pair in n.items() for x in pair])[F.col(stratum)], F.lit(0))
    if not isinstance(n, int):
        out = out.where(F.col("_rank") <= most)
    if strict:  # sizes are summed up by task
        few = df.groupBy(F.col(stratum).alias("_stratum")).agg(F.count("*").alias("_size"))
        out = out.join(F.broadcast(few) if not isinstance(n, int) else few, F.col(stratum).eqNullSafe(F.col("_stratum")))
        enough = F.when(F.col("_size") < most, F.raise_error(F.concat(F.lit("too few rows of "), F.coalesce(F.col(stratum).cast("string"), F.lit("null")))).cast("boolean")).otherwise(F.lit(True))
        out = out.where(enough).drop("_stratum", "_size")
    return out.drop("_rank")


def positions(df: DataFrame, columns: list[str], name: str = "position", parts: int = 64, sample: int = 100) -> DataFrame:
    """The place of each row, from 1, in the order of columns that tell all rows apart. Bounds of parts come from the rows whose
    digest is 0 modulo a number that the count of rows gives (sample rows a part, about); rows are numbered within parts,
    which other tasks do, and the sizes of the parts before are added."""
    every = max(1, df.count() // (parts * sample))
    chosen = df.where(F.pmod(F.xxhash64(*columns), F.lit(every)) == 0).select(F.struct(*columns).alias("k")).orderBy("k").collect() if every > 1 else []
    types = df.select(F.struct(*columns).alias("k")).schema["k"].dataType
    bounds = [r["k"] for r in chosen[len(chosen) // parts :: max(1, len(chosen) // parts)]]
    key = F.struct(*columns)
    edge = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, types.fields, strict=True)]) for b in bounds]) if bounds else None
    part = F.size(F.filter(edge, lambda b: b <= key)) if bounds else F.lit(0)
    rows = df.withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a part
    inner = F.row_number().over(W.partitionBy("_part").orderBy(*columns))
    return rows.withColumn("_in", inner).join(F.broadcast(before), "_part").withColumn(name, (F.col("_in") + F.col("_before")).cast("int")).drop("_part", "_in", "_before")


def share_of(total: int, percent: float) -> int:
    """Rows of a stratum for a percentage of a training set, a hundredth of it each."""
    return round(0.01 * percent * total)


def subset(flat: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return flat.join(ids.select(key).distinct(), key, "left_semi")


def subset_nested(df: DataFrame, items: str, key: str, ids: DataFrame) -> DataFrame:
    """Rows with an array of structs, of which those stay whose key is among ids; rows left without any go."""
    known = ids.select(F.col(key).alias("_k")).distinct()
    at = df.withColumn("_row", F.monotonically_increasing_id())
    kept = at.select("_row", F.posexplode(items).alias("_p", "_item")).join(known, F.col(f"_item.{key}") == F.col("_k"), "left_semi")
    back = kept.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_item"))), lambda x: x["_item"]).alias("_items"))
    return at.join(back, "_row").withColumn(items, F.col("_items")).drop("_row", "_items")


def regrouped(flat: DataFrame, group: list[str], order: str, fields: list[str], name: str) -> DataFrame:
    """Flat rows as one row a group with an ordered array of structs."""
    packed = F.array_sort(F.collect_list(F.struct(order, *[f for f in fields if f != order])))
    return flat.groupBy(*group).agg(packed.alias(name))


def last_of_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last, as later entries of a map win."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
