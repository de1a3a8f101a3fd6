"""Compression classifier of text quality.

Two zstandard dictionaries of equal size are built, one from good and one from bad labelled texts. A text that is like the good ones
gets smaller with the good dictionary. The score is the difference of the two compressed sizes over the text's length, calibrated:
a logistic curve of this difference, with the log of the length as its reliability (alone and as a factor), weighted to the true
share of the labels. It is fitted across two halves of the sample, each measured with the dictionaries of the other, so that
no text is measured with a dictionary that holds it.

Fitting takes a bounded sample of labelled rows, chosen by a hash of the id: SAMPLE_DOCS of each label. A dictionary holds
PIECE characters of a text (from a place that a hash chooses, where the text is longer), up to DICTIONARY_BYTES in all.
Texts to calibrate on are read whole, where they are; only their features come to the driver. The shares of the labels are
counted over all rows that may be learnt from. Scoring reads every whole text, in one scan without a shuffle.

Defined cases: null and empty texts get the score of length 0; ids with conflicting labels, null labels or null ids teach
nothing; without two texts of each label the score of every row is the share of good labels (0.5 without labels); rows
repeat as they are; a score equal to the threshold is predicted 1; columns that aren't asked for are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm._common import from_texts, learns, table

SAMPLE_DOCS = 3000
DICTIONARY_BYTES = 1 << 20
PIECE = 500
LEVEL = 9
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]
    centre: list[float]
    scale: list[float]
    share: float

    def packers(self) -> list:
        import zstandard

        found = []
        for body in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(level=LEVEL)
            found.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=words))
        return found

    def features(self, texts: list[str | None], packers: list | None = None) -> np.ndarray:
        """The normalised difference, the log of the length, and their product."""
        good, bad = packers or self.packers()
        out = np.empty((len(texts), 3))
        for k, text in enumerate(texts):
            body = (text or "").encode("utf-8", "surrogatepass")
            d, size = (len(bad.compress(body)) - len(good.compress(body))) / max(1, len(body)), np.log1p(len(body))
            out[k] = d, size, d * size
        return out

    def score(self, texts: list[str | None], packers: list | None = None) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.share)
        x = (self.features(texts, packers) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    x, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.diag([1e-6] + [1.0] * (x.shape[1] - 1))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * np.r_[0, b[1:]])
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> Model:
    """docs(doc_id, text), labels(doc_id, quality); rows whose crc32 of the id, mod `mod`, is `held` teach nothing."""
    spark = docs.sparkSession
    ids = labels.where(learns("doc_id", mod, held)).where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("high")).where("quality = high").select("doc_id", "quality")
    counts = {r["quality"]: r["count"] for r in ids.groupBy("quality").count().collect()}
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null")
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = []
    for q in (0, 1):  # of the ids that have a text
        rows = ids.where(F.col("quality") == q).join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(hashed, "doc_id").limit(SAMPLE_DOCS).collect()
        chosen += [(r["doc_id"], q, k % 2) for k, r in enumerate(rows)]
        if len(rows) < 2:
            return Model(b"", b"", [], [], [], share)
    few = F.broadcast(spark.createDataFrame(chosen, f"doc_id {dict(labels.dtypes)['doc_id']}, quality int, half int"))
    found = texts.join(few, "doc_id")
    at = F.pmod(hashed, F.greatest(F.lit(1), F.length("text") - PIECE + 1)).cast("int") + 1
    pieces = [(r["quality"], r["half"], r["piece"].encode("utf-8", "surrogatepass")) for r in found.select("quality", "half", F.substr("text", at, F.lit(PIECE)).alias("piece"), hashed.alias("h")).orderBy("h", "piece").collect()]

    def dictionaries(halves: tuple[int, ...]) -> Model:
        bodies = [b" ".join(x for label, half, x in pieces if label == q and half in halves) for q in (1, 0)]
        size = min(DICTIONARY_BYTES, *map(len, bodies))
        return Model(bodies[0][:size], bodies[1][:size], [], [], [], share)

    other = [dictionaries((1,)), dictionaries((0,))]

    if not all(x.good for x in other):  # nothing but empty texts in a half
        return Model(b"", b"", [], [], [], share)

    def measured(half: int) -> DataFrame:
        def make():
            packers = other[half].packers()
            return lambda texts: dict(zip("dlp", other[half].features(texts, packers).T, strict=True))

        return from_texts(found.where(F.col("half") == half).select("quality", F.col("text").alias("__text")), make, {"d": "double", "l": "double", "p": "double"})

    model, data = dictionaries((0, 1)), np.array(sorted(tuple(r) for r in measured(0).unionByName(measured(1)).collect()))
    y, x = data[:, 0], data[:, 1:]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum())) * len(y)
    model.centre, model.scale = centre.tolist(), scale.tolist()
    model.weights = _logistic((x - centre) / scale, y, w).tolist()
    return model


def scored(docs: DataFrame, model: Model, columns: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The given columns with score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        packers = shipped.value.packers() if shipped.value.good else None

        def work(texts: list[str | None]) -> dict:
            score = shipped.value.score(texts, packers)
            return {"score": score, "predicted": (score >= threshold).astype("int32")}

        return work

    return from_texts(docs.select(*columns, F.col("text").cast("string").alias("__text")), make, {"score": "double", "predicted": "int"})


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = docs.withColumn("held_out", ~learns("doc_id", 5, 0))
    return scored(rows, model, ["doc_id", "held_out"])
