"""Quality classifier: hashed word n-grams, logistic regression trained by FTRL-proximal.

Training takes a bounded sample of labelled rows (``max_train_rows``), dealt
into shards; each shard follows the regularised leader over its rows in a fixed
order, and the shards' weights are averaged. The model is one weight for each
of 2**bits hash values, whatever the corpus. Scoring is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, id_bucket, stored, text_of

#: Words and runs of symbols are tokens of their own.
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Fixed odd multiplier that mixes two token hashes.
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The mark of a token that repeats the one before it.
REPEATED = np.uint64(1)
CACHE_TOKENS = 500_000


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    max_train_rows: int = 24_000
    shard_rows: int = 3_000
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.01
    threshold: float = 0.7


class Hasher:
    """Sparse features of a text: hashed unigrams and bigrams with L2-normalised counts.

    Beside the n-grams of its tokens, a text has those of its marks: one for a
    word all in capitals, one for a number, and one for a token that repeats
    the one before it. An n-gram with a mark stands beside that of the tokens
    themselves, so that such tokens share weights and keep their own.
    """

    def __init__(self, bits: int):
        self.shift, self.known = np.uint64(64 - bits), {}

    def _hash(self, token: str) -> tuple[int, int]:
        """The token's hash and its mark's; the same one twice without a mark."""
        from xxhash import xxh64_intdigest

        kind = "^" if len(token) > 1 and token.isupper() else "#" if token.isdigit() else ""
        own = xxh64_intdigest(token.encode("utf-8", "replace"))
        return own, xxh64_intdigest(f"\0{kind}".encode()) if kind else own

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text)
        if len(self.known) > CACHE_TOKENS:
            self.known = {}
        known = self.known
        for t in set(tokens).difference(known):
            known[t] = self._hash(t)
        both = np.asarray([known[t] for t in tokens], dtype=np.uint64).reshape(-1, 2)
        h, m = both[:, 0], both[:, 1].copy()
        m[1:][h[1:] == h[:-1]] = REPEATED
        marked = m != h
        pairs = lambda x: x[:-1] * np.uint64(3) + (x[1:] ^ (x[1:] >> np.uint64(29)))
        grams = np.concatenate([h, pairs(h), m[marked], pairs(m)[marked[1:] | marked[:-1]]]) * _MIX
        index, count = np.unique((grams >> self.shift).astype(np.int64), return_counts=True)
        value = np.sqrt(count)
        return index, value / max(1e-9, float(np.sqrt((value * value).sum())))


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> np.ndarray:
    """Weights and, last, the bias after ``epochs`` passes over ``rows``."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(i: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[i]) <= s.l1, 0.0, -(z[i] - np.sign(z[i]) * s.l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2))

    for _ in range(s.epochs):
        for index, value, label in rows:
            i, x = np.append(index, size - 1), np.append(value, 1.0)
            w = weights(i)
            g = (_sigmoid(float(w @ x)) - label) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
    return weights(np.arange(size))


def _shard(batches: Iterator[pd.DataFrame], s: Settings) -> Iterator[pd.DataFrame]:
    by_shard: dict[int, list] = {}
    hasher = Hasher(s.bits)
    for batch in batches:
        for shard, text, label in zip(batch["shard"], batch["text"], batch["label"]):
            by_shard.setdefault(shard, []).append((*hasher(text), int(label)))
    for rows in by_shard.values():
        w = ftrl(rows, s)
        at = np.flatnonzero(w)
        yield pd.DataFrame({"feature": at, "weight": w[at]})


def _within(rows: DataFrame, most: int, *key: Column) -> DataFrame:
    """``rows`` with the smallest ``most`` or fewer values of ``key``: those below the value at place ``most``.

    Only keys are ordered, and only ``most`` + 1 of them meet in one task.
    """
    edge = rows.select(F.struct(*key).alias("k")).orderBy("k").offset(most).limit(1).collect()
    if not edge:
        return rows
    names = [f"k{i}" for i in range(len(key))]
    below = F.struct(*[k.alias(n) for k, n in zip(key, names)]) < F.struct(*[F.lit(v).alias(n) for v, n in zip(edge[0]["k"], names)])
    return rows.where(below)


def train(labelled: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Weights from ``labelled`` (doc_id, text, label 0 or 1). Rows without a label teach nothing.

    At most ``max_train_rows`` rows teach, those with the smallest hashes of
    their id and text, so every document has the same chance. The result is
    deterministic. No rows give zero weights. A very long text is one row like
    any other, of at most as many features as the model has.
    """
    place, content = F.xxhash64("doc_id", F.lit(7)), F.xxhash64("text")
    rows = labelled.where("label IN (0, 1)").select("doc_id", text_of().alias("text"), "label")
    rows = _within(rows, s.max_train_rows, place, content).withColumn("place", place)
    shards = max(1, rows.count() // s.shard_rows)
    # A task for each shard, whatever the hashes of their numbers.
    dealt = rows.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")).repartitionById(shards, "shard").sortWithinPartitions("place", content)
    sums = dealt.select("shard", "text", "label").mapInPandas(partial(_shard, s=s), "feature long, weight double")
    model = np.zeros((1 << s.bits) + 1)
    for feature, weight in sums.groupBy("feature").agg(F.sum("weight").alias("weight")).toLocalIterator():  # at most 2**bits + 1 rows
        model[feature] = weight / shards
    return model


def _score(batches: Iterator[pa.RecordBatch], model: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(bits)
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            index, value = hasher(text)
            out.append(_sigmoid(float(model[index] @ value) + float(model[-1])))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.float64())], names=["doc_id", "score"])


def score(docs: DataFrame, model: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """doc_id, score, predicted for each row; null texts count as empty and score by the bias alone.

    Repeated rows and null doc_ids are scored like any other. No rows, no scores.
    Only doc_id and text are read, whatever other columns are called.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.astype(np.float64))  # 8 bytes * 2**bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _score(batches, held.value, s.bits)

    scored = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= s.threshold).cast("int"))


def keep(docs: DataFrame, model: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all their columns, that score ``threshold`` or more. Texts are not shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model.astype(np.float64))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, model = Hasher(s.bits), held.value
        for batch in batches:
            good = []
            for text in batch.column(at).to_pylist():
                index, value = hasher(text or "")
                good.append(_sigmoid(float(model[index] @ value) + float(model[-1])) >= s.threshold)
            yield batch.filter(pa.array(good, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, label of the labelled rows that may teach: crc32(doc_id) mod 4 is not 2."""
    marks = labels.where(F.col("doc_id").isNotNull() & (id_bucket(4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    return docs.select("doc_id", "text").join(marks, "doc_id")


def fit(spark: SparkSession, docs: DataFrame, sf_dir: str, s: Settings = Settings()) -> np.ndarray:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    # The sample is drawn before the texts are joined, so that only its texts are shuffled.
    known = labels.where((id_bucket(4) != 2) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = _within(known, s.max_train_rows, F.xxhash64("doc_id", F.lit(7)))
    return train(stored(with_labels(docs, known), "labelled"), s)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score(docs, fit(spark, docs, sf_dir))
    return scored.select("doc_id", (id_bucket(4) == 2).alias("held_out"), "score", "predicted")
