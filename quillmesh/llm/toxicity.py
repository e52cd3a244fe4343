"""Toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams of words.

A text's features are the hashed words, word stems (first letters), pairs of neighbours and pairs with one word
between, each counted once. FTRL-proximal keeps a learning rate for each coordinate, and its L1 term leaves most
weights at exactly zero; what is left is a few thousand (index, weight) pairs, broadcast to score whole texts.

Training reads a bounded sample of labelled documents (``max_rows``, those with the least hash of doc_id), chosen
alike at every size; its features go to one task, a row for each doc_id. Null and empty texts have only the bias, so they get a score as well;
labels that are null don't count; where labels leave no weight but the bias, ``told_apart`` is false and all scores are equal (0.5 without any
label), and ``keep_harmless`` keeps every row. Equal texts get equal scores, labelled
or not; an empty table gives no rows; more columns of the input are left alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import give_back, holds, learnable, per_batch, unused

BITS = 20
STEMS = (3, 4, 5)
EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_=+/\\~"
CACHE: dict[bytes, tuple[int, ...]] = {}
CACHE_WORDS = 100_000
GRAM, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _hashes(word: bytes) -> tuple[int, ...]:
    """Of the word without marks at its ends, and of its stems."""
    if (known := CACHE.get(word)) is None:
        if len(CACHE) >= CACHE_WORDS:
            CACHE.clear()
        bare = word.strip(EDGES)
        letters = bare.decode(errors="replace")
        known = CACHE[word] = (xxhash.xxh64_intdigest(bare, 1), *(xxhash.xxh64_intdigest(letters[:n], 2 + n) if len(letters) > n else 0 for n in STEMS))
    return known


def feature_slots(text: str | None) -> np.ndarray:
    """Slots of all features in a text, repeats included."""
    words = text.lower().encode().split() if text else []
    if not words:
        return np.empty(0, np.int64)
    found = np.array([_hashes(w) for w in words], np.uint64)
    h = found[:, 0]
    grams = h[:-1] * GRAM ^ (h[1:] >> np.uint64(1))
    skips = h[:-2] * SKIP ^ (h[2:] >> np.uint64(1))
    stems = found[:, 1:].ravel()
    return (np.concatenate([h, stems[stems > 0], grams, skips]) >> np.uint64(64 - BITS)).astype(np.int64)


def train(slots: list[np.ndarray], labels: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) other than zero, by FTRL-proximal; the slot after the last is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rng = np.random.default_rng(7)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(slots)):
            at = slots[i]
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = weights(slice(None))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def _extract(b: pa.RecordBatch) -> pa.RecordBatch:
    packed = [np.append(np.unique(feature_slots(t)), 1 << BITS).astype(np.uint32).tobytes() for t in b.column("text").to_pylist()]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(packed, pa.binary())], names=["doc_id", "label", "slots"])


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    holds(__name__, CACHE.clear)
    slots, labels = [], []
    for b in batches:
        slots += [np.frombuffer(x, np.uint32) for x in b.column("slots").to_pylist()]
        labels += b.column("label").to_pylist()
    if slots:
        order = sorted(range(len(slots)), key=lambda i: (xxhash.xxh64_intdigest(slots[i].tobytes()), labels[i]))
        at, w = train([slots[i] for i in order], np.array(labels, np.float64)[order])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w)], names=["slot", "weight"])
    del slots, labels
    give_back()


def fit(docs: DataFrame, marks: DataFrame, max_rows: int = 16_000) -> dict[str, np.ndarray]:
    """Weights from the texts of docs whose doc_id has a label (0 or 1) in marks (doc_id, label).

    The sample of ids is bounded by max_rows, so that it is broadcast; texts stay where they are, and only the features of
    the sample go to the task that trains.
    """
    there = marks.where("label in (0, 1)").join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = there.select("doc_id", F.col("label").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Of rows that repeat a doc_id, the one with the least hash of the text is learned from, so that the bound holds.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(per_batch(_extract), "doc_id long, label int, slots binary")
    features = joined.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("slots").alias("mark"), "slots", "label")).alias("one")).select("one.label", "one.slots")
    found = features.repartition(1).mapInArrow(_train_task, "slot long, weight double").toPandas()
    return {"slot": found["slot"].to_numpy(np.int64), "weight": found["weight"].to_numpy(np.float64)}


def told_apart(model: dict[str, np.ndarray]) -> bool:
    """Whether any feature has a weight."""
    return bool((model["slot"] < 1 << BITS).any())


def score(docs: DataFrame, model: dict[str, np.ndarray], columns: list[str], name: str = "score") -> DataFrame:
    """columns of docs and the probability of label 1 as a column of that name, which docs don't have."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(__name__, CACHE.clear)
        table = np.zeros((1 << BITS) + 1, np.float32)
        table[shared.value["slot"]] = shared.value["weight"]
        bias = float(table[1 << BITS])
        for b in batches:
            scores = []
            for t in b.column(len(columns)).to_pylist():
                at = feature_slots(t)
                at = np.unique(at[table[at] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(bias + table[at].sum(dtype=np.float64), -35, 35))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), pa.array(scores, pa.float64())], names=[*columns, name])

    return docs.select(*columns, F.col("text").alias(unused("_text", columns))).mapInArrow(run, schema)


def keep_harmless(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows of docs whose score stays below the threshold; all of them if the labels don't tell any feature apart."""
    model = fit(docs.withColumn("doc_id", F.col("doc_id").cast("long")), usable(labels))
    if not told_apart(model):
        return docs
    name = unused("_toxicity", docs.columns)
    return score(docs, model, docs.columns, name).where(F.col(name) < threshold).drop(name)


def usable(labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id and label of the labelled documents, but for the fold that is held out."""
    marks = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label"))
    return marks.where(learnable() % folds != held).groupBy("doc_id").agg(F.max("label").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each document."""
    model = fit(docs.withColumn("doc_id", F.col("doc_id").cast("long")), usable(labels), max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learnable() % 4 == 2, F.lit(False)).alias("held_out"), "text")
    return score(rows, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
