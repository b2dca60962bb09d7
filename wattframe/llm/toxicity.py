"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattframe.llm.text import fresh, mix, texts_of, word_hashes, word_table
from wattframe.session import cut_lineage

TRAINING_ROWS = 20_000  # the most labelled rows a model is fitted on
SLOT_BITS = 22
_WORDS = word_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SALTS = np.random.Generator(np.random.PCG64(97)).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Weights:
    """The non-zero weights of a fitted model: at most 2**SLOT_BITS of them whatever the input."""

    bias: float
    slots: np.ndarray
    values: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << SLOT_BITS, dtype=np.float32)
        out[self.slots] = self.values
        return out


def slots_of(text: bytes) -> np.ndarray:
    """Slots of a text's words, word pairs, word triples, and pairs that skip one or two words, with repeats."""
    h = word_hashes(text.decode("utf-8", "replace").lower().encode(), _WORDS)
    parts = [h]
    if len(h) > 1:
        parts.append(h[:-1] * _SALTS[0] + h[1:] * _SALTS[1])
    if len(h) > 2:
        parts.append(h[:-2] * _SALTS[2] + h[2:] * _SALTS[3])
        parts.append(h[:-2] * _SALTS[4] + h[1:-1] * _SALTS[5] + h[2:] * _SALTS[6])
    if len(h) > 3:
        parts.append(h[:-3] * _SALTS[6] + h[3:] * _SALTS[7])
    return (mix(np.concatenate(parts)) >> np.uint64(64 - SLOT_BITS)).astype(np.int32)


def features(text: bytes) -> np.ndarray:
    """The different slots of a text."""
    return np.unique(slots_of(text))


def logit(text: bytes, weights: np.ndarray, bias: float) -> float:
    """Sum of the weights of the different slots."""
    slots = slots_of(text)
    return bias + float(weights[np.unique(slots[weights[slots] != 0])].sum(dtype=np.float64))


class Ftrl:
    """FTRL-proximal with one learning rate per slot. Inputs are 0/1, so a row touches the slots it holds and the bias."""

    def __init__(self, slots: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(slots + 1)
        self.n = np.zeros(slots + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        held = np.maximum(np.abs(z) - self.l1, 0)
        return -np.sign(z) * held / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        square = gradient * gradient
        self.z[at] += gradient - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square


def learnable(id_column: Column) -> Column:
    """True where labels may be learnt: crc32 of the id as text is not divisible by 5."""
    return F.coalesce(F.crc32(F.encode(id_column.cast("string"), "UTF-8")) % 5 != 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """text, label, place: at most `rows` learnable labelled documents, those with the smallest hashes of their ids (the bound is on the fit alone).

    One row per id: of rows that repeat an id, the one with the smallest hash of its text.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    picked = usable.select("doc_id", "label", F.xxhash64("doc_id").alias("place")).orderBy("place", "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Bounded by `rows`: three numbers each.
    labelled = texts.join(F.broadcast(cut_lineage(picked)), "doc_id")
    return labelled.groupBy("doc_id", "label", "place").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "label", "place")


def fit(training: DataFrame, epochs: int = 3) -> Weights:
    """Fits one model on the bounded sample. Slots are computed where the texts are; only they reach the one task that learns, in the order of `place`."""
    found = pa.schema([("label", pa.int32()), ("place", pa.int64()), ("slots", pa.list_(pa.int32()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = pa.array([features(t) for t in texts_of(batch.column(0))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), batch.column(2), slots], schema=found)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(place, label, np.asarray(slots.values)) for b in batches for label, place, slots in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))]
        rows.sort(key=lambda r: (r[0], len(r[2])))
        model = Ftrl(1 << SLOT_BITS)
        for _ in range(epochs):
            for _, label, slots in rows:
                model.learn(slots, label)
        w = model.weights(slice(None))
        slots = np.append(np.flatnonzero(w[:-1]), 1 << SLOT_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(w[slots].astype(np.float32))], names=["slot", "weight"])

    extracted = training.mapInArrow(extract, "label int, place long, slots array<int>")
    table = extracted.repartition(1).mapInArrow(learn, "slot int, weight float").toArrow()
    slots, values = table.column("slot").to_numpy(), table.column("weight").to_numpy()
    real = slots < 1 << SLOT_BITS
    return Weights(float(values[~real].sum()), slots[real], values[real])


def score(docs: DataFrame, model: Weights, text_column: str = "text", score_column: str = "_toxicity") -> DataFrame:
    """`docs` with all its columns and `score_column`: the probability that the text is toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_column, T.DoubleType())])
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = held.value.dense(), held.value.bias
        for batch in batches:
            logits = np.array([logit(t, weights, bias) for t in texts_of(batch.column(place))])
            values = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, score_column])

    return docs.mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Learns from at most `rows` labelled rows outside the held-out fifth; scores depend on the text alone. Null and empty texts get the score of the bias. A
    document labelled several times counts as toxic if one label says so, and of rows that repeat an id one is learnt; labels other than 0 and 1 and null ids are not learnt. Without usable labels all scores
    are 0.5. Repeated rows score alike; an empty table gives an empty result; other columns are not read.
    """
    model = fit(training_rows(docs, labels, rows))
    picked = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(picked, model)
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> DataFrame:
    """The rows with a score below 0.5, with all their columns, whatever their names."""
    column = fresh(docs, "_toxicity")
    return score(docs, fit(training_rows(docs, labels, rows)), score_column=column).where(F.col(column) < 0.5).drop(column)
