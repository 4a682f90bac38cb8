"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import (
    ALNUM_MAP,
    bound_batches,
    fresh,
    hash_bucket,
    mix64,
    text_slices,
    word_hashes,
)

#: log2 of the number of weights; the bias stands behind them.
WEIGHT_BITS = 20
#: Labelled rows that are learned from, in expectation: the bound of the sample.
SAMPLE = 24_000
#: Learners that pass over their own rows, one for each SHARD_ROWS rows of the sample; their
#: weights are averaged. EPOCHS passes each.
SHARD_ROWS, EPOCHS = 6_000, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
#: Words from a word to its partner: 1 makes bigrams, more makes skip-grams.
GAPS = (1, 2)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight index, text) of each word, bigram and skip-gram; repeats stay."""
    hashes, first = word_hashes(data, offsets, ALNUM_MAP)
    texts = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    found, of = [hashes], [texts]
    for gap in GAPS:
        if len(hashes) > gap:
            both = texts[gap:] == texts[:-gap]
            pairs = mix64(hashes[:-gap] * np.uint64(2 * gap + 1) + hashes[gap:])
            found.append(pairs[both])
            of.append(texts[gap:][both])
    index = np.concatenate(found) >> np.uint64(64 - WEIGHT_BITS)
    return index.astype(np.int64), np.concatenate(of)


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Weights after EPOCHS passes in the given order; every row is its set of indexes."""
    z, n = np.zeros((1 << WEIGHT_BITS) + 1), np.zeros((1 << WEIGHT_BITS) + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        w = -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zs) <= L1, 0.0, w)

    for _ in range(EPOCHS):
        for at, label in zip(rows, labels, strict=True):
            w = weights(at)
            g = float(sigmoid(w.sum())) - label
            rate = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA  # per coordinate
            z[at] += g - rate * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def text_sets(texts: pa.Array) -> list[np.ndarray]:
    """The set of weight indexes of each text, with the bias."""
    out: list[np.ndarray] = []
    for first, last, data, offsets in text_slices(texts):
        index, of = features(data, offsets)
        keys = np.unique((of << 32) | index)
        cut = np.searchsorted(keys, np.arange(last - first + 1) << 32)
        keys = (keys & ((1 << 32) - 1)).astype(np.int32)
        out += [np.append(keys[a:b], np.int32(1 << WEIGHT_BITS)) for a, b in zip(cut, cut[1:], strict=False)]
    return out


@dataclass(frozen=True)
class ToxicModel:
    """The weights that are not zero."""

    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros((1 << WEIGHT_BITS) + 1)
        out[self.index] = self.weight
        return out

    def scores(self, texts: pa.Array, dense: np.ndarray) -> np.ndarray:
        if not len(self.index):
            return np.zeros(len(texts))
        parts = []
        for first, last, data, offsets in text_slices(texts):
            index, of = features(data, offsets)
            live = np.flatnonzero(dense[index])
            keys = np.unique((of[live] << 32) | index[live])  # each feature counts once
            sums = np.bincount(
                keys >> 32, weights=dense[keys & ((1 << 32) - 1)], minlength=last - first
            )
            parts.append(sigmoid(sums + dense[-1]))
        return np.concatenate([*parts, []])


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> ToxicModel:
    """Learn from about SAMPLE labelled rows whose crc32(doc_id) mod ``folds`` is not 0.

    Each learner passes over its own rows in a fixed order; their weights are averaged. The
    driver gets at most 2**WEIGHT_BITS + 1 weights of each of the few learners. Rows with null label or id
    are left out; an id is toxic if one of its label rows says so.
    """
    bound_batches(docs.sparkSession)
    usable = (
        labels.select("doc_id", "toxic")
        .where("doc_id is not null and toxic is not null")
        .where(hash_bucket(F.col("doc_id"), folds) != 0)
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    count = usable.count()
    shards = max(1, round(min(count, SAMPLE) / SHARD_ROWS))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = usable.where(draw < F.lit(SAMPLE / max(count, 1)))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(
        F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)).alias("shard"),
        F.xxhash64("doc_id").alias("place"), "text", "toxic",
    )

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "text"], kind="stable")
        weights = ftrl(
            text_sets(pa.array(group["text"].fillna(""), pa.large_string())),
            group["toxic"].to_numpy(),
        )
        at = np.flatnonzero(weights)
        return pd.DataFrame({"at": at, "w": weights[at], "one": np.int64(group["shard"].iloc[0])})

    learned = rows.groupBy("shard").applyInPandas(learn, "at long, w double, one long")
    got = learned.toArrow()  # the weights of each learner at most
    at, w = got.column("at").to_numpy(), got.column("w").to_numpy()
    learners = max(1, len(set(got.column("one").to_pylist())))
    mean = np.zeros((1 << WEIGHT_BITS) + 1)
    np.add.at(mean, at, w / learners)
    index = np.flatnonzero(mean)
    return ToxicModel(index, mean[index])


def toxic_score(docs: DataFrame, model: ToxicModel, text: Column) -> Column:
    """Chance of the toxic label, 0 to 1; null counts as empty, no model gives 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held: dict[str, np.ndarray] = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if "dense" not in held:
            held["dense"] = shared.value.dense()
        return pa.array(shared.value.scores(texts, held["dense"]), pa.float64())

    return score(F.coalesce(text, F.lit("")))


def score_toxicity(documents: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    The score reads the whole text and nothing else; null and empty texts get the score of the
    bias. A null id is not held out. Repeated rows are scored alike; without labels every score
    is 0; an empty table gives no rows; further columns are ignored.
    """
    model = fit_toxicity(documents, labels, folds)
    docs = documents.select("doc_id", "text")
    return docs.select(
        "doc_id",
        (hash_bucket(F.col("doc_id"), folds) == 0).alias("held_out"),
        toxic_score(docs, model, F.col("text")).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.

    Null and empty texts are judged by the bias alone; without labels every document stays. A
    score of exactly 0.5 goes. Repeated rows stay or go together; null ids are
    judged, but not learned from. An empty table gives no rows.
    """
    (name,) = fresh(docs, "toxic_score")
    model = fit_toxicity(docs, labels)
    return (
        docs.withColumn(name, toxic_score(docs, model, F.col("text")))
        .where(F.col(name) < 0.5)
        .drop(name)
    )


