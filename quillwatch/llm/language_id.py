"""Language identification with bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import ALNUM_MAP, bound_batches, hash_bucket, text_slices

#: Bytes of an n-gram, rows of the filter (a power of two), and rows set for each n-gram.
N, ROW_BITS, HASHES = 4, 19, 3
#: Documents of each language that are learned from, in expectation: the bound of the sample.
SAMPLE = 3000
#: A language contains an n-gram that stands in this share of its documents, and at least in
#: this share of the rate of the language where the n-gram is most frequent.
LEAST_RATE, LEAST_SHARE = 0.003, 0.5

_FACTORS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], dtype=np.uint64
)
_LETTERS = ALNUM_MAP.copy()
_LETTERS[0x30:0x3A] = 32


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(text), F.lit(" "))


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of N bytes as one integer, text it stands in); blanks and signs are one space."""
    low = _LETTERS[data]
    space = low == 32
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    heads = offsets[:-1]
    keep[heads[heads < len(low)]] = True
    at = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum(keep, out=at[1:])
    low, offsets = low[keep], at[offsets]
    whole = np.zeros(max(0, len(low) - N + 1), dtype=np.uint32)
    for k in range(N):
        whole |= low[k : k + len(whole)].astype(np.uint32) << np.uint32(8 * k)
    counts = np.maximum(np.diff(offsets) - (N - 1), 0)
    texts = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return whole[offsets[texts] + inside], texts


def rows_of(keys: np.ndarray, which: int) -> np.ndarray:
    return (keys.astype(np.uint64) * _FACTORS[which]) >> np.uint64(64 - ROW_BITS)


@dataclass(frozen=True)
class LanguageFilters:
    """One Bloom filter per language, sliced so that one row has a bit for every language."""

    languages: tuple[str, ...]
    slices: np.ndarray  # ROWS x ceil(languages / 8) bytes
    usual: int

    def rates(self) -> np.ndarray:
        """False-positive rate of each language's filter, from the share of its set rows."""
        bits = np.unpackbits(self.slices, axis=1, bitorder="little")[:, : len(self.languages)]
        return bits.mean(axis=0) ** HASHES

    def counts(self, keys: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
        """For each of n texts and each language, the n-grams that its filter contains."""
        out = np.zeros((n, 8 * self.slices.shape[1]))
        rows = [rows_of(keys, k) for k in range(HASHES)]
        patterns = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
        for column in range(self.slices.shape[1]):
            sliced = self.slices[:, column]
            mask = sliced[rows[0]]
            for more in rows[1:]:
                mask = mask & sliced[more]
            seen = np.bincount(texts * 256 + mask, minlength=n * 256).reshape(n, 256)
            out[:, 8 * column : 8 * column + 8] = seen @ patterns
        return out[:, : len(self.languages)]

    def decide(self, texts: pa.Array) -> pa.Array:
        """Language and score; the score is the winner's share of all corrected counts."""
        rates, names, scores = self.rates(), [], []
        for first, last, data, offsets in text_slices(texts):
            keys, of = grams(data, offsets)
            n = last - first
            total = np.bincount(of, minlength=n)[:, None]
            # of `total` n-grams about rate * (total - true) pass by mistake
            true = np.maximum(self.counts(keys, of, n) - total * rates, 0) / np.maximum(1 - rates, 1e-9)
            best, everything = true.argmax(axis=1), true.sum(axis=1)
            best[everything == 0] = self.usual
            share = true[np.arange(n), best] / np.maximum(everything, 1e-9)
            names += [self.languages[i] for i in best]
            scores.append(np.clip(share, 0, 1))
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate([*scores, []]), pa.float64())],
            ["lang_pred", "score"],
        )


def fit_languages(
    labelled: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = SAMPLE,
) -> LanguageFilters | None:
    """Learn from about ``sample`` documents of each language, drawn by a hash of the key.

    The driver gets the language list and the filter itself, whose size is fixed by ROW_BITS
    and the number of languages; None if no labelled text has a letter.
    """
    spark = labelled.sparkSession
    rows = labelled.select(
        F.col(key_col).alias("key"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return None
    names = [r["lang"] for r in sizes]
    chances = spark.createDataFrame(
        [(r["lang"], i, min(1.0, sample / r["count"])) for i, r in enumerate(sizes)],
        "lang string, place int, chance double",
    )
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.join(F.broadcast(chances), "lang").where(draw < F.col("chance"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            places = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            for first, last, data, offsets in text_slices(batch.column(1)):
                keys, of = grams(data, offsets)
                once = np.unique((of.astype(np.uint64) << np.uint64(32)) | keys)
                of = (once >> np.uint64(32)).astype(np.int64)
                held.append((places[first:last][of] << np.uint64(32)) | (once & np.uint64(2**32 - 1)))
            # one row for each document, too, so that languages can be weighed
            held.append((places << np.uint64(32)) | np.uint64(0))
        if held:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((keys >> np.uint64(32)).astype(np.int32)),
                    pa.array((keys & np.uint64(2**32 - 1)).astype(np.int64)),
                    pa.array(times.astype(np.int64)),
                ],
                ["place", "gram", "docs"],
            )

    counted = (
        drawn.select("place", padded(F.col("text")).alias("text"))
        .mapInArrow(count, "place int, gram long, docs long")
        .groupBy("place", "gram")
        .agg(F.sum("docs").alias("docs"))
    )
    whole = F.broadcast(
        drawn.groupBy("place").agg(F.count("*").alias("whole")).withColumnRenamed("place", "of")
    )
    rate = F.col("docs") / F.col("whole")
    rated = counted.where("gram <> 0").join(whole, F.col("place") == F.col("of"))
    kept = (
        rated.withColumn("rate", rate)
        .groupBy("gram")
        .agg(F.max("rate").alias("top"), F.collect_list(F.struct("place", "rate")).alias("each"))
        .where(F.col("top") >= LEAST_RATE)
        .select("gram", "top", F.explode("each").alias("one"))
        .where(
            (F.col("one.rate") >= LEAST_RATE) & (F.col("one.rate") >= LEAST_SHARE * F.col("top"))
        )
        .select("gram", F.col("one.place").alias("place"))
    )

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, places = (batch.column(i).to_numpy() for i in (0, 1))
            at = np.concatenate([rows_of(keys, k) for k in range(HASHES)]).astype(np.int64)
            places = np.tile(places.astype(np.int64), HASHES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at * ((len(names) + 7) // 8) + places // 8), pa.array(1 << places % 8)],
                ["cell", "bits"],
            )

    cells = (
        kept.mapInArrow(mark, "cell long, bits long")
        .groupBy("cell")
        .agg(F.bit_or("bits").alias("bits"))
        .toArrow()
    )  # at most one row for each byte of the filter
    slices = np.zeros(((1 << ROW_BITS), (len(names) + 7) // 8), dtype=np.uint8)
    slices.ravel()[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy()
    usual = max(range(len(sizes)), key=lambda i: sizes[i]["count"])
    return LanguageFilters(tuple(names), slices, usual)


def predict_languages(docs: DataFrame, filters: LanguageFilters | None) -> DataFrame:
    """Add lang_pred and score to the documents, read from ``text`` alone.

    ``und`` with score 0 for null texts, texts without a letter, and all texts if there are no
    filters; a text whose n-grams are all unknown gets the most frequent language, score 0. Of
    languages with equal corrected counts the first by name is predicted.
    """
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if filters is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def decide(texts: pa.Array) -> pa.Array:
        return shared.value.decide(texts)

    return (
        docs.withColumn("made", decide(padded(F.coalesce("text", F.lit("")))))
        .withColumn("lang_pred", F.when(lettered, F.col("made.lang_pred")).otherwise("und"))
        .withColumn("score", F.when(lettered, F.col("made.score")).otherwise(0.0))
        .drop("made")
    )


def identify_languages(documents: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from the documents whose crc32(doc_id) mod ``folds`` is not 0; a null id is not held
    out. Repeated rows are scored row by row; an empty table gives no rows; further columns
    are ignored.
    """
    bound_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text", "lang").withColumn(
        "held_out", hash_bucket(F.col("doc_id"), folds) == 0
    )
    filters = fit_languages(docs.where("not held_out"))
    return predict_languages(docs.select("doc_id", "held_out", "text"), filters).select(
        "doc_id", "held_out", "lang_pred", "score"
    )
