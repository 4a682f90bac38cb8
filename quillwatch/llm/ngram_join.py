"""Exact self-join on Jaccard similarity of word n-grams, with signature trees.

The trees prune: a node holds the OR of the token bitmaps below it, the range of set sizes,
and the most tokens that share a bit; two nodes are followed only if sets below them can still
overlap enough. Trees over the whole corpus would not prune at the top, so each tree covers the
documents that share one token of their prefixes (the first quarter of a set in one global
order): every qualifying pair meets there. Common tokens come last in that order, copies are
joined first, and tokens seen in one component only are dropped, so the trees stay small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillwatch.llm.common import (
    SPACED_MAP,
    bound_batches,
    flushed,
    fresh,
    give_back,
    materialize,
    mix64,
    small_side,
    text_slices,
    word_hashes,
)
from quillwatch.llm.graph import components

NGRAM, PERCENT = 5, 75
#: Words of 64 bits in a token bitmap.
BITMAP_WORDS = 16
#: log2 of the counters that find common tokens; a fixed size, whatever the corpus.
COUNTER_BITS, COUNTER_PARTS = 18, 16
#: Bands of two minima each that find the first links.
BANDS = 4
#: Documents of a tree that one task joins with as many others.
PAGE = 512
FANOUT = 8

_TERMS = np.array([0xD1B54A32D192ED03, 0xAEF17502108EF2D9, 0x8CB92BA72F3D8DD7,
                   0xABC98388FB8FAC03, 0xF1357AEA2E62A9C5], dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A shingle is NGRAM words; a text of fewer words is one shingle, a text without any none.
    """
    for _, _, data, offsets in text_slices(texts):
        words, first = word_hashes(data, offsets, SPACED_MAP)
        full = np.zeros(max(0, len(words) - NGRAM + 1), dtype=np.uint64)
        for k in range(NGRAM):
            full += words[k : k + len(full)] * _TERMS[k]
        full = mix64(full)
        for a, b in zip(first, first[1:], strict=False):
            n = b - a
            if n >= NGRAM:
                yield np.unique(full[a : b - NGRAM + 1])
            elif n:
                yield mix64(np.sum(words[a:b] * _TERMS[:n], keepdims=True) + np.uint64(n))
            else:
                yield full[:0]


# ---------------------------------------------------------------- first pass


def profiles(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, n, two set digests, bands), and counter rows (part, blob)."""
    schema = (
        "doc_id long, n long, d1 long, d2 long, bands array<long>, part int, counters binary"
    )
    cells = (1 << COUNTER_BITS) // COUNTER_PARTS

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            n, d1, d2, bands = [], [], [], []
            for tokens in shingle_sets(batch.column(1)):
                n.append(len(tokens))
                d1.append(np.sum(mix64(tokens), dtype=np.uint64))
                d2.append(np.sum(mix64(tokens ^ _TERMS[0]), dtype=np.uint64))
                bands.append(minima(tokens))
                np.add.at(counters, (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(d1, dtype=np.uint64).view(np.int64)),
                    pa.array(np.array(d2, dtype=np.uint64).view(np.int64)),
                    pa.array([b.tolist() for b in bands], pa.list_(pa.int64())),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                ["doc_id", "n", "d1", "d2", "bands", "part", "counters"],
            )
        parts, blobs = [], []
        for part in range(COUNTER_PARTS):
            own = counters[part * cells : (part + 1) * cells]
            at = np.flatnonzero(own)
            if len(at):
                parts.append(part)
                blobs.append(np.stack([at, own[at]]).astype("<u4").tobytes())
        if parts:
            rows = len(parts)
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.nulls(rows, pa.int64()) for _ in range(4)),
                    pa.nulls(rows, pa.list_(pa.int64())),
                    pa.array(parts, pa.int32()),
                    pa.array(blobs, pa.binary()),
                ],
                ["doc_id", "n", "d1", "d2", "bands", "part", "counters"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, schema)


def minima(tokens: np.ndarray) -> np.ndarray:
    """BANDS keys; each joins the least tokens of two classes of tokens."""
    if not len(tokens):
        return np.zeros(0, dtype=np.int64)
    classes = (tokens & np.uint64(2 * BANDS - 1)).astype(np.int64)
    kinds, first = np.unique(classes, return_index=True)  # tokens are sorted: first is least
    least = np.full(2 * BANDS, 2**64 - 1, dtype=np.uint64)
    least[kinds] = tokens[first]
    return mix64(least[::2] * _TERMS[1] + least[1::2] * _TERMS[2]).view(np.int64)


def common_tokens(profile: DataFrame) -> np.ndarray:
    """For each of the 2**COUNTER_BITS token classes, whether it is far above the mean."""
    cells = (1 << COUNTER_BITS) // COUNTER_PARTS

    def total(group: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(cells, dtype=np.int64)
        for blob in group["counters"]:
            at, n = np.frombuffer(blob, dtype="<u4").reshape(2, -1)
            out[at] += n
        return pd.DataFrame({"part": [group["part"].iloc[0]], "counters": [out.tobytes()]})

    sums = np.zeros((COUNTER_PARTS, cells), dtype=np.int64)
    rows = profile.where("part is not null").select("part", "counters")
    for row in rows.groupBy("part").applyInPandas(total, "part int, counters binary").collect():
        sums[row["part"]] = np.frombuffer(row["counters"], dtype=np.int64)
    return sums.ravel() >= 2 * sums.mean() + 64


# ---------------------------------------------------------------- verification


def similar(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= PERCENT * (a + b - shared)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, text) of the documents whose id is in ``ids`` (a materialized column id)."""
    return docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(
        small_side(ids).withColumnRenamed("id", "node"), "node", "left_semi"
    )


def set_rows(docs: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """(node, n, data) of the documents whose id is in ``ids``.

    data is the sorted tokens, or a token bitmap as wide as the set is large.
    """
    shape = {"tokens": lambda x: x, "wide": wide_bitmap}[kind]

    def make(held: list[tuple]) -> pa.RecordBatch:
        nodes, sizes, data = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())],
            ["node", "n", "data"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for node, tokens in zip(nodes, shingle_sets(batch.column(1)), strict=True):
                data = shape(tokens).tobytes()
                yield len(data), (node, len(tokens), data)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from flushed(rows(batches), make)

    return texts_of(docs, ids).mapInArrow(read, "node long, n long, data binary")


def tested(pairs: DataFrame, rows: DataFrame, test: Callable) -> DataFrame:
    """The pairs (a, b) of sizes near enough whose data pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                m, n = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                x, y = (
                    np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint64) for k in (4, 5)
                )
                good.append(test(x, y, m, n))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            give_back()

    sides = [
        rows.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("data").alias(f"d{k}"))
        for k in ("a", "b")
    ]
    near = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(near)
    return both.select("a", "b", "na", "nb", "da", "db").mapInArrow(run, "a long, b long")


def reach(x: np.ndarray, y: np.ndarray, m: int, n: int) -> bool:
    """Whether sets of m and n tokens with these bitmaps can be similar."""
    x, y = fold(x, len(y)), fold(y, len(x))
    spare = min(m - np.bitwise_count(x).sum(), n - np.bitwise_count(y).sum())
    return similar(min(m, n, int(np.bitwise_count(x & y).sum() + spare)), m, n)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity; bitmaps spare most of the sets a shuffle."""
    wide = materialize(set_rows(docs, ids_of(pairs), "wide"))
    left = materialize(tested(pairs, wide, reach))
    tokens = materialize(set_rows(docs, ids_of(left), "tokens"))
    return tested(
        left,
        tokens,
        lambda x, y, m, n: similar(len(np.intersect1d(x, y, assume_unique=True)), m, n),
    )


# ---------------------------------------------------------------- signature trees


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Each token sets one of the bits, chosen by its low bits."""
    bits = np.zeros(64 * BITMAP_WORDS, dtype=np.uint8)
    bits[(tokens & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def wide_bitmap(tokens: np.ndarray) -> np.ndarray:
    """As many bits as tokens at least, a power of two, chosen by the same low bits."""
    words = max(BITMAP_WORDS, 1 << max(0, (len(tokens) - 1).bit_length() - 5))
    bits = np.zeros(64 * words, dtype=np.uint8)
    bits[(tokens & np.uint64(64 * words - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same tokens with fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, words)) if len(bits) > words else bits


@dataclass
class Tree:
    """Levels from the leaves up; ``start`` has the first child of each node and the end."""

    levels: list[dict[str, np.ndarray]]
    order: np.ndarray


def build_tree(n: np.ndarray, bits: np.ndarray, comp: np.ndarray, rest: np.ndarray) -> Tree:
    order = np.lexsort((bits[:, 0], n))
    n, bits, comp, rest = n[order], bits[order], comp[order], rest[order]
    slack = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    level = {
        "lo": n, "hi": n, "bits": bits, "slack": slack, "rest": rest, "c0": comp, "c1": comp
    }
    levels = [level]
    while len(level["lo"]) > FANOUT:
        at = np.arange(0, len(level["lo"]), FANOUT)
        level = {
            "lo": np.minimum.reduceat(level["lo"], at),
            "hi": np.maximum.reduceat(level["hi"], at),
            "bits": np.bitwise_or.reduceat(level["bits"], at, axis=0),
            "slack": np.maximum.reduceat(level["slack"], at),
            "rest": np.maximum.reduceat(level["rest"], at),
            "c0": np.minimum.reduceat(level["c0"], at),
            "c1": np.maximum.reduceat(level["c1"], at),
        }
        levels.append(level)
    return Tree(levels, order)


def possible(x: dict, i: np.ndarray, y: dict, j: np.ndarray) -> np.ndarray:
    """Whether sets below node i of x and node j of y can reach the similarity."""
    hi, lo = np.minimum(x["hi"][i], y["hi"][j]), np.maximum(x["lo"][i], y["lo"][j])
    keep = 100 * hi >= PERCENT * lo
    keep &= ~((x["c0"][i] == x["c1"][i]) & (x["c0"][i] == y["c0"][j]) & (y["c0"][j] == y["c1"][j]))
    left = np.flatnonzero(keep)
    for at in range(0, len(left), 1 << 14):
        k = left[at : at + (1 << 14)]
        both = np.bitwise_count(x["bits"][i[k]] & y["bits"][j[k]]).sum(axis=1).astype(np.int64)
        most = np.minimum(hi[k], both + np.minimum(x["slack"][i[k]], y["slack"][j[k]]))
        most = np.minimum(most, np.minimum(x["rest"][i[k]], y["rest"][j[k]]))
        least = x["lo"][i[k]] + y["lo"][j[k]]
        keep[k] = (100 + PERCENT) * most >= PERCENT * least
    return keep


def dual(x: Tree, y: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs that no bound excludes; both trees are followed level by level."""
    depth = [len(x.levels) - 1, len(y.levels) - 1]
    i = np.repeat(np.arange(len(x.levels[-1]["lo"])), len(y.levels[-1]["lo"]))
    j = np.tile(np.arange(len(y.levels[-1]["lo"])), len(x.levels[-1]["lo"]))
    while True:
        keep = possible(x.levels[depth[0]], i, y.levels[depth[1]], j)
        i, j = i[keep], j[keep]
        if depth == [0, 0] or not len(i):
            return x.order[i], y.order[j]
        if depth[0] >= depth[1]:
            depth[0] -= 1
            i, j = children(i, len(x.levels[depth[0]]["lo"]), j)
        else:
            depth[1] -= 1
            j, i = children(j, len(y.levels[depth[1]]["lo"]), i)


def children(i: np.ndarray, size: int, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    below = (i[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    return below[below < size], np.repeat(j, FANOUT)[below < size]


def leaf_rows(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, n, bits, slack) of the documents whose id is in ``ids``.

    bits are the words of the bitmap of fixed width, slack the tokens that add no bit of their own.
    """

    def make(held: list[tuple]) -> pa.RecordBatch:
        nodes, sizes, bits, slack = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(nodes, pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(bits, pa.list_(pa.int64())),
                pa.array(slack, pa.int64()),
            ],
            ["node", "n", "bits", "slack"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            nodes = batch.column(0).to_pylist()
            for node, tokens in zip(nodes, shingle_sets(batch.column(1)), strict=True):
                bits = bitmap(tokens)
                slack = len(tokens) - int(np.bitwise_count(bits).sum())
                yield 8 * BITMAP_WORDS, (node, len(tokens), bits.view(np.int64), slack)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from flushed(rows(batches), make)

    return texts_of(docs, ids).mapInArrow(read, "node long, n long, bits array<long>, slack long")


#: Trees that a task keeps; pages stand in several pairs, most of them close together.
TREES_KEPT = 64


class Pages:
    """A column of pages, each a list of sets, as arrays over all sets of the column."""

    def __init__(self, column: pa.ListArray) -> None:
        self.starts = column.offsets.to_numpy()
        sets = column.values
        self.fields = {
            name: sets.field(name).to_numpy(zero_copy_only=False)
            for name in ("node", "comp", "n", "rest")
        }
        bits = sets.field("bits")
        flat = bits.values.to_numpy(zero_copy_only=False).view(np.uint64)
        first = int(bits.offsets[0].as_py()) if len(bits) else 0
        self.bits = flat[first : first + len(bits) * BITMAP_WORDS].reshape(-1, BITMAP_WORDS)

    def tree(self, at: int, kept: dict) -> tuple[np.ndarray, Tree]:
        """Ids and tree of a page, from ``kept`` if it was built lately."""
        part = slice(self.starts[at], self.starts[at + 1])
        node, comp, n, rest = (self.fields[k][part] for k in ("node", "comp", "n", "rest"))
        name = node.tobytes() + rest.tobytes()
        if name not in kept:
            if len(kept) >= TREES_KEPT:
                del kept[next(iter(kept))]
            kept[name] = node, build_tree(n, self.bits[part], comp, rest)
        return kept[name]


def tree_pairs(buckets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b, of buckets (token, node, comp, rest, n, bits, slack).

    ``rest`` counts the tokens of the set from the bucket's token on: if it is the first one
    that two sets share, they share no more than that. A bucket is cut by set size and, where
    many sets share a size, by a hash into pages of about PAGE sets: the upper nodes of its
    tree. Spark pairs the pages that the bounds of a node allow; where a page holds several
    sets, a task follows the trees below.
    """
    words = [f"w{i}" for i in range(BITMAP_WORDS)]
    sized = buckets.withColumn(
        "class", F.floor(F.log(F.col("n").cast("double")) / F.lit(0.06)).cast("int")
    )
    counts = sized.groupBy("token", "class").agg(
        F.ceil(F.count("*") / F.lit(PAGE)).alias("pages")
    )
    paged = (
        sized.join(counts, ["token", "class"])
        .withColumn("page", F.pmod(F.xxhash64("node"), F.col("pages")))
        .groupBy("token", "class", "page")
        .agg(
            F.min("n").alias("lo"),
            F.max("n").alias("hi"),
            F.max("rest").alias("rest"),
            F.max("slack").alias("slack"),
            F.min("comp").alias("c0"),
            F.max("comp").alias("c1"),
            *(F.bit_or(F.col("bits")[i]).alias(w) for i, w in enumerate(words)),
            F.collect_list(F.struct("node", "comp", "n", "rest", "bits")).alias("sets"),
        )
    )
    x, y = paged.alias("x"), paged.alias("y")
    first = F.struct("x.class", "x.page") <= F.struct("y.class", "y.page")
    sizes = 100 * F.least("x.hi", "y.hi") >= PERCENT * F.greatest("x.lo", "y.lo")
    mixed = F.least("x.c0", "y.c0") != F.greatest("x.c1", "y.c1")
    shared = sum(
        (F.bit_count(F.col(f"x.{w}").bitwiseAND(F.col(f"y.{w}"))) for w in words), F.lit(0)
    )
    most = F.least(
        "x.hi", "y.hi", "x.rest", "y.rest", shared + F.least("x.slack", "y.slack")
    )
    enough = (100 + PERCENT) * most >= PERCENT * (F.col("x.lo") + F.col("y.lo"))
    met = x.join(
        y, (F.col("x.token") == F.col("y.token")) & first & sizes & mixed & enough
    ).select(F.col("x.sets").alias("left"), F.col("y.sets").alias("right"))
    single = (F.size("left") == 1) & (F.size("right") == 1)
    lone = met.where(single).select(
        F.col("left")[0]["node"].alias("u"), F.col("right")[0]["node"].alias("v")
    )
    lone = lone.where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[bytes, tuple[np.ndarray, Tree]] = {}
        for batch in batches:
            left, right = (Pages(batch.column(k)) for k in (0, 1))
            for at in range(batch.num_rows):
                (u, x), (v, y) = left.tree(at, trees), right.tree(at, trees)
                i, j = dual(x, y)
                a, b = np.minimum(u[i], v[j]), np.maximum(u[i], v[j])
                pairs = np.unique(np.stack([a, b])[:, a < b], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"]
                )
            give_back()

    return met.where(~single).mapInArrow(follow, "a long, b long").union(lone).distinct()


# ---------------------------------------------------------------- the join


def prefix_rows(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(token, node, comp, rest) for the tokens of each document's prefix; ``docs`` has doc_id, comp, text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common))

    def make(held: list[tuple]) -> pa.RecordBatch:
        tokens, nodes, comps, rest = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(tokens), pa.array(nodes), pa.array(comps), pa.array(rest)],
            ["token", "node", "comp", "rest"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            nodes, comps = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for node, comp, tokens in zip(nodes, comps, shingle_sets(batch.column(2)), strict=True):
                n = len(tokens)
                if n:
                    size = n - -(-PERCENT * n // 100) + 1
                    late = last[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                    prefix = np.concatenate([tokens[~late], tokens[late]])[:size].view(np.int64)
                    yield 32 * size, (
                        prefix, np.full(size, node), np.full(size, comp), n - np.arange(size)
                    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from flushed(rows(batches), make)

    return docs.select("doc_id", "comp", "text").mapInArrow(
        read, "token long, node long, comp long, rest long"
    )


def ngram_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; the join is exact.

    Two documents link when 100 * |intersection| >= PERCENT * |union| of their shingle sets; the
    component is the smallest doc_id reachable by links, itself included. Equal sets are linked
    through the smallest id among them. Shingles are compared as 64-bit hashes.

    Null text and text without words have 0 shingles and link with nothing. A null doc_id links
    with nothing and has a null component. Ids name documents: rows repeated with one id get
    one component. An empty table gives no rows; further columns are ignored.
    """
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    linked = docs.where("doc_id is not null")
    profile = materialize(profiles(docs))
    rows = profile.where("part is null")
    real = rows.where("doc_id is not null and n > 0")

    # equal sets: one class with the smallest id
    classes = real.groupBy("d1", "d2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies")
    )
    copies = materialize(
        real.join(classes.where("copies > 1"), ["d1", "d2"])
        .select("doc_id", "least")
        .where("doc_id <> least")
        .distinct()
    )
    firsts = real.join(small_side(copies), "doc_id", "left_anti")

    # first links: each set with the least id that has the same band, tested
    keyed = firsts.select("doc_id", "n", F.posexplode("bands").alias("band", "key"))
    heads = keyed.groupBy("band", "key").agg(
        F.min("doc_id").alias("head"), F.count("*").alias("size")
    )
    pairs = materialize(
        keyed.join(heads.where("size > 1"), ["band", "key"])
        .where("doc_id <> head")
        .select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
        .distinct()
    )
    links = materialize(verified(pairs, linked))
    start = copies.select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    known = materialize(components(links.unionByName(start)).where("node <> component"))

    # the rest: trees over tokens that stand in more than one component
    nodes = linked.join(small_side(copies), "doc_id", "left_anti")
    labelled = nodes.join(small_side(known), F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("comp"), "text"
    )
    token = Window.partitionBy("token")
    buckets = materialize(
        prefix_rows(labelled, common_tokens(profile))
        .withColumn("c0", F.min("comp").over(token))
        .withColumn("c1", F.max("comp").over(token))
        .where("c0 <> c1")
        .select("token", "node", "comp", "rest")
    )
    inside = materialize(buckets.select(F.col("node").alias("id")).distinct())
    leaves = materialize(leaf_rows(linked, inside))
    candidates = materialize(tree_pairs(buckets.join(leaves, "node")))
    more = verified(candidates, linked)
    whole = components(known.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
    return rows.join(whole, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )


def ids_of(pairs: DataFrame) -> DataFrame:
    return materialize(
        pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with all its columns.

    Documents of null or wordless text are linked with nothing and stay, as do rows with a null
    id. Rows repeated with one id are one document and stay or go together; an empty table gives
    no rows.
    """
    removed = materialize(
        ngram_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    )
    (name,) = fresh(docs, "removed_id")
    return docs.join(
        small_side(removed.toDF(name)), F.col("doc_id") == F.col(name), "left_anti"
    )


ORACLE = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(CAST(len(w) AS BIGINT) - 3, 2))) AS i
        FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
  FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
  WHERE 100 * o >= 75 * (s.n + t.n - o))
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id
FROM words d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (
  WITH RECURSIVE reach(doc_id, far) AS (
    SELECT DISTINCT a, a FROM links UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.far = links.a)
  SELECT doc_id, min(far) AS least FROM reach GROUP BY doc_id) r USING (doc_id)
"""
