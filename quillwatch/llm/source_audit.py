"""Divergence of sources within a language, from hash-consed segment trees over term ids.

A group is a language and a source. Kept terms of a language are numbered and cut into blocks;
in each block every group has a segment tree over its term counts. Trees are built bottom-up
with one node for each different pair of children, so equal subtrees of counts, of any group and
at any place, are one node. Two trees are compared by walking them together: each pair of nodes
met is priced once, by the prices of its pairs of children.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillwatch.llm.common import bound_batches, give_back, materialize, small_side

#: Documents of a language that a kept term is in, at least.
MIN_DOCS = 10
#: Share of the total that a probability is counted in, and what is added to each count.
SCALE, ADDED = 1_000_000_000, 2
TOP_TERMS = 10
#: Kept terms in a block, and sources of a language that meet in a tile, in expectation.
BLOCK_TERMS, TILE_SOURCES = 4096, 64
#: Entries of the tables that a task counts before it sends them, and bytes of their terms.
HELD_TERMS, HELD_BYTES = 200_000, 16 << 20
#: Pairs of groups whose trees are walked at a time.
PAIRS_AT_ONCE = 256

#: Bytes of terms, A-Z lowered; all others become blanks.
_BYTES = np.arange(256)
_LETTERS = (_BYTES >= 0x80) | ((_BYTES | 0x20 >= 0x61) & (_BYTES | 0x20 <= 0x7A) & (_BYTES >= 0x41))
TERM_MAP = bytes(
    (b + 32 if 65 <= b <= 90 else b) if letter else 32
    for b, letter in zip(range(256), _LETTERS.tolist(), strict=True)
)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group.

    A row with a null term tells a group, so that groups without terms are seen too. Tasks send
    partial counts; they are added up by a grouping with a map-side part.
    """
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(langs, sources, texts, strict=True):
                total, inside = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.as_py().translate(TERM_MAP).split())
                before = len(total)
                total.update(own)
                inside.update(own.keys())
                size += (len(total) - before) * (HELD_BYTES // HELD_TERMS) + sum(
                    len(t) for t in own if len(t) > 64
                )
                if size > HELD_BYTES:
                    yield sent(held)
                    held, size = {}, 0
        if held:
            yield sent(held)
        give_back()

    def sent(held: dict) -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (one, other), (total, inside) in held.items():
            many = len(total) + 1
            lang.append(pa.array([one], pa.string()).take(np.zeros(many, np.int64)))
            source.append(pa.array([other], pa.string()).take(np.zeros(many, np.int64)))
            term.append(pa.array([*total.keys(), None], pa.binary()).cast(pa.string()))
            n += [*total.values(), 0]
            docs += [*(inside[t] for t in total), 0]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays(lang), pa.concat_arrays(source), pa.concat_arrays(term)]
            + [pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
            ["lang", "source", "term", "n", "docs"],
        )

    plain = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    )
    partial = plain.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


# ---------------------------------------------------------------- prices


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + ADDED) / total), exact below 2**53 by division in three steps."""
    rest = counts + ADDED
    out = rest // total
    rest = rest % total
    step = 1000
    for _ in range(3):  # SCALE = step ** 3
        rest = rest * step
        out = out * step + rest // total
        rest = rest % total
    return 1 + out


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)); p and q are at most SCALE + 1, so the square fits."""
    return (p - q) ** 2 // (p + q)


class Forest:
    """Hash-consed segment trees over the rows of a matrix; equal subtrees are one node.

    ``leaves`` are the different counts, ``levels`` the (left, right) children of the different
    nodes from the lowest level up, ``roots`` the top node of each row. A count of -1 is no term.
    """

    def __init__(self, counts: np.ndarray) -> None:
        width = 1 << max(0, int(counts.shape[1] - 1).bit_length())
        full = np.full((counts.shape[0], width), -1, dtype=np.int64)
        full[:, : counts.shape[1]] = counts
        self.leaves, codes = np.unique(full, return_inverse=True)
        self.codes = codes = codes.reshape(full.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        below = len(self.leaves)
        while codes.shape[1] > 1:
            shape = (codes.shape[0], codes.shape[1] // 2)
            nodes, codes = np.unique(codes[:, ::2] * below + codes[:, 1::2], return_inverse=True)
            codes = codes.reshape(shape)
            self.levels.append((nodes // below, nodes % below))
            below = len(nodes)
        self.roots = codes[:, 0]

    def distances(self, one: np.ndarray, other: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Sum of ``gaps`` over all terms, for each pair of rows (one, other).

        The trees of a pair are walked together from their roots; at each level the different
        pairs of nodes are kept once, and prices are handed back upwards along the same pairs.
        """
        pair = np.arange(len(one))
        a, b = self.roots[one], self.roots[other]
        steps: list[np.ndarray] = []
        for depth in range(len(self.levels), 0, -1):
            left, right = self.levels[depth - 1]
            below = len(self.levels[depth - 2][0]) if depth > 1 else len(self.leaves)
            first = (pair * below + left[a]) * below + left[b]
            second = (pair * below + right[a]) * below + right[b]
            met, where = np.unique(np.concatenate([first, second]), return_inverse=True)
            steps.append(where)
            pair, a, b = met // (below * below), met // below % below, met % below
        p = shares(np.maximum(self.leaves[a], 0), totals[one[pair]])
        q = shares(np.maximum(self.leaves[b], 0), totals[other[pair]])
        price = np.where(self.leaves[a] < 0, 0, gaps(p, q))
        for where in reversed(steps):
            half = len(where) // 2
            price = price[where[:half]] + price[where[half:]]
        return price

    def excesses(self, row: int, whole: int, totals: np.ndarray) -> np.ndarray:
        """For each term, the gap of a row above row ``whole`` where it has the term, else -1."""
        n = len(self.leaves)
        met, where = np.unique(self.codes[row] * n + self.codes[whole], return_inverse=True)
        own, all_ = self.leaves[met // n], self.leaves[met % n]
        p = shares(np.maximum(own, 0), totals[row : row + 1])
        q = shares(np.maximum(all_, 0), totals[whole : whole + 1])
        return np.where((own > 0) & (p > q), gaps(p, q), -1)[where.ravel()]


# ---------------------------------------------------------------- plan


def tiles_of(parts: Column, tile: Column) -> Column:
    """The pairs (lo, hi) of tiles that a tile is in."""
    others = F.sequence(F.lit(0), parts - 1)
    return F.transform(
        others, lambda t: F.struct(F.least(t, tile).alias("lo"), F.greatest(t, tile).alias("hi"))
    )


def own_tiles(parts: Column) -> Column:
    """The pairs (lo, hi) of a tile and itself, for all tiles."""
    each = F.sequence(F.lit(0), parts - 1)
    return F.transform(each, lambda t: F.struct(t.alias("lo"), t.alias("hi")))


def compared(rows: DataFrame, top_terms: int) -> DataFrame:
    """Rows of blocks to (lang, part, source, item, value): gaps of pairs, best terms of groups.

    A row with a null source is the language, one with a null place gives a total.
    """

    def walk(key: tuple, block: pa.Table) -> pa.Table:
        lang, _, lo, hi = (k.as_py() for k in key)
        total = block["place"].is_null()
        heads, cells = block.filter(total), block.filter(pc.invert(total))
        tiles = heads["tile"].fill_null(-1).to_numpy()
        names, totals = heads["source"].to_pylist(), heads["n"].to_numpy()
        places = cells["place"].to_numpy()
        width = int(places.max()) + 1 if len(places) else 1
        counts = np.full((len(names), width), 0 if len(places) else -1, dtype=np.int64)
        rows = {name: k for k, name in enumerate(names)}
        own = np.fromiter((rows[s] for s in cells["source"].to_pylist()), np.int64, len(cells))
        counts[own, places] = cells["n"].to_numpy()
        forest = Forest(counts)
        low, high = np.flatnonzero(tiles == lo), np.flatnonzero(tiles == hi)
        if lo == hi:
            one, other = (low[x] for x in np.triu_indices(len(low), 1))
        else:
            one, other = np.repeat(low, len(high)), np.tile(high, len(low))
        source, item, value = [], [], []
        for at in range(0, len(one), PAIRS_AT_ONCE):
            a, b = one[at : at + PAIRS_AT_ONCE], other[at : at + PAIRS_AT_ONCE]
            value += forest.distances(a, b, totals).tolist()
            source += [names[k] for k in a.tolist()]
            item += [names[k] for k in b.tolist()]
        part = ["pair"] * len(value)
        if lo == hi and len(places):
            mine = cells.filter(cells["source"].is_null())
            words = dict(zip(mine["place"].to_pylist(), mine["term"].to_pylist(), strict=True))
            for k in low.tolist():
                gain = forest.excesses(k, rows[None], totals)
                for place in np.argsort(-gain, kind="stable")[:top_terms].tolist():
                    if gain[place] >= 0:
                        part.append("term")
                        source.append(names[k])
                        item.append(words[place])
                        value.append(int(gain[place]))
        columns = [[lang] * len(part), part, source, item]
        return pa.Table.from_arrays(
            [*(pa.array(c, pa.string()) for c in columns), pa.array(value, pa.int64())],
            ["lang", "part", "source", "item", "value"],
        )

    return rows.groupBy("lang", "block", "lo", "hi").applyInArrow(
        walk, "lang string, part string, source string, item string, value long"
    )


def audit_sources(
    docs: DataFrame,
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
    block_terms: int = BLOCK_TERMS,
    tile_sources: int = TILE_SOURCES,
) -> DataFrame:
    """lang, source, part, item, value, rank: how a source differs from others of its language.

    Terms are runs of letters and of characters outside ASCII, A-Z lowered; a language keeps
    those in ``min_docs`` of its documents. With V of them, a group gives a term of n occurrences
    the share 1 + floor(10**9 * (n + 2) / (N + 2 V)), N the sum of its n. Part ``pair`` has each
    other source of the language with the sum over its kept terms of
    floor((p - q)**2 / (p + q)); part ``term`` the ``top_terms`` terms a group has more often
    than its language, by the same measure. Ranks go by value descending, then item ascending in
    UTF-8. All numbers are exact up to 2**53 occurrences of a group.

    Terms of a language are dealt to blocks, its sources to tiles; a task compares two tiles in
    one block, so it holds some 2 * ``tile_sources`` * ``block_terms`` counts whatever the input.
    Null text, lang and source are ''. Repeated rows count each. An empty table gives no rows;
    further columns and ids are ignored.
    """
    counts = materialize(term_counts(docs))
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    kept = (
        counts.where(F.col("term").isNotNull())
        .groupBy("lang", "term")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        .where(F.col("docs") >= min_docs)
        .select("lang", "term", "n")
    )
    kept = materialize(kept)
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int")
    langs = materialize(
        groups.groupBy("lang").agg(F.count("*").alias("sources")).join(
            kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all")),
            "lang", "left",
        ).select(
            "lang",
            F.coalesce("terms", F.lit(0)).alias("terms"),
            F.coalesce("all", F.lit(0)).alias("all"),
            parts("terms", block_terms).alias("blocks"),
            parts("sources", tile_sources).alias("tiles"),
        )
    )
    langs = small_side(langs)
    numbered = materialize(
        kept.join(langs, "lang")
        .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int"))
        .withColumn(
            "place", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
        )
        .select("lang", "term", "n", "block", "place", "tiles")
    )
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    cells = materialize(
        counts.where(F.col("term").isNotNull())
        .select("lang", "source", "term", "n")
        .join(numbered.drop("n"), ["lang", "term"])
        .select("lang", "block", "tiles", tile.alias("tile"), "source", "place", "n")
    )
    totals = (
        groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .join(langs, "lang")
        .select(
            "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tiles",
            tile.alias("tile"), "source", F.lit(None).cast("int").alias("place"),
            (F.coalesce("n", F.lit(0)) + ADDED * F.col("terms")).alias("n"),
        )
    )
    of_groups = cells.unionByName(totals).select(
        "lang", "block", F.explode(tiles_of(F.col("tiles"), F.col("tile"))).alias("pair"),
        "tile", "source", "place", F.lit(None).cast("string").alias("term"), "n",
    )
    of_langs = numbered.select("lang", "block", "tiles", "place", "term", "n").unionByName(
        langs.select(
            "lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tiles",
            F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("term"),
            (F.col("all") + ADDED * F.col("terms")).alias("n"),
        )
    ).select(
        "lang", "block", F.explode(own_tiles(F.col("tiles"))).alias("pair"),
        F.lit(None).cast("int").alias("tile"), F.lit(None).cast("string").alias("source"),
        "place", "term", "n",
    )
    rows = of_groups.unionByName(of_langs).select(
        "lang", "block", "pair.lo", "pair.hi", "tile", "source", "place", "term", "n"
    )
    found = materialize(compared(rows, top_terms))
    sums = (
        found.where("part = 'pair'")
        .groupBy("lang", "part", "source", "item")
        .agg(F.sum("value").alias("value"))
    )
    both = sums.unionByName(
        sums.select("lang", "part", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order))
    return ranked.unionByName(terms.where(F.col("rank") <= top_terms)).select(
        "lang", "source", "part", "item", "value", "rank"
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term)
      GROUP BY lang, source, term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2))
              // (coalesce(s.n, 0) + 2 * v.v)::HUGEINT AS BIGINT) AS p,
         CAST(1 + (1000000000::HUGEINT * (k.n + 2)) // (v.n + 2 * v.v)::HUGEINT AS BIGINT) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item,
         CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part
                                       ORDER BY value DESC, item) AS INTEGER) AS rank FROM every)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
