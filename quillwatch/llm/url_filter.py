"""Exact URL rules from a cascade of Bloom filters, looked up without a join."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import ascii_lower, fresh, materialize

#: Fixed values of the rule list: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Size of a level that a broadcast should not pass. More keys are cut by their hash into shards
#: with a cascade each, and the pages are looked up shard after shard.
MAX_LEVEL_MB = 64


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z lowered; else empty."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(found, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


# ---------------------------------------------------------------- one level


def positions(keys: Iterable[str], bits: int, hashes: int, level: int) -> np.ndarray:
    """Bit positions of each key, one row of ``hashes`` columns per key."""
    pairs = [divmod(xxhash.xxh3_128_intdigest(k, seed=level), 1 << 64) for k in keys]
    first = np.array([p[0] for p in pairs], dtype=np.uint64).reshape(-1, 1)
    step = np.array([p[1] | 1 for p in pairs], dtype=np.uint64).reshape(-1, 1)
    return (first + step * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    data: bytes

    def holds(self, keys: list[str]) -> np.ndarray:
        at = positions(keys, self.bits, self.hashes, self.number)
        words = np.frombuffer(self.data, dtype=np.uint8)
        return (((words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1) == 1).all(
            axis=1
        )


def bits_of(count: int, hashes: int) -> int:
    return max(64, math.ceil(count * hashes / math.log(2)))


def build_level(keys: DataFrame, count: int, number: int, rate: float) -> Level:
    """A Bloom filter of ``count`` distinct keys with about the given false-positive rate."""
    hashes = max(1, round(-math.log2(rate)))
    bits = bits_of(count, hashes)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = positions(batch.column(0).to_pylist(), bits, hashes, number).ravel()
            byte, flag = (at >> np.uint64(3)).astype(np.int64), at & np.uint64(7)
            yield pa.RecordBatch.from_arrays(
                [pa.array(byte), pa.array((1 << flag.astype(np.int64)).astype(np.int64))],
                ["byte", "flag"],
            )

    marks = keys.mapInArrow(mark, "byte long, flag long").groupBy("byte").agg(
        F.bit_or("flag").alias("flag")
    )
    data = np.zeros((bits + 7) // 8, dtype=np.uint8)
    got = marks.toArrow()  # at most one row per byte of the bounded level
    data[got.column("byte").to_numpy()] = got.column("flag").to_numpy().astype(np.uint8)
    return Level(number, bits, hashes, data.tobytes())


# ---------------------------------------------------------------- the cascade


@dataclass(frozen=True)
class Cascade:
    """Exact membership for every key of the universe it was built over."""

    levels: tuple[Level, ...]

    def holds(self, keys: list[str]) -> np.ndarray:
        """A key is listed if the first level that lacks it has an odd place (counted from 0)."""
        out = np.zeros(len(keys), dtype=bool)
        left = np.arange(len(keys))
        for place, level in enumerate(self.levels):
            inside = level.holds([keys[i] for i in left]) if len(left) else np.zeros(0, bool)
            out[left[~inside]] = place % 2 == 1
            left = left[inside]
        out[left] = len(self.levels) % 2 == 1
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, first_level: int = 0) -> Cascade:
    """Levels over two frames of one string column ``key``; ``universe`` may repeat its keys.

    Level 0 holds the listed keys, level 1 the keys of the universe that level 0 takes by
    mistake, level 2 the listed keys that level 1 takes by mistake, until none is left. With
    the rates of the first level set to |listed| / |universe| * sqrt(0.5) and 0.5 after it, all
    levels together take bits in proportion to the listed keys, times the logarithm of the
    universe: what is broadcast does not follow the corpus.
    """
    listed = materialize(listed.where("key is not null").distinct())
    n = listed.count()
    if n == 0:
        return Cascade(())
    levels = [build_level(listed, n, first_level, first_rate(n, universe))]
    wrong = materialize(
        passing(universe, levels[0]).distinct().join(listed, "key", "left_anti")
    )
    right = listed
    while (count := wrong.count()) > 0:
        levels.append(build_level(wrong, count, first_level + len(levels), 0.5))
        # the keys of the other side that the new level takes too are the next level's
        right, wrong = wrong, materialize(passing(right, levels[-1]))
    return Cascade(tuple(levels))


def first_rate(listed: int, universe: DataFrame) -> float:
    total = universe.agg(F.approx_count_distinct("key").alias("n")).first()["n"]
    return min(0.5, max(2.0**-30, listed / max(total, 1) * math.sqrt(0.5)))


def shards_for(listed: DataFrame, universe: DataFrame) -> int:
    """How many shards keep the first level, the largest, at about MAX_LEVEL_MB."""
    n = listed.where("key is not null").distinct().count()
    if bits_of(n, 30) <= MAX_LEVEL_MB * (1 << 23):  # whatever the universe
        return 1
    hashes = max(1, round(-math.log2(first_rate(n, universe))))
    return math.ceil(bits_of(n, hashes) / (MAX_LEVEL_MB * (1 << 23)))


def shard_of(keys: list[str], shards: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k, seed=7) % shards for k in keys], dtype=np.int64)


def in_shard(keys: DataFrame, shard: int, shards: int) -> DataFrame:
    if shards == 1:
        return keys

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shard_of(batch.column(0).to_pylist(), shards) == shard))

    return keys.select("key").where("key is not null").mapInArrow(keep, "key string")


def passing(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = shared.value.holds(batch.column(0).to_pylist())
            yield batch.filter(pa.array(inside))

    return keys.select("key").where("key is not null").mapInArrow(keep, "key string")


# ---------------------------------------------------------------- rules over urls


def lookups(host: str, path: str, shapes: dict[int, list[int]]) -> list[str]:
    """Keys of all rules that can fit: longest first, of equal length the longer host first.

    ``shapes`` has the path lengths that occur in the rules for each number of host labels.
    """
    out, labels = [], host.split(".") if host else []
    for n, lengths in shapes.items():
        if 0 < n <= len(labels):
            suffix = ".".join(labels[-n:])
            out += [(len(suffix) + k, len(suffix), suffix + path[:k]) for k in lengths if k <= len(path)]
    return [key for *_, key in sorted(out, reverse=True)]


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    ``rules`` has verdict, host and path. A rule fits its host and all subdomains if the path
    of the url starts with the rule's; the longest fitting rule decides. A url that no listed
    rule fits is allowed. One cascade tells the listed keys among all keys of the corpus, a
    second one the blocked among the listed, so the lookup is a map over the pages; rule lists of
    more than MAX_LEVEL_MB of filters take one such map for each shard of them.

    A null url or one without :// has empty host and path, fits no rule and is allowed. Null
    ids and repeated rows are judged row by row; an empty rule list allows everything; rules
    with a null part or an empty host are left out; of two rules with one key, block wins.
    """
    spark = pages.sparkSession
    rules = rules.where("verdict is not null and host <> '' and path is not null").select(
        "verdict", ascii_lower(F.col("host")).alias("host"), "path",
        F.concat(ascii_lower(F.col("host")), F.col("path")).alias("key"),
    )
    shape_rows = rules.select(
        F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("k")
    ).distinct()
    shapes: dict[int, list[int]] = {}
    for row in shape_rows.toLocalIterator():  # distinct (labels, path length) pairs only
        shapes.setdefault(row["n"], []).append(row["k"])

    seen = pages.select(
        F.col(id_col).alias("page_id"),
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = (batch.column(i).to_pylist() for i in (0, 1))
            keys = {k for h, p in zip(hosts, paths, strict=True) for k in lookups(h, p, shapes)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])

    universe = seen.select("host", "path").mapInArrow(expand, "key string")
    listed = rules.select("key")
    blocked = rules.where("verdict = 'block'").select("key")
    shards = shards_for(listed, universe)
    (made,) = fresh(seen, "made")
    judged = seen.withColumn(made, F.lit(None).cast(JUDGED))
    for shard in range(shards):
        some = in_shard(listed, shard, shards)
        filters = spark.sparkContext.broadcast(
            (
                build_cascade(some, in_shard(universe, shard, shards)),
                build_cascade(in_shard(blocked, shard, shards), some, first_level=1000),
            )
        )
        judged = judged.withColumn(made, decider(filters, shapes, shard, shards)("host", "path", made))
        if shard < shards - 1:  # one shard's filters at a time in a worker
            judged = materialize(judged)
    return judged.select(
        "page_id",
        "host",
        "path",
        f"{made}.rule",
        F.coalesce(f"{made}.verdict", F.lit("allow")).alias("verdict"),
    )


JUDGED = "struct<place int, rule string, verdict string>"


def decider(filters: Broadcast, shapes: dict[int, list[int]], shard: int, shards: int) -> Callable[..., Column]:
    """The first listed lookup of a url in one shard, if it comes before what other shards found."""

    @F.arrow_udf(JUDGED)
    def decide(hosts: pa.Array, paths: pa.Array, before: pa.Array) -> pa.Array:
        is_listed, is_blocked = filters.value
        keys, owners, places = [], [], []
        best = [x and (x["place"], x["rule"], x["verdict"]) for x in before.to_pylist()]
        for i, (host, path) in enumerate(zip(hosts.to_pylist(), paths.to_pylist(), strict=True)):
            asked = lookups(host, path, shapes)
            if best[i] and best[i][0] is not None:
                asked = asked[: best[i][0]]
            keys += asked
            owners += [i] * len(asked)
            places += range(len(asked))
        own = np.arange(len(keys)) if shards == 1 else np.flatnonzero(shard_of(keys, shards) == shard)
        hit = own[is_listed.holds([keys[j] for j in own])] if len(own) else own
        first: dict[int, int] = {}
        for j in hit.tolist():
            first.setdefault(owners[j], j)
        stop = is_blocked.holds([keys[j] for j in first.values()])
        for (i, j), s in zip(first.items(), stop.tolist(), strict=True):
            best[i] = (places[j], keys[j], "block" if s else "allow")
        rows = [x or (None, None, None) for x in best]
        return pa.StructArray.from_arrays(
            [
                pa.array([x[0] for x in rows], pa.int32()),
                pa.array([x[1] for x in rows], pa.string()),
                pa.array([x[2] for x in rows], pa.string()),
            ],
            ["place", "rule", "verdict"],
        )

    return decide


ORACLE = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, host, path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
judged AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path
      ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS place
  FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host))
    AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE place = 1
"""
