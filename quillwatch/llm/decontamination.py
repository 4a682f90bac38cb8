"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import ALNUM_MAP, bound_batches, fresh, give_back, materialize

WINDOW = 10
#: Words of an anchor, and words from one anchor of an item to the next. A window is as long as
#: an anchor and all but one of these words, so every window holds a whole anchor.
ANCHOR, STRIDE = 4, 7
#: Bytes of item text in one automaton, which takes some 80 times as much with its windows;
#: items beyond the bound go to further automata, each with a scan of its own.
MAX_ITEM_BYTES = 6 << 20

_MAP = ALNUM_MAP.tobytes()
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_automata: dict[str, Items] = {}

SCAN = (
    "struct<n_words long, n_hit long, items array<string>, "
    "runs array<struct<first int, last int>>, spans array<struct<start int, end int>>>"
)


def words_of(text: str | None) -> list[str]:
    """Words of ASCII letters and digits and all characters outside ASCII; A-Z lowered."""
    return (text or "").encode("utf-8", "replace").translate(_MAP).decode().split(" ")


def tidy(text: str | None) -> list[str]:
    return [w for w in words_of(text) if w]


class Items:
    """The windows of the items, and one automaton that finds where a window can stand.

    Items of less than WINDOW words are patterns as a whole; of the others the ANCHOR words at
    every STRIDE-th word are, so the automaton is no larger than the text of the items.
    """

    def __init__(self, rows: list[tuple[str | None, str | None]]) -> None:
        found: dict[str, set[str | None]] = {}
        marks: dict[str, list] = {}  # pattern: [is an anchor, words of the short item, its ids]
        for item, text in rows:
            words = tidy(text)
            n = len(words)
            if n < WINDOW:
                if n:
                    mark = marks.setdefault(f" {' '.join(words)} ", [False, n, set()])
                    mark[2].add(item)
                continue
            for i in range(n - WINDOW + 1):
                found.setdefault(" ".join(words[i : i + WINDOW]), set()).add(item)
            for i in range(0, n - ANCHOR + 1, STRIDE):
                key = f" {' '.join(words[i : i + ANCHOR])} "
                marks.setdefault(key, [False, ANCHOR, set()])[0] = True
        shared: dict[frozenset, frozenset] = {}  # one set for all windows of the same items
        self.windows = {
            key: shared.setdefault(ids, ids) for key, ids in ((k, frozenset(v)) for k, v in found.items())
        }
        self.machine = ahocorasick.Automaton()
        for key, (anchor, size, ids) in marks.items():
            self.machine.add_word(key, (anchor, size, frozenset(ids)))
        self.machine.make_automaton()

    def hits(self, words: list[str]) -> Iterator[tuple[int, int, frozenset]]:
        """(first word, last word, items) of every occurrence of a window."""
        if not len(self.machine):
            return
        ends: np.ndarray | None = None
        done = 0  # starts before it were looked at
        for at, (anchor, size, ids) in self.machine.iter(f" {' '.join(words)} "):
            if ends is None:  # place of the blank behind each word
                ends = np.cumsum([len(w) + 1 for w in words])
            last = int(np.searchsorted(ends, at))
            if ids:
                yield last - size + 1, last, ids
            if anchor:
                until = min(last - ANCHOR + 2, len(words) - WINDOW + 1)
                for start in range(max(done, last - WINDOW + 1), until):
                    owners = self.windows.get(" ".join(words[start : start + WINDOW]))
                    if owners:
                        yield start, start + WINDOW - 1, owners
                done = max(done, until)


def built(name: str, rows: list[tuple[str | None, str | None]]) -> Items:
    """Built once in each Python worker."""
    if name not in _automata:
        _automata.clear()
        _automata[name] = Items(rows)
    return _automata[name]


def find(
    items: Items, text: str | None, before: dict | None
) -> tuple[int, int, list[str | None], list[dict], list[dict]]:
    """Hits of one text, joined with those that earlier automata found in it."""
    words = tidy(text)
    n = len(words)
    ids = set(before["items"]) if before else set()
    runs = [(r["first"], r["last"]) for r in before["runs"]] if before else []
    for first, last, owners in items.hits(words):
        runs.append((first, last))
        ids |= owners
    if not runs:
        return n, 0, [], [], []
    merged: list[list[int]] = []
    for first, last in sorted(runs):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    places = [m.span() for m in _WORD.finditer(text or "")]
    spans = [{"start": places[a][0], "end": places[b][1]} for a, b in merged]
    hit = sum(b - a + 1 for a, b in merged)
    names = sorted(ids, key=lambda i: (i is not None, i or ""))
    return n, hit, names, [{"first": a, "last": b} for a, b in merged], spans


_FIELDS = {
    "n_words": pa.int64(),
    "n_hit": pa.int64(),
    "items": pa.list_(pa.string()),
    "runs": pa.list_(pa.struct({"first": pa.int32(), "last": pa.int32()})),
    "spans": pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()})),
}


def scanner(shared: Broadcast) -> Callable[..., Column]:
    """A column function of the text and the finds of earlier automata."""

    @F.arrow_udf(SCAN)
    def scan(texts: pa.Array, before: pa.Array) -> pa.Array:
        items = built(*shared.value)
        rows = [
            dict(zip(_FIELDS, find(items, a, b), strict=True))
            for a, b in zip(texts.to_pylist(), before.to_pylist(), strict=True)
        ]
        give_back()
        return pa.array(rows, pa.struct(_FIELDS))

    return scan


def item_groups(benchmark: DataFrame) -> list[DataFrame]:
    """Different items with words, cut by a hash into frames of about MAX_ITEM_BYTES of text."""
    items = (
        benchmark.select(F.col("item_id").cast("string").alias("id"), "text")
        .where(F.col("text").rlike(_WORD.pattern))
        .distinct()
    )
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    groups = -(-size // MAX_ITEM_BYTES) or 1
    part = F.pmod(F.xxhash64("id", "text"), F.lit(groups))
    return [items.where(part == g) for g in range(groups)]


def scan_items(
    docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text"
) -> DataFrame:
    """Add a column ``name`` of type SCAN with the benchmark windows found in each text.

    ``runs`` are the hit words by number, ``spans`` the same runs as character ranges of the
    original text. The text is scanned once by one automaton; only items beyond the size bound
    take another scan.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    found: Column = F.lit(None).cast(SCAN)
    groups = item_groups(benchmark)
    for group in groups:
        rows = [(r["id"], r["text"]) for r in group.collect()]  # of bounded size
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))
        docs = docs.withColumn(name, scanner(shared)(F.col(text), found))
        if len(groups) > 1:
            docs = materialize(docs)
        found = F.col(name)
    return docs


def find_contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans of every document.

    A window is WINDOW consecutive words of an item, or a shorter item as a whole; a document
    word inside any occurrence of a window is hit. Null and wordless texts have no words and no
    hits, null and wordless items no windows. Items are told apart by item_id, so rows repeated
    with one id are one item; those with a null id are one item too, which counts in n_items and
    has no text in items_sha256. Repeated documents are judged row by row. An empty table on either side gives no hits; further columns are ignored.
    """
    docs = scan_items(documents.select("doc_id", "text"), benchmark, "found")
    return docs.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
        "found.spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any window of the benchmark, with all their columns.

    Documents of null, empty or wordless text stay, as do all for a benchmark without words; of
    repeated rows each stays or goes by its own text. Ids are not read.
    """
    (name,) = fresh(docs, "benchmark_scan")
    return scan_items(docs, benchmark, name).where(F.col(f"{name}.n_hit") == 0).drop(name)


ORACLE = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
docs AS (SELECT doc_id, CASE WHEN w IS NULL THEN [] ELSE w END AS w FROM words),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS id, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i FROM sized)),
placed AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS i
        FROM docs, (SELECT DISTINCT k FROM wins) WHERE len(w) >= k)),
hits AS (SELECT doc_id, i, p.k, id FROM placed p JOIN wins q ON p.k = q.k AND p.win = q.win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
