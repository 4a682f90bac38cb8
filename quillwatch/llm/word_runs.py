"""Periodic runs of words, from a suffix automaton with link-cut access.

Words of a stretch are appended one by one. The suffixes of the text read so far are a path of
the automaton's link tree, from the state of the newest prefix up to the root; every node of it
is coloured with the end of its last occurrence. Exposing that path recolours it, and the parts
of one old colour that it breaks up are the suffixes that occurred last at one earlier end: with
d the distance of the two ends and m the length of the deepest node of the part, m >= d tells a
square of period d, and d + m words before the newest end have this period. Where the next word
ends it, this is a run.

Only stretches that can hold a run are given to the automaton: each eight words in a row within
a run occur again at a distance of at most a third of its length.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import bound_batches, flushed, mix64

#: A run has at least SHORTEST words and REPEATS periods.
SHORTEST, REPEATS = 24, 3
#: Words in a row that must occur again; SHORTEST >= 3 * GRAM keeps every run.
GRAM = 8
BLANKS = r"[\x20\x09-\x0D]+"
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_RUN_TYPE = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """Parts [a, b) of a word sequence outside of which no run has a word.

    A run of length n and period q <= n / 3 within a part of m words: every GRAM words of it
    stand q <= m / 3 words before or behind once more. Parts are cut until all their grams do.
    Equal hashes of different grams only keep more words.
    """
    if len(words) < SHORTEST:
        return []
    grams = mix64(words.astype(np.uint64) + np.uint64(1))
    step = 1
    while step < GRAM:
        grams = mix64(grams[:-step] * np.uint64(0x9E3779B97F4A7C15) + grams[step:])
        step *= 2
    todo, done = [(0, len(words))], []
    while todo:
        a, b = todo.pop()
        if b - a < SHORTEST:
            continue
        own = grams[a : b - GRAM + 1]
        order = np.argsort(own, kind="stable")
        far = np.diff(order)
        near = (own[order[1:]] == own[order[:-1]]) & (far * REPEATS <= b - a)
        kept = np.zeros(len(own) + 2, dtype=np.int8)
        kept[order[1:][near] + 1] = 1
        kept[order[:-1][near] + 1] = 1
        edges = np.flatnonzero(np.diff(kept))
        parts = [(a + s, a + t + GRAM - 1) for s, t in edges.reshape(-1, 2).tolist()]
        if parts == [(a, b)]:
            done.append((a, b))
        else:
            todo += parts
    return sorted(done)


class Automaton:
    """Suffix automaton of a word sequence, grown one word at a time.

    ``size`` is the length of the longest string of a state, ``link`` its suffix link, ``ends``
    the state of each prefix. Most states have one move, kept in ``by`` and ``to``; the others
    keep the further ones in ``more``.
    """

    def __init__(self) -> None:
        self.size, self.link = array("i", [0]), array("i", [-1])
        self.by, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.ends = array("i")

    def state(self, size: int, link: int, by: int = -1, to: int = -1) -> int:
        self.size.append(size)
        self.link.append(link)
        self.by.append(by)
        self.to.append(to)
        return len(self.size) - 1

    def append(self, word: int) -> None:
        size, link, by, to, more = self.size, self.link, self.by, self.to, self.more
        last = self.ends[-1] if self.ends else 0
        new = self.state(size[last] + 1, 0)
        self.ends.append(new)
        at, known = last, -1
        while at >= 0:
            if by[at] == word:
                known = to[at]
                break
            if by[at] < 0:
                by[at], to[at] = word, new
            elif at in more:
                known = more[at].get(word, -1)
                if known >= 0:
                    break
                more[at][word] = new
            else:
                more[at] = {word: new}
            at = link[at]
        if at < 0:
            return
        if size[known] == size[at] + 1:
            link[new] = known
            return
        twin = self.state(size[at] + 1, link[known], by[known], to[known])
        if known in more:
            more[twin] = dict(more[known])
        link[known] = link[new] = twin
        while at >= 0:
            if by[at] == word:
                if to[at] != known:
                    break
                to[at] = twin
            elif at in more and more[at].get(word) == known:
                more[at][word] = twin
            else:
                break
            at = link[at]


class LastEnds:
    """Last occurrences of all strings as colours of the link tree's nodes, changed by access.

    A solid path goes from a node down to its child of the largest subtree. On a solid path
    neighbours of one colour are one entry (size of the deepest node, colour), the shallowest on
    top of a stack. An access touches O(log n) solid paths, and all accesses together break up
    O(n log n) entries.
    """

    def __init__(self, tree: Automaton) -> None:
        link, size = tree.link, tree.size
        order = np.argsort(np.frombuffer(size, dtype=np.int32), kind="stable")[1:].tolist()
        weight = [1] * len(size)
        for node in reversed(order):
            weight[link[node]] += weight[node]
        heaviest, child = [0] * len(size), [-1] * len(size)
        for node in order:
            up = link[node]
            if weight[node] > heaviest[up]:
                heaviest[up], child[up] = weight[node], node
        top = array("i", [0]) * len(size)
        for node in order:
            up = link[node]
            top[node] = top[up] if child[up] == node else node
        self.tree, self.top = tree, top
        self.entries: dict[int, list[tuple[int, int]]] = {}

    def access(self, end: int, least: int) -> list[tuple[int, int]]:
        """Colour all suffixes of the prefix that ends at ``end``; (length, old end) of the parts.

        Parts shorter than ``least`` words are recoloured but not told.
        """
        size, link, top, entries = self.tree.size, self.tree.link, self.top, self.entries
        node, told = self.tree.ends[end], []
        while node >= 0:
            path, depth = top[node], size[node]
            stack = entries.get(path)
            if stack is None:
                entries[path] = [(depth, end)]
            else:
                deepest = -1
                while stack and stack[-1][0] <= depth:
                    deepest, old = stack.pop()
                    if deepest >= least:
                        told.append((deepest, old))
                if stack and deepest < depth >= least:
                    told.append((depth, stack[-1][1]))
                stack.append((depth, end))
            node = link[path]
        return told


def runs_of(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a word sequence, by start, then period."""
    tree = Automaton()
    for word in words:
        tree.append(word)
    colours = LastEnds(tree)
    n, out = len(words), []
    # length + distance >= SHORTEST and length >= 2 * distance
    least = -(-SHORTEST * (REPEATS - 1) // REPEATS)
    for end in range(n):
        found: dict[int, int] = {}
        for length, old in colours.access(end, least):
            period = end - old
            if (
                length >= (REPEATS - 1) * period
                and length + period >= SHORTEST
                and (end + 1 == n or words[end + 1] != words[end + 1 - period])
            ):
                found[period] = max(found.get(period, 0), length)
        for period, length in found.items():
            out.append((end - period - length + 1, period + length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def text_runs(text: bytes) -> tuple[list[tuple[int, int, int]], bytes]:
    """Runs of a text's words, and the words outside of runs' repeats joined by one space."""
    words = text.split()  # of bytes: at ASCII white space only
    if len(words) < SHORTEST:
        return [], b" ".join(words)
    names: dict[bytes, int] = {}
    numbers = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    runs = []
    for a, b in stretches(numbers):
        runs += [(a + s, n, q) for s, n, q in runs_of(numbers[a:b].tolist())]
    if not runs:
        return [], b" ".join(words)
    runs.sort(key=lambda r: (r[0], r[2]))
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()
    return runs, b" ".join([words[i] for i in kept])


def word_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start, then period), collapsed.

    Words stand between blanks ([\\x20\\x09-\\x0D]) and are compared as they are. A run is a
    stretch of words of smallest period q, of SHORTEST words and REPEATS * q words at least, that
    no neighbouring word extends. ``collapsed`` holds the words joined by one space, less those
    that a run contains after its first q words.

    Null or empty text has no words: no runs, empty ``collapsed``. A null id stays null; rows
    repeated with one id give a row each. An empty table gives no rows; further columns are
    ignored. A text is worked on by one task, with some 200 bytes a word of the stretches that
    can hold runs.
    """
    bound_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                texts = batch.column(1).cast(pa.large_binary())
                for key, text in zip(batch.column(0), texts, strict=True):
                    runs, rest = text_runs(text.as_py() or b"")
                    yield len(rest) + 24 * len(runs), (key.as_py(), runs, rest)

        yield from flushed(rows(), make)

    def make(rows: list[tuple]) -> pa.RecordBatch:
        names = ("start", "length", "period")
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([[dict(zip(names, x, strict=True)) for x in r[1]] for r in rows], _RUN_TYPE),
                pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()),
            ],
            ["doc_id", "runs", "collapsed"],
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        find, f"doc_id bigint, runs {RUNS}, collapsed string"
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the texts, told by id, repeat a part of their words.

    With h the CRC-32 of the id as text, g = h // 10: if h % 10 = 0, the words from a = g % n on
    are replaced by repeats of the first 1 + (n - a) // (3 + g % 8) of them. A null id leaves the
    text as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    changed = F.col("n") > 0
    a, rest = F.col("a"), F.col("n") - F.col("a")
    repeat = F.slice("words", a + 1, F.col("p"))
    more = F.slice(F.flatten(F.array_repeat(repeat, F.ceil(rest / F.col("p")).cast("int"))), 1, rest)
    cut = F.filter(F.split("text", BLANKS), lambda w: w != "")
    return (
        docs.select("doc_id", "text", F.when(h % 10 == 0, cut).alias("words"), g.alias("g"))
        .withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
        .withColumn("a", F.when(changed, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", F.when(changed, 1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int"))
        .select(
            "doc_id",
            F.when(
                changed, F.array_join(F.concat(F.slice("words", 1, a), more), " ")
            ).otherwise(F.col("text")).alias("text"),
        )
    )


def _higher(x: Column, y: Column) -> Column:
    """Order of runs by exact exponent descending, then start, then period."""
    gain = x["length"] * y["period"] - y["length"] * x["period"]
    tie = F.when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(
        F.signum(x["period"] - y["period"])
    )
    return F.when(gain != 0, -F.signum(gain)).otherwise(tie).cast("int")


def run_digests(docs: DataFrame) -> DataFrame:
    """``word_runs`` as counts, the run of the greatest exponent, and digests of all runs and words.

    A document without runs has four nulls in start, length, period and exponent_milli.
    """
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.lit("\n"))
    best = F.get(F.array_sort("runs", _higher), F.lit(0))
    return word_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, lines).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
