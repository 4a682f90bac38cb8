"""Removal of byte strings that repeat across documents, with two-stage suffix sorting.

Suffixes of the whole corpus are not sorted in one piece. Every LENGTH-byte string holds a
sampled SEED-byte gram (a minimum of hashes, so equal strings sample alike). Grams that stand in
one document only cannot lie in a repeated string; around the others the bytes of all strings
that hold the gram are cut out and dealt by the gram, so equal strings meet in one block, and
each block sorts its own suffixes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import (
    bound_batches,
    materialize,
    mix64,
    powers,
    prefix_hashes,
    small_side,
    text_slices,
)

LENGTH, SEED = 50, 24
#: The bits of a gram's hash that are kept.
UPPER = np.uint64(0xFFFFFFFFFFFF0000)
#: Grams of a string, less one: bytes on either side of a gram that its strings reach.
SIDE = LENGTH - SEED
WIDTH = 2 * SIDE + SEED
#: Bytes of text whose grams are compared in one task, and blocks of suffixes for each of them.
PART_BYTES, BLOCKS = 32 << 20, 8
#: Occurrences that a task reduces to one entry a gram before it sends them.
HELD = 1 << 20
#: Occurrences of one gram that a block takes; beyond it its strings are grouped by Spark.
HOT = 100_000
#: Hot grams that are listed one by one; beyond it a filter of so many bits tells them. Grams that
#: it takes by mistake go the way of the hot ones too, so results stay exact.
HOT_LIST, HOT_BITS = 1 << 20, 1 << 28
#: A string that has more than one of so many hot rows is frequent: fewer than so many can be.
FREQUENT = 2000
#: Bytes of the filter of shared grams that may be broadcast; beyond it they are joined by id.
FILTER_BYTES, BITS, HASHES = 32 << 20, 16, 3
#: Removed runs that may be broadcast, some 40 bytes each; beyond it they are joined by id.
SMALL_SPANS = 1_000_000


def sliding(x: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over every ``size`` neighbours, by doubling."""
    have = 1
    while 2 * have <= size:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (size - have)], x[size - have :]) if size > have else x


def grams_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, (places, hashes) of its sampled grams, in order of place."""
    hashes = np.zeros(0, dtype=np.uint64)
    if len(data) >= SEED:
        prefix = prefix_hashes(data)
        n = len(data) - SEED + 1
        hashes = mix64((prefix[SEED:] - prefix[:n]) * powers(len(prefix))[1][:n])
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        if b - a < LENGTH:
            yield np.zeros(0, dtype=np.int64), hashes[:0]
            continue
        own = hashes[a : b - SEED + 1]
        least = sliding(own, SIDE + 1, np.minimum)  # of each string
        around = np.pad(least, SIDE, constant_values=0)
        at = np.flatnonzero(own == sliding(around, SIDE + 1, np.maximum))
        yield at, own[at]


# ---------------------------------------------------------------- grams of several documents


def counted(docs: DataFrame, parts: int) -> DataFrame:
    """(part, docs, counts, keys, places, times, tops): sampled grams reduced and dealt by hash.

    An entry is a gram with the least document of those a task held at a time. Entries of several
    occurrences are told by place, with the number of them and their greatest document.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, last, data, offsets in text_slices(batch.column(1)):
                found = [h for _, h in grams_of(data, offsets)]
                keys = np.concatenate([*found, np.zeros(0, np.uint64)]) & UPPER
                held.append((keys, np.repeat(ids[first:last], [len(h) for h in found])))
                size += len(keys)
                if size > HELD:
                    yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield send(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def send(keys: np.ndarray, who: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, low, top, times = reduced(keys[order], who[order], who[order], np.ones(len(keys), np.int64))
        part = part_of(keys, parts)
        order = np.lexsort((low, part))
        keys, low, top, times, part = (x[order] for x in (keys, low, top, times, part))
        columns: list[list] = [[], [], [], [], [], [], []]
        names, starts = np.unique(part, return_index=True)
        for name, a, b in zip(names.tolist(), starts, [*starts[1:], len(part)], strict=False):
            docs, n = np.unique(low[a:b], return_counts=True)
            more = np.flatnonzero(times[a:b] > 1)
            columns[0].append(name)
            columns[1].append(docs.tobytes())
            columns[2].append(n.astype("<u4").tobytes())
            columns[3].append(narrow(keys[a:b]))
            columns[4].append(more.astype("<u4").tobytes())
            columns[5].append(times[a:b][more].tobytes())
            columns[6].append(top[a:b][more].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
            ["part", "docs", "counts", "keys", "places", "times", "tops"],
        )

    return docs.mapInArrow(
        sample,
        "part long, docs binary, counts binary, keys binary, places binary, times binary, tops binary",
    )


def reduced(
    keys: np.ndarray, low: np.ndarray, top: np.ndarray, times: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each of the sorted keys: least and greatest document, occurrences."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(starts):
        return keys, low, top, times
    return (
        keys[starts],
        np.minimum.reduceat(low, starts),
        np.maximum.reduceat(top, starts),
        np.add.reduceat(times, starts),
    )


def sampled(docs: DataFrame, parts: int, hot: Broadcast) -> DataFrame:
    """(part, docs, counts, keys): different sampled grams of documents, without the hot ones."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, last, data, offsets in text_slices(batch.column(1)):
                found = [np.unique(h & UPPER) for _, h in grams_of(data, offsets)]
                counts = np.array([len(h) for h in found])
                keys = np.concatenate([*found, np.zeros(0, np.uint64)])
                of = np.repeat(np.arange(last - first), counts)
                rest = ~hot.value.holds(keys)
                keys, of = keys[rest], of[rest]
                part = part_of(keys, parts)
                order = np.argsort(part, kind="stable")
                keys, of, part = keys[order], of[order], part[order]
                names, starts = np.unique(part, return_index=True)
                ends = np.append(starts[1:], len(part))
                columns: list[list] = [[], [], [], []]
                for name, a, b in zip(names.tolist(), starts, ends, strict=False):
                    who, n = np.unique(of[a:b], return_counts=True)
                    columns[0].append(name)
                    columns[1].append(ids[first:last][who].tobytes())
                    columns[2].append(n.astype("<u4").tobytes())
                    columns[3].append(narrow(keys[a:b]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                    ["part", "docs", "counts", "keys"],
                )

    return docs.mapInArrow(sample, "part long, docs binary, counts binary, keys binary")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def read_grams(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(gram, document) of the rows of a part, in order of entry."""
    who = np.frombuffer(b"".join(group["docs"]), dtype=np.int64)
    who = np.repeat(who, np.frombuffer(b"".join(group["counts"]), dtype="<u4"))
    return widen(b"".join(group["keys"])), who


def often_of(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(gram, occurrences) of the grams of a part that stand in several documents."""
    keys, low = read_grams(group)
    top, times = low.copy(), np.ones(len(keys), dtype=np.int64)
    sizes = [len(x) // 6 for x in group["keys"]]
    more = np.frombuffer(b"".join(group["places"]), dtype="<u4").astype(np.int64)
    more += np.repeat(np.cumsum([0, *sizes[:-1]]), [len(x) // 4 for x in group["places"]])
    top[more] = np.frombuffer(b"".join(group["tops"]), dtype=np.int64)
    times[more] = np.frombuffer(b"".join(group["times"]), dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    keys, low, top, times = reduced(keys[order], low[order], top[order], times[order])
    return keys[low != top], times[low != top]


def shared_of(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(gram, document) of the grams of a part that stand in several documents."""
    keys, who = read_grams(group)
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    if not len(starts):
        return keys, who
    sizes = np.diff(np.append(starts, len(keys)))
    several = np.minimum.reduceat(who, starts) != np.maximum.reduceat(who, starts)
    keep = np.repeat(several, sizes)
    return keys[keep], who[keep]


def gram_filters(grams: DataFrame, hot: int) -> DataFrame:
    """(part, bits, filter, hot): a Bloom filter of each part's shared grams, and the hot grams."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys, often = often_of(group)
        many = keys[often > hot]
        keys = keys[often <= hot]
        bits = max(64, BITS * len(keys))
        flags = np.zeros((bits + 63) // 64 * 64, dtype=np.uint8)
        for k in range(HASHES):
            flags[bit_of(keys, np.uint64(bits), k)] = 1
        return pd.DataFrame(
            {
                "part": [group["part"].iloc[0]],
                "bits": [bits],
                "filter": [np.packbits(flags, bitorder="little").tobytes()],
                "hot": [many.tobytes()],
            }
        )

    return grams.groupBy("part").applyInPandas(
        build, "part long, bits long, filter binary, hot binary"
    )


def bit_of(keys: np.ndarray, bits: np.ndarray | np.uint64, which: int) -> np.ndarray:
    return (mix64(keys + np.uint64(which)) % bits).astype(np.int64)


def gram_lists(grams: DataFrame) -> DataFrame:
    """(doc_id, grams): each document's shared grams."""

    def split(group: pd.DataFrame) -> pd.DataFrame:
        keys, who = shared_of(group)
        order = np.lexsort((keys, who))
        keys, who = keys[order], who[order]
        starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))[: len(who)]
        ends = np.append(starts[1:], len(who))
        lists = [np.unique(keys[a:b]).tobytes() for a, b in zip(starts, ends, strict=False)]
        return pd.DataFrame({"doc_id": who[starts], "grams": lists})

    rows = grams.groupBy("part").applyInPandas(split, "doc_id long, grams binary")
    return rows.groupBy("doc_id").agg(F.collect_list("grams").alias("grams"))


@dataclass(frozen=True)
class GramFilter:
    """All parts' filters side by side; false positives only cost a look at their bytes."""

    bits: np.ndarray
    starts: np.ndarray
    data: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        part = part_of(keys, len(self.bits))
        keys = keys >> np.uint64(16) << np.uint64(16)
        out = self.bits[part] > 0
        for k in range(HASHES):
            at = bit_of(keys, np.maximum(self.bits[part], np.uint64(1)), k)
            byte = self.data[np.minimum(self.starts[part] + (at >> 3), len(self.data) - 1)]
            out &= (byte >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


@dataclass(frozen=True)
class HotGrams:
    """Grams of more than HOT occurrences: a sorted list, or a filter of bounded size."""

    grams: np.ndarray
    bits: np.ndarray

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.bits):
            return listed(keys, self.grams)
        keys = keys >> np.uint64(16) << np.uint64(16)
        out = np.ones(len(keys), dtype=bool)
        for k in range(HASHES):
            at = bit_of(keys, np.uint64(len(self.bits) * 8), k)
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return out


def hot_grams(filters: DataFrame) -> HotGrams:
    """The hot grams of all parts; what reaches the driver has HOT_LIST entries or HOT_BITS bits."""
    rows = filters.where("length(hot) > 0").select("hot")
    count = (rows.agg(F.sum(F.length("hot")).alias("n")).first()["n"] or 0) // 8
    none = np.zeros(0, dtype=np.uint64)
    if count <= HOT_LIST:
        grams = [np.frombuffer(r["hot"], dtype=np.uint64) for r in rows.collect()]
        return HotGrams(np.sort(np.concatenate([none, *grams])), none.astype(np.uint8))
    size = HOT_BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                keys = np.frombuffer(blob, dtype=np.uint64)
                for a in range(0, len(keys), 1 << 16):
                    some = keys[a : a + (1 << 16)]
                    at = np.concatenate([bit_of(some, np.uint64(size), k) for k in range(HASHES)])
                    flags = np.int64(1) << (at & 31)
                    yield pa.RecordBatch.from_arrays([pa.array(at >> 5), pa.array(flags)], ["word", "flag"])

    marks = rows.mapInArrow(mark, "word long, flag long").groupBy("word").agg(F.bit_or("flag").alias("flag"))
    bits = np.zeros(size // 32, dtype="<u4")
    got = marks.select("word", "flag").toArrow()  # a row for each 32 bits of the filter at most
    bits[got.column("word").to_numpy()] = got.column("flag").to_numpy().astype("<u4")
    return HotGrams(none, bits.view(np.uint8))


def join_filters(rows: list, parts: int) -> GramFilter:
    bits, starts = np.zeros(parts, dtype=np.uint64), np.zeros(parts, dtype=np.int64)
    blobs, size = [b"\0"], 1
    for row in rows:
        bits[row["part"]], starts[row["part"]] = row["bits"], size
        blobs.append(row["filter"])
        size += len(row["filter"])
    return GramFilter(bits, starts, np.frombuffer(b"".join(blobs), dtype=np.uint8))


def narrow(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def widen(low: bytes) -> np.ndarray:
    """Gram hashes of which the upper 48 bits were kept; the others are 0."""
    rows = np.frombuffer(low, dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(rows), 8), dtype=np.uint8)
    out[:, 2:] = rows
    return out.view(np.uint64).ravel()


# ---------------------------------------------------------------- strings around shared grams


def cut_outs(
    text: np.ndarray, at: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(WIDTH bytes around each gram, bytes that exist before it, bytes that exist behind it)."""
    framed = np.pad(text, SIDE)
    bytes_ = np.lib.stride_tricks.sliding_window_view(framed, WIDTH)[at]
    return bytes_, np.minimum(at, SIDE), np.minimum(len(text) - SEED - at, SIDE)


def listed(keys: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return np.isin(keys >> np.uint64(16) << np.uint64(16), grams)


def found_in(
    batch: pa.RecordBatch, wanted: Callable[[np.ndarray], np.ndarray] | None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(doc_id, bytes, places, hashes) of the wanted grams in a batch of (doc_id, text, lists).

    Without ``wanted`` the lists of the documents tell.
    """
    ids = batch.column(0).to_pylist()
    lists = batch.column(2).to_pylist() if wanted is None else None
    for first, _, data, offsets in text_slices(batch.column(1)):
        for i, (at, keys) in enumerate(grams_of(data, offsets)):
            if lists is None:
                keep = wanted(keys)
            else:
                keep = listed(keys, np.frombuffer(b"".join(lists[first + i]), dtype=np.uint64))
            if keep.any():
                yield ids[first + i], data[offsets[i] : offsets[i + 1]], at[keep], keys[keep]


def blocks_of(docs: DataFrame, blocks: int, wanted: Callable | None) -> DataFrame:
    """Byte rows around the wanted grams, dealt to blocks by the gram."""
    schema = "block long, docs binary, places binary, sides binary, bytes binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for key, text, at, keys in found_in(batch, wanted):
                pieces, before, behind = cut_outs(text, at)
                held.append((np.full(len(at), key), at, before, behind, pieces, keys))
                size += pieces.nbytes
                if size > 16 << 20:
                    yield block_batch(held, blocks)
                    held, size = [], 0
        if held:
            yield block_batch(held, blocks)

    return docs.mapInArrow(cut, schema)


def block_batch(held: list[tuple], blocks: int) -> pa.RecordBatch:
    who, at, before, behind, pieces, keys = (np.concatenate(x) for x in zip(*held, strict=True))
    block = part_of(keys, blocks)
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    rows = [order[a:b] for a, b in zip(starts, [*starts[1:], len(order)], strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names),
            pa.array([who[r].tobytes() for r in rows], pa.binary()),
            pa.array([at[r].tobytes() for r in rows], pa.binary()),
            pa.array([np.stack([before[r], behind[r]], 1).astype(np.uint8).tobytes() for r in rows], pa.binary()),
            pa.array([pieces[r].tobytes() for r in rows], pa.binary()),
        ],
        ["block", "docs", "places", "sides", "bytes"],
    )


# ---------------------------------------------------------------- two-stage sorting


def suffix_order(symbols: np.ndarray, ends: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes in order, as row * columns + column.

    ``symbols`` has one string per row, 0 from its end (``ends``) on. Suffixes smaller than
    their successors are sorted directly, by LENGTH bytes at least; every other suffix is
    induced: buckets of the first symbol are scanned upwards, and a suffix found puts the one
    before it, if that is larger than its successor, behind those already in its bucket.
    """
    rows, columns = symbols.shape
    falls = np.zeros((rows, columns), dtype=bool)  # larger than its successor
    for c in range(columns - 2, -1, -1):
        here, nxt = symbols[:, c], symbols[:, c + 1]
        falls[:, c] = (here > nxt) | ((here == nxt) & falls[:, c + 1])
    falls &= symbols > 0
    needed = wanted.copy()  # a falling suffix needs its successor
    for c in range(1, columns):
        needed[:, c] |= needed[:, c - 1] & falls[:, c - 1]
    needed &= np.arange(columns) <= ends[:, None]

    flat, fall, need = symbols.ravel(), falls.ravel(), needed.ravel()
    direct = np.flatnonzero(need & ~fall & (flat > 0))
    direct = direct[np.lexsort(words_at(symbols, direct)[::-1])]
    firsts = np.searchsorted(flat[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def induce(scan: np.ndarray, symbol: int) -> np.ndarray:
        """Deal the predecessors of a scanned run; those of the same bucket are returned."""
        before = scan[scan % columns > 0] - 1
        before = before[need[before] & fall[before]]
        kinds = flat[before]
        same = before[kinds == symbol]
        before, kinds = before[kinds != symbol], kinds[kinds != symbol]
        order = np.argsort(kinds, kind="stable")
        names, starts = np.unique(kinds[order], return_index=True)
        for name, a, b in zip(names.tolist(), starts, [*starts[1:], len(order)], strict=False):
            induced[name].append(before[order[a:b]])
        return same

    induce(np.flatnonzero(need & (flat == 0)), 0)
    for symbol in range(1, 256):
        run = np.concatenate(induced[symbol]) if induced[symbol] else direct[:0]
        while len(run):
            out.append(run)
            run = induce(run, symbol)
        run = direct[firsts[symbol] : firsts[symbol + 1]]
        if len(run):
            out.append(run)
            induce(run, symbol)
    order = np.concatenate(out) if out else direct
    return order[wanted.ravel()[order]]


def words_at(symbols: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Seven numbers per place that order as its first 56 symbols."""
    columns = symbols.shape[1]
    wide = np.pad(symbols, ((0, 0), (0, 56)))
    at = (places // columns) * (columns + 56) + places % columns
    views = np.lib.stride_tricks.as_strided(
        wide.ravel(), (wide.size - 55, 56), (1, 1), writeable=False
    )
    return list(np.ascontiguousarray(views[at]).view(">u8").astype(np.uint64).T)


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """Common symbols of each place with the one before it in order, 56 at most; 0 for the first.

    ``words`` are the numbers of ``words_at``, one column per place.
    """
    out = np.zeros(words.shape[1], dtype=np.int64)
    if words.shape[1] < 2:
        return out
    differ = words[:, 1:] ^ words[:, :-1]
    which = (differ != 0).argmax(axis=0)
    first = np.take_along_axis(differ, which[None, :], axis=0)[0]
    same = np.zeros(len(first), dtype=np.int64)  # leading zero bytes of the first difference
    for byte in range(1, 8):
        same += first < np.uint64(1 << (8 * byte))
    out[1:] = np.where(first == 0, 56, 8 * which + same)
    return out


def first_owners(
    pieces: np.ndarray, before: np.ndarray, behind: np.ndarray, owner: np.ndarray
) -> np.ndarray:
    """For each piece and each string start in it, the least owner of an equal string."""
    symbols = np.zeros((len(pieces), WIDTH + 1), dtype=np.uint8)
    symbols[:, :WIDTH] = np.minimum(pieces, 254) + 1  # 254 and 255 are no bytes of UTF-8
    column = np.arange(WIDTH + 1)
    inside = (column >= SIDE - before[:, None]) & (column < SIDE + SEED + behind[:, None])
    symbols[~inside] = 0
    starts = np.zeros_like(inside)
    starts[:, : SIDE + 1] = inside[:, : SIDE + 1] & (column[: SIDE + 1] <= behind[:, None])
    order = suffix_order(symbols, SIDE + SEED + behind, starts)
    out = np.full((len(pieces), SIDE + 1), np.iinfo(np.int64).max)
    if len(order):
        heads = common_prefixes(np.stack(words_at(symbols, order))) < LENGTH
        row, col = order // (WIDTH + 1), order % (WIDTH + 1)
        least = np.minimum.reduceat(owner[row], np.flatnonzero(heads))
        out[row, col] = least[np.cumsum(heads) - 1]
    return out


def repeated_spans(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, end) of bytes whose strings start in a smaller document, merged per block."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        who = np.frombuffer(b"".join(group["docs"]), dtype=np.int64)
        at = np.frombuffer(b"".join(group["places"]), dtype=np.int64)
        sides = np.frombuffer(b"".join(group["sides"]), dtype=np.uint8).reshape(-1, 2)
        pieces = np.frombuffer(b"".join(group["bytes"]), dtype=np.uint8).reshape(-1, WIDTH)
        whole = np.concatenate([pieces, sides], axis=1)
        _, kind, of = np.unique(
            whole.view(f"V{WIDTH + 2}").ravel(), return_index=True, return_inverse=True
        )
        owner = np.full(len(kind), np.iinfo(np.int64).max)
        np.minimum.at(owner, of, who)
        sides = sides[kind].astype(np.int64)
        least = first_owners(pieces[kind], sides[:, 0], sides[:, 1], owner)
        spans = []
        for a in range(0, len(who), 1 << 18):  # one bound on memory
            row, col = np.nonzero(least[of[a : a + (1 << 18)]] < who[a : a + (1 << 18), None])
            spans.append(merged(who[a + row], at[a + row] - SIDE + col))
        return pd.DataFrame(
            {k: np.concatenate(v) for k, v in zip(("doc_id", "start", "end"), zip(*spans, strict=True), strict=True)}
        )

    return blocks.groupBy("block").applyInPandas(settle, "doc_id long, start long, end long")


def merged(who: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of the LENGTH-byte strings that start there, per document."""
    order = np.lexsort((start, who))
    who, start = who[order], start[order]
    new = np.ones(len(who), dtype=bool)
    new[1:] = (who[1:] != who[:-1]) | (start[1:] > start[:-1] + LENGTH)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(who)) - 1 if len(who) else head
    return who[head], start[head], start[tail] + LENGTH


def hot_spans(docs: DataFrame, hot: Broadcast) -> DataFrame:
    """The spans around grams of very many documents: each string is a row, grouped by Spark.

    The owners come from a grouping with a map-side part. Those of frequent strings, fewer than
    FREQUENT by their definition, are broadcast to the rows; the rows of all other strings are
    joined with their owners, so no key of that shuffle has more than one in FREQUENT of them.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, at, _ in found_in(batch, hot.value.holds):
                starts = np.unique((at[:, None] - np.arange(SIDE + 1)).ravel())
                starts = starts[(starts >= 0) & (starts + LENGTH <= len(text))]
                for a in range(0, len(starts), 1 << 16):
                    some = starts[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(some), key), pa.int64()),
                            pa.array(some),
                            pa.array([text[i : i + LENGTH].tobytes() for i in some], pa.binary()),
                        ],
                        ["doc_id", "start", "string"],
                    )

    rows = materialize(docs.mapInArrow(strings, "doc_id long, start long, string binary"))
    owners = materialize(
        rows.groupBy("string")
        .agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("top"), F.count("*").alias("n"))
        .where("owner < top")
    )
    bound = (owners.agg(F.sum("n").alias("n")).first()["n"] or 0) // FREQUENT
    often = F.broadcast(owners.where(F.col("n") > bound + 1).select("string", "owner"))
    rare = owners.where(F.col("n") <= bound + 1).select("string", "owner")
    found = rows.join(often, "string").unionByName(
        rows.join(often.select("string"), "string", "left_anti").join(rare, "string")
    )
    return found.where("owner < doc_id").select(
        "doc_id", "start", (F.col("start") + LENGTH).alias("end")
    )


# ---------------------------------------------------------------- the operator


def whole_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, n) of documents whose whole text, of LENGTH bytes at least, a smaller id has."""
    keyed = materialize(
        docs.where(F.octet_length("text") >= LENGTH).select(
            "doc_id",
            F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"),
            F.octet_length("text").cast("long").alias("n"),
        )
    )
    owners = keyed.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.count("*").alias("c"))
    return materialize(
        keyed.join(owners.where("c > 1"), "digest")
        .where("doc_id <> owner")
        .select("doc_id", "n")
        .distinct()
    )


def joined_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, spans): the maximal removed runs of each document."""
    kind = "doc_id long, spans array<struct<start long, end long>>"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
        for batch in batches:
            runs = [
                [{"start": a, "end": b} for a, b in union(x)] for x in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(runs, shape)], ["doc_id", "spans"]
            )

    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return lists.mapInArrow(join, kind)


def remove_repeats(
    documents: DataFrame,
    hot: int = HOT,
    part_bytes: int = PART_BYTES,
    filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, spans and kept (the bytes that stay) of every document.

    Removed is each byte covered by a LENGTH-byte string that also starts in a document with a
    smaller doc_id; strings are judged on the input. ``spans`` are the maximal removed runs.

    Of equal texts only the one with the smallest id is searched; the others go as a whole if
    they have LENGTH bytes. Null text is empty. A document with null id is left as it is and
    removes nothing. Rows repeated with one id are one document: they are judged against smaller
    ids, not against each other. An empty table gives no rows; further columns are ignored.
    """
    bound_batches(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id is not null")
    copies = whole_copies(named)
    texts = named.join(small_side(copies.select("doc_id")), "doc_id", "left_anti")
    size = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = -(-size // part_bytes) or 1
    filters = materialize(gram_filters(counted(texts, parts), hot))
    sizes = filters.agg(F.sum(F.length("filter")).alias("n")).first()["n"] or 0
    found_hot = hot_grams(filters)
    many = docs.sparkSession.sparkContext.broadcast(found_hot)
    if sizes <= filter_bytes:
        found = filters.select("part", "bits", "filter").collect()  # of checked size
        shared = docs.sparkSession.sparkContext.broadcast(join_filters(found, parts))

        def wanted(keys: np.ndarray) -> np.ndarray:
            return shared.value.holds(keys) & ~many.value.holds(keys)

        blocks = blocks_of(texts, parts * BLOCKS, wanted)
    else:
        lists = texts.join(gram_lists(sampled(texts, parts, many)), "doc_id").select("doc_id", "text", "grams")
        blocks = blocks_of(lists, parts * BLOCKS, None)
    spans = repeated_spans(blocks)
    if len(found_hot.grams) or len(found_hot.bits):
        spans = spans.unionByName(hot_spans(texts, many))
    spans = spans.unionByName(
        copies.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    )
    removed = materialize(joined_spans(spans))
    runs = removed.agg(F.sum(F.size("spans") + 1).alias("n")).first()["n"] or 0
    side = F.broadcast(removed) if runs <= SMALL_SPANS else removed
    whole = named.join(side, "doc_id", "left").select("doc_id", "text", "spans")
    rest = docs.where("doc_id is null").withColumn(
        "spans", F.lit(None).cast("array<struct<start:bigint,end:bigint>>")
    )

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                lists = batch.column(2)[first:last].to_pylist()
                runs = [[(s["start"], s["end"]) for s in x or []] for x in lists]
                kept = [
                    keep(data[a:b], r)
                    for a, b, r in zip(offsets[:-1], offsets[1:], runs, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first:last],
                        pa.array(np.diff(offsets)),
                        pa.array(
                            [[{"start": a, "end": b} for a, b in r] for r in runs], kind
                        ),
                        pa.array(kept, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    return whole.unionByName(rest).mapInArrow(
        apply, "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept binary"
    )


def union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keep(text: np.ndarray, runs: list[tuple[int, int]]) -> bytes:
    stays = np.ones(len(text), dtype=bool)
    for a, b in runs:
        stays[a:b] = False
    return text[stays].tobytes()


def repeat_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return remove_repeats(documents).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
