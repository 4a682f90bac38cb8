"""Best-fit packing of tokenized documents, with underfull bins merged up a tree.

Tasks pack the pieces they hold, a bounded number of tokens at a time. Nearly full bins are done.
The others are items of the next round, of the size of their fill: nodes of a tree take a bounded
number of them each and pack them into each other, and neighbouring nodes are merged for the next
round as long as a node can hold the bins that are still underfull.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import bound_batches, give_back, materialize, small_side
from quillwatch.llm.token_ids import default_vocabulary, encoder

CAPACITY = 2048
#: Id that ends every document.
END_ID = 0
#: Tokens that a task packs at a time (16 MB as 32-bit ids).
LOCAL_TOKENS = 4 << 20
#: A bin with at most this many tokens of room is done.
NEARLY_FULL = 8
#: Underfull bins that a leaf of the tree takes, in expectation, and that a merged node may take.
LEAF_BINS, NODE_BINS = 1 << 14, 1 << 16
#: Bits of a bin's number within its group of LOCAL_TOKENS, and of the group within its task.
BIN_BITS, GROUP_BITS = 24, 16


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item, placed by descending size, and the fill of each bin.

    An item goes to the bin with the least room that holds it, among those to the latest used.
    """
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    fills: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            to = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, to = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = to, fills[to]
        fills[to] += size
        by_room[room - size].append(to)
        rooms |= 1 << (room - size)
    return bins, offsets, np.array(fills, dtype=np.int64)


def pieces_of(ids: np.ndarray, capacity: int) -> list[np.ndarray]:
    """The ids in one piece if they fit a sequence, else cut from the end, the rest first."""
    head = len(ids) % capacity or capacity
    return [ids[:head], *(ids[a : a + capacity] for a in range(head, len(ids), capacity))]


LOCAL = (
    "doc_id bigint, piece int, start bigint, length bigint, ids binary, doc_tokens bigint, "
    "bin bigint, offset bigint, fill bigint, done boolean"
)


def packed_locally(
    docs: DataFrame, path: str, capacity: int, nearly_full: int, local_tokens: int
) -> DataFrame:
    """Pieces with the bin, and offset in it, that their task gave them (LOCAL)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task, group = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for key, text in zip(*batch.columns, strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], dtype="<u4")
                start = 0
                for n, part in enumerate(pieces_of(ids, capacity)):
                    rows.append((key.as_py(), n, start, len(part), part.tobytes(), len(ids)))
                    start += len(part)
                    held += len(part)
                    if held >= local_tokens:
                        yield placed(rows, (task << GROUP_BITS) + group)
                        rows, held, group = [], 0, group + 1
            give_back()
        if rows:
            yield placed(rows, (task << GROUP_BITS) + group)

    def placed(rows: list[tuple], group: int) -> pa.RecordBatch:
        key, piece, start, length, ids, total = zip(*rows, strict=True)
        bins, offsets, fills = best_fit(np.array(length, dtype=np.int64), capacity)
        done = fills[bins] >= capacity - nearly_full
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        columns = [
            pa.array(x, kind)
            for x, kind in zip((key, piece, start, length, ids, total), kinds, strict=True)
        ]
        own = [pa.array((group << BIN_BITS) + bins), pa.array(offsets), pa.array(fills[bins])]
        names = [c.split()[0] for c in LOCAL.split(", ")]
        return pa.RecordBatch.from_arrays([*columns, *own, pa.array(done)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, LOCAL)


def merged_once(items: DataFrame, capacity: int) -> DataFrame:
    """Items (node, item, size) packed into each other: item, into, base, fill.

    ``into`` is the item that opened the bin, ``base`` the offset there, ``fill`` what it holds now.
    """

    def merge(table: pa.Table) -> pa.Table:
        # in an order of their own, so that a task that is run again packs alike
        table = table.sort_by([("item", "ascending")])
        item = table["item"].to_numpy()
        bins, offsets, fills = best_fit(table["size"].to_numpy(), capacity)
        opened = np.zeros(len(fills), dtype=np.int64)
        first = offsets == 0
        opened[bins[first]] = item[first]
        return pa.table(
            {"item": item, "into": opened[bins], "base": offsets, "fill": fills[bins]}
        )

    return items.groupBy("node").applyInArrow(
        merge, "item bigint, into bigint, base bigint, fill bigint"
    )


def merged_bins(
    underfull: DataFrame, capacity: int, nearly_full: int, leaf_bins: int, node_bins: int
) -> DataFrame:
    """Where the underfull bins (item, size) end: bin, into, base. One row for each of them.

    Rounds go on while at least two nodes can be merged into one of at most ``node_bins`` bins.
    Bins are dealt to the leaves by a hash, so those that stay underfull have partners of no
    other kind elsewhere, and a round more would not find better ones.
    """
    items = materialize(underfull)
    bins = items.count()
    nodes = max(1, -(-bins // leaf_bins))
    items = items.withColumn("node", F.pmod(F.xxhash64("item"), F.lit(nodes)))
    ends = None
    while True:
        moves = materialize(merged_once(items, capacity))
        if ends is None:
            ends = moves.select(F.col("item").alias("bin"), "into", "base")
        else:
            later = moves.select(
                F.col("item").alias("into"), F.col("into").alias("to"), F.col("base").alias("more")
            )
            ends = ends.join(later, "into", "left").select(
                "bin",
                F.coalesce("to", "into").alias("into"),
                (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"),
            )
            ends = materialize(ends)
        left = moves.where((F.col("base") == 0) & (F.col("fill") < capacity - nearly_full))
        bins = left.count()
        fan = nodes if bins <= node_bins else node_bins * nodes // bins
        if nodes == 1 or fan < 2:
            return ends
        leaf = F.pmod(F.xxhash64("into"), F.lit(nodes))
        nodes = -(-nodes // fan)
        items = left.select(
            F.col("into").alias("item"), F.col("fill").alias("size"),
            F.floor(leaf / fan).alias("node"),
        )


def pack_best_fit(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    nearly_full: int = NEARLY_FULL,
    local_tokens: int = LOCAL_TOKENS,
    leaf_bins: int = LEAF_BINS,
    node_bins: int = NODE_BINS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the token ids as little-endian unsigned 32-bit numbers; a document is its ids and
    END_ID. A document that fits a sequence stays whole; a longer one is cut into pieces of
    ``capacity`` tokens, the first of which may be shorter. Pieces of a sequence leave no gaps.

    Null text is an empty document of one token. A null id stays null; rows repeated with one id
    are packed each. Pieces of one length are ties, placed in the order read. An empty table gives
    no rows; further columns are ignored.
    """
    bound_batches(docs.sparkSession)
    local = materialize(
        packed_locally(docs, path or default_vocabulary(), capacity, nearly_full, local_tokens)
    )
    underfull = local.where(~F.col("done") & (F.col("offset") == 0))
    ends = merged_bins(
        underfull.select(F.col("bin").alias("item"), F.col("fill").alias("size")),
        capacity, nearly_full, leaf_bins, node_bins,
    )
    columns = ["doc_id", "piece", "start", "length", "ids", "doc_tokens"]
    whole = local.where("done").select(*columns, F.col("bin").alias("sequence_id"), "offset")
    moved = local.where(~F.col("done")).join(small_side(ends), "bin")
    return whole.unionByName(
        moved.select(
            *columns,
            F.col("into").alias("sequence_id"),
            (F.col("offset") + F.col("base")).alias("offset"),
        )
    )


def packing_digests(docs: DataFrame, **options: object) -> DataFrame:
    """``pack_best_fit`` with the CRC-32 of the ids in place of the ids."""
    return pack_best_fit(docs, **options).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id",
        "offset", "doc_tokens",
    )
