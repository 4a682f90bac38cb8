"""Cost-balanced packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwatch.llm.common import bound_batches, give_back
from quillwatch.llm.token_ids import default_vocabulary, encoder, id_type

CAPACITY = 2048
#: Id that ends every document.
END_ID = 1
#: Bytes of text (and one for each document) that are packed together, in expectation.
BLOCK_BYTES = 8 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, for the layers that see one
#: token at a time and for attention within the piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, start, length, ids, doc_tokens.

    ``ids`` are 16-bit numbers while the vocabulary allows, else 32-bit, little-endian.
    """
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long"
    kind = id_type(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype=kind)
                n = len(ids)
                for at in range(0, n, capacity):
                    part = ids[at : at + capacity]
                    rows.append((key, at, len(part), part.tobytes(), n))
                held += ids.nbytes
                if held > 8 << 20:
                    yield piece_batch(rows)
                    rows, held = [], 0
            if rows:
                yield piece_batch(rows)
            give_back()

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    key, start, length, ids, total = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(key, pa.int64()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(ids, pa.binary()),
            pa.array(total, pa.int64()),
        ],
        ["doc_id", "start", "length", "ids", "doc_tokens"],
    )


def assign(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place pieces, given in descending order, into as few sequences as their sum needs.

    Each goes to the sequence of the lowest cost that still has room for it. A piece that fits
    nowhere is cut: its head fills the sequence with the most room. Returns (piece, offset in
    the piece, length, sequence, offset in the sequence).
    """
    sequences = -(-int(lengths.sum()) // capacity)
    room = np.full(sequences, capacity, dtype=np.int64)
    cost = np.zeros(sequences)
    out = []
    for piece, n in enumerate(lengths.tolist()):
        done = 0
        while done < n:
            left = n - done
            fits = room >= left
            if fits.any():
                to, size = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                to = int(room.argmax())
                size = int(room[to])
            out.append((piece, done, size, to, capacity - int(room[to])))
            room[to] -= size
            cost[to] += LINEAR * size + QUADRATIC * size * size
            done += size
    return out


def pack(
    docs: DataFrame,
    path: str | None = None,
    capacity: int = CAPACITY,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are the token ids as little-endian unsigned 32-bit numbers; a document is its ids
    and END_ID; the vocabulary's added tokens in a text are their own ids. Pieces are dealt by a hash to
    blocks of about ``block_bytes`` of text, and each block packs its own pieces: all its
    sequences are full but for the last tokens it lacks, less than one sequence.

    Null text is an empty document of one token. Rows repeated with one id are packed each,
    and a null id stays null. An empty table gives no rows; further columns are ignored.
    """
    path = path or default_vocabulary()
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("n")).first()["n"]
    blocks = -(-(size or 1) // block_bytes)
    kind = id_type(path)
    spread = F.pmod(F.xxhash64("doc_id", "start", "ids"), F.lit(blocks))
    pieces = tokenize(docs, path, capacity).withColumn("block", spread)

    def place(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        ids, starts = block["ids"].to_pylist(), block["start"].to_numpy()
        width = np.dtype(kind).itemsize
        placed = assign(block["length"].to_numpy(), capacity)
        which, cuts, sizes, sequences, offsets = (
            np.array(x, dtype=np.int64) for x in zip(*placed, strict=True)
        )
        give_back()
        tokens = [
            np.frombuffer(ids[i], dtype=kind, count=n, offset=at * width).astype("<u4").tobytes()
            for i, at, n, _, _ in placed
        ]
        taken = block.select(["doc_id", "doc_tokens"]).take(pa.array(which))
        return pa.table(
            {
                "doc_id": taken["doc_id"],
                "start": pa.array(starts[which] + cuts),
                "length": pa.array(sizes),
                "ids": pa.array(tokens, pa.binary()),
                "doc_tokens": taken["doc_tokens"],
                "sequence_id": pa.array((key[0].as_py() << 32) + sequences),
                "offset": pa.array(offsets),
            }
        )

    return pieces.groupBy("block").applyInArrow(
        place,
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, "
        "offset long",
    )


def pack_digests(docs: DataFrame, **options: object) -> DataFrame:
    """``pack`` with the CRC-32 of the ids in place of the ids."""
    return pack(docs, **options).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )
