"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (id) that may be broadcast; 8-byte keys, so about 64 MB as a hash relation.
BROADCAST_ROWS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Fewer texts in an Arrow batch than the 10,000 rows of the default.

    The JVM and each Python worker hold some batches at a time, and a text may be long.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; one of our own only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillwatch-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def materialize(frame: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts lineage, computes once."""
    path = shared_folder(frame.sparkSession)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small_side(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (materialized) frame is counted and small, else leave a shuffle."""
    return F.broadcast(frame) if frame.count() <= rows else frame


def hash_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key is never in bucket 0's complement: it gives -1."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus, F.lit(-1))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that the frame does not have in any case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def give_back() -> None:
    """Hand a Python worker's free memory to the system; workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


# ---------------------------------------------------------------- bytes of a batch of texts


def text_slices(
    texts: pa.Array, limit: int = 1 << 19, most: int = 4096
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch of texts into runs of whole texts of about ``limit`` bytes and at most ``most`` texts.

    Yields (first, last + 1, bytes of the run, byte offset of each text and of the end).
    A null text counts as empty.
    """
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if n == 0:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1), first + most)
        base = offsets[first]
        yield first, last, data[base : offsets[last]], offsets[first : last + 1] - base
        first = last
    give_back()


def flushed(rows: Iterator[tuple], make: Callable, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches that ``make`` builds of about ``limit`` bytes of rows (size, row)."""
    held, size = [], 0
    for bytes_, row in rows:
        held.append(row)
        size += bytes_ + 64
        if size > limit:
            yield make(held)
            held, size = [], 0
    if held:
        yield make(held)


# ---------------------------------------------------------------- hashes of words

#: Bytes from which on a word is hashed by itself.
LONG_WORD = 128
_RANDOM = np.random.default_rng(20240229)
BYTE_CODES = _RANDOM.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones(1, dtype=np.uint64)
_INVERSES = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd base and of its inverse modulo 2**64."""
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1 << 16)
        step = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, _INVERSE, dtype=np.uint64)
        step[0] = back[0] = 1
        _POWERS, _INVERSES = np.cumprod(step), np.cumprod(back)
    return _POWERS[:n], _INVERSES[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the whole word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; entry i covers the first i bytes."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data))[0], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, equal for equal bytes wherever they stand."""
    return mix64((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def byte_map(word_bytes: np.ndarray) -> np.ndarray:
    """256 bytes: A-Z lowered, every byte outside words turned into a space."""
    codes = np.arange(256, dtype=np.uint8)
    codes[65:91] += 32
    return np.where(word_bytes[codes], codes, np.uint8(32)).astype(np.uint8)


_ALL = np.arange(256)
#: Bytes of words that end at white space: everything but blank, tab, newlines, form feed.
SPACED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes of words of letters and digits, and of all characters outside ASCII.
ALNUM = (
    (_ALL >= 0x80)
    | ((_ALL >= 0x30) & (_ALL <= 0x39))
    | ((_ALL >= 0x61) & (_ALL <= 0x7A))
)
SPACED_MAP, ALNUM_MAP = byte_map(SPACED), byte_map(ALNUM)


def words_of(
    data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a run of texts: (mapped bytes, starts, ends, first word of each text and the end)."""
    low = mapping[data]
    inside = low != 32
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, mapping: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, first word of each text and the end)."""
    low, starts, ends, first = words_of(data, offsets, mapping)
    hashes = range_hashes(prefix_hashes(low), starts, ends)
    # modulo 2**64, some long words of two letters share their polynomial whatever its base
    for at in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        digest = blake2b(low[starts[at] : ends[at]].tobytes(), digest_size=8).digest()
        hashes[at] = int.from_bytes(digest, "little")
    return hashes, first
