"""Arrow-batched hashing of free-form JSON, and HMAC from built-in hashes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

GENESIS_HASH = "0" * 64

CHAIN_FIELDS = (
    "kind string, sequence bigint, previous_hash string, record_hash string, "
    "own_hash string, link_hash string"
)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _whole(value: object) -> int | None:
    """Numbers that equal an integer compare as that integer; anything else never matches."""
    if isinstance(value, (bool, int)) or (isinstance(value, float) and value.is_integer()):
        number = int(value)
        return number if -(2**63) <= number < 2**63 else None
    return None


def _inspect(text: str) -> tuple[str, int | None, str | None, str | None, str | None, str | None]:
    try:
        payload = json.loads(text)
    except ValueError:
        return "invalid_json", None, None, None, None, None
    if not isinstance(payload, dict):
        return "record_is_not_an_object", None, None, None, None, None
    record_hash = payload.get("record_hash")
    if not isinstance(record_hash, str):
        return "legacy", None, None, None, None, sha256_hex(canonical_json(payload))
    previous = payload.get("previous_hash")
    own = sha256_hex(canonical_json({k: v for k, v in payload.items() if k != "record_hash"}))
    return (
        "chained",
        _whole(payload.get("sequence")),
        previous if isinstance(previous, str) else None,
        record_hash,
        own,
        record_hash,
    )


def inspect_audit_record(text: Column) -> Column:
    """Kind, chain fields and recomputed hash of one audit line."""

    @F.pandas_udf(CHAIN_FIELDS)
    def inspect(lines: pd.Series) -> pd.DataFrame:
        rows = [_inspect(line) for line in lines]
        columns = [part.split()[0] for part in CHAIN_FIELDS.split(", ")]
        frame = pd.DataFrame(rows, columns=columns)
        frame["sequence"] = frame["sequence"].astype("Int64")
        return frame

    return inspect(text)


def hmac_signature(body: Column, epoch_seconds: Column, secret: str) -> Column:
    """``sha256=`` + HMAC-SHA256 of ``<epoch seconds>.<body>``.

    The key is fixed, so the two padded keys are constants and the code is two nested hashes.
    """
    if not secret:
        raise ValueError("signing secret is missing")
    key = secret.encode("utf-8")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner_pad, outer_pad = (bytes(k ^ pad for k in key).hex() for pad in (0x36, 0x5C))
    message = F.concat(epoch_seconds.cast("bigint").cast("string"), F.lit("."), body)
    inner = F.sha2(F.concat(F.unhex(F.lit(inner_pad)), F.encode(message, "UTF-8")), 256)
    outer = F.sha2(F.concat(F.unhex(F.lit(outer_pad)), F.unhex(inner)), 256)
    return F.concat(F.lit("sha256="), outer)
