"""Token ids of a byte-level BPE as ``tokenizers`` gives them, merged by the faster ``tiktoken``."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import tiktoken
import tokenizers

#: Runs of blanks from this length on exceed the stack of the fast splitter.
LONG_BLANKS = 100_000

_encoders: dict[str, Callable[[str], list[int]]] = {}


def default_vocabulary() -> str:
    """File of the byte-level BPE with 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character of each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def encoder(path: str) -> Callable[[str], list[int]]:
    """text -> ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``.

    Added tokens in a text are their own ids. Where the ids of the vocabulary follow its merges,
    the ranks go to tiktoken, which gives the same ids several times as fast; texts with very
    long runs of blanks, and other vocabularies, are left to ``tokenizers``.
    """
    if path not in _encoders:
        _encoders[path] = _load(path)
    return _encoders[path]


def id_type(path: str) -> str:
    """The narrower of 16 and 32 bits that holds all ids of the vocabulary."""
    size = tokenizers.Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)
    return "<u2" if size <= 1 << 16 else "<u4"


def _load(path: str) -> Callable[[str], list[int]]:
    import public_tokenizers

    slow = tokenizers.Tokenizer.from_file(path)

    def whole(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    follow = all(vocabulary.get(m) == 256 + k for k, m in enumerate(merged))
    if not follow or spec.get("normalizer") or len(vocabulary) - len(added) > 256 + len(merges):
        return whole
    letters = byte_alphabet()
    ranks = {
        bytes(letters[c] for c in token): n for token, n in vocabulary.items() if token not in added
    }
    fast = tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
    )
    blanks = re.compile(r"\s{%d}" % LONG_BLANKS)

    def ids(text: str) -> list[int]:
        if len(text) >= LONG_BLANKS and blanks.search(text):
            return whole(text)
        if any(token in text for token in added):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return ids
