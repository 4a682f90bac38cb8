"""Periodic runs, residual best-fit packing and the source audit against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from quillwatch.llm import residual_packing, source_audit, word_runs
from quillwatch.llm.token_ids import default_vocabulary, encoder

DOCS = "doc_id long, text string, lang string, source string, runs int, fill string, n int"


def docs(spark, rows):
    full = [(*r, *("x", "y")[len(r) - 2 :], 1, "f", 2) for r in rows]
    return spark.createDataFrame(full, DOCS)


# ---------------------------------------------------------------- periodic runs


def runs_brute(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if i > s and size >= max(24, 3 * q):
                part = w[s : s + size]
                if not any(part[d:] == part[: size - d] for d in range(1, q)):
                    out.append((s, size, q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    kinds = rng.choice([1, 2, 3, 40])
    words = [rng.randrange(kinds) for _ in range(rng.randrange(50))]
    for _ in range(rng.randrange(4)):
        part = [rng.randrange(kinds) for _ in range(rng.randrange(1, 14))]
        words += (part * 60)[: rng.randrange(70)]
        words += [rng.randrange(kinds) for _ in range(rng.randrange(9))]
    return [f"w{x}" for x in words]


def test_runs_of_random_words():
    rng = random.Random(11)
    found = 0
    for _ in range(1500):
        words = periodic_words(rng)
        want = runs_brute(words)
        found += len(want)
        assert word_runs.runs_of(words and [int(w[1:]) for w in words]) == want
        assert word_runs.text_runs(" \t".join(words).encode())[0] == want
    assert found > 1000


def changed(i, words):
    h = zlib.crc32(str(i).encode())
    n, g = len(words), h // 10
    if i is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]


def test_run_digests(spark):
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \n\t\x0b"), (3, "é é " * 40), (None, "a b " * 12), (4, "A a " * 11)]
    rows += [(5, "a b c " * 3000), (6, "x" * 100_000 + " z" * 24), (7, "a\xa0b " * 30), rows[3]]
    rows += [(k, "  ".join(periodic_words(rng))) for k in range(8, 300)]
    got = {}
    for r in word_runs.run_digests(word_runs.with_repeats(docs(spark, rows))).collect():
        got.setdefault(r.doc_id, []).append(r)
    seen = {}
    for i, text in rows:
        seen.setdefault(i, []).append(changed(i, re.findall(r"[^\x20\x09-\x0D]+", text or "")))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in seen) > 10
    for i, lists in seen.items():
        assert len(got[i]) == len(lists)
        runs = runs_brute(lists[0]) if len(lists[0]) < 1000 else [(0, 9000, 3)]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        rest = " ".join(w for k, w in enumerate(lists[0]) if k not in dropped)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        for r in got[i]:
            assert r.n_runs == len(runs)
            assert (r.start, r.length, r.period) == tuple(best)
            assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
            assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
            assert r.collapsed_sha256 == hashlib.sha256(rest.encode()).hexdigest()
    assert word_runs.run_digests(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- residual packing


def test_token_ids_are_those_of_the_vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    path = default_vocabulary()
    machine = tokenizers.Tokenizer.from_file(path)
    ids = encoder(path)
    for text in (
        "a<|endoftext|>b", "<|endoftext|>", "né 日本 \n\n  x\t", "it's I'LL  we'RE 1,000",
        " " * 1_000_000, "x" + "\n" * 1_000_000 + "y", " \x85\x1c a", "ab" * 100_000,
    ):
        assert ids(text) == machine.encode(text, add_special_tokens=False).ids


def test_best_fit_takes_the_tightest_bin():
    sizes = np.array([3, 7, 5, 2, 6, 4, 1])
    bins, offsets, fills = residual_packing.best_fit(sizes, 10)
    assert fills.tolist() == [10, 10, 8] or sorted(fills.tolist()) == [8, 10, 10]
    for b, f in enumerate(fills):
        own = sorted((o, s) for o, s, x in zip(offsets, sizes, bins, strict=True) if x == b)
        assert [o for o, _ in own] == [sum(s for _, s in own[:k]) for k in range(len(own))]
        assert sum(s for _, s in own) == f


@pytest.mark.parametrize(
    "options", [{}, {"local_tokens": 900, "leaf_bins": 4, "node_bins": 40, "capacity": 256}]
)
def test_residual_packing_round_trip(spark, options):
    capacity = options.get("capacity", 2048)
    ids = encoder(default_vocabulary())
    rng = random.Random(2)
    big = 2**60
    rows = [(0, None), (1, ""), (2, "a<|endoftext|>b"), (3, "né 日本 \n\n  x\t"), (4, "word " * 9000)]
    rows += [(k, " ".join(f"t{rng.randrange(999)}" for _ in range(rng.randrange(400)))) for k in range(5, 200)]
    rows += [(big + 1, "one"), (big + 2, "two"), (None, "no id"), (None, None), (9, rows[9][1])]
    got = residual_packing.pack_best_fit(docs(spark, rows).repartition(7), **options).collect()
    places, pieces = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length > 0
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.ids))
    want = {}
    for i, text in rows:
        own = np.array(ids(text or "") + [0], dtype="<u4")
        head = len(own) % capacity or capacity
        cuts = [0, *range(head, len(own), capacity), len(own)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.setdefault(i, []).append((n, a, own[a:b].tobytes()))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    tokens = 0
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
        tokens += at
    sizes = np.array([r.length for r in got])
    alone = len(residual_packing.best_fit(sizes, capacity)[2])
    assert math.ceil(tokens / capacity) <= len(places) <= alone * 1.1 + 1
    if not options:
        few = residual_packing.packing_digests(docs(spark, rows[:9])).collect()
        assert len(few) == len({(r.doc_id, r.piece) for r in few})
        crc = {(r.doc_id, r.piece): zlib.crc32(r.ids) for r in got}
        assert all(r.ids_crc32 == crc[r.doc_id, r.piece] for r in few)
        assert residual_packing.pack_best_fit(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- source audit


def audit_brute(rows, min_docs, top):
    groups, inside, count = set(), {}, {}
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        for t in set(terms):
            inside[lang, t] = inside.get((lang, t), 0) + 1
        for t in terms:
            count[lang, source, t] = count.get((lang, source, t), 0) + 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in inside.items() if x == lang and n >= min_docs)
        names = sorted(s for x, s in groups if x == lang)
        of = {s: [count.get((lang, s, t), 0) for t in kept] for s in names}
        of[None] = [sum(of[s][k] for s in names) for k in range(len(kept))]
        p = {
            s: [1 + 10**9 * (n + 2) // (sum(c) + 2 * len(kept)) for n in c] for s, c in of.items()
        }
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in names:
            pairs = [(-sum(map(gap, p[s], p[o])), o.encode()) for o in names if o != s]
            terms = [
                (-gap(a, q), t.encode())
                for a, q, n, t in zip(p[s], p[None], of[s], kept, strict=True)
                if n > 0 and a > q
            ]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {
                    (lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)
                }
    return out


@pytest.mark.parametrize(
    ("min_docs", "blocks", "tiles"), [(1, 4096, 64), (3, 4, 2), (2, 1, 64), (10**6, 8, 3)]
)
def test_source_audit(spark, min_docs, blocks, tiles):
    rng = random.Random(5)
    words = ["The", "the", "né", "naïve", "x1y", "b-c", "日本", "Zz", "q", "w", "e", "rT", "tie", "eit"]
    rows = [(None, None, None, None), (1, "", "en", "s0"), (2, "12 34", "en", "none"), (3, "the", "fr", "s1")]
    rows += [
        (k, " ".join(rng.choice(words[: 3 + k % 12]) for _ in range(rng.randrange(30))),
         rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s2", "S3", "é", None]))
        for k in range(4, 150)
    ]
    rows += [rows[20]] * 5 + [(7, "the " * 30_000, "en", "s1")]
    options = {"min_docs": min_docs, "block_terms": blocks, "tile_sources": tiles}
    got = source_audit.audit_sources(docs(spark, rows), **options).collect()
    want = audit_brute(rows, min_docs, 10)
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want


def test_source_audit_of_nothing(spark):
    assert source_audit.audit_sources(docs(spark, [])).collect() == []


def test_shares_are_exact():
    counts = np.array([0, 1, 10**12, 5 * 10**14], dtype=np.int64)
    total = np.array([7, 10**15, 10**15 + 1, 10**15 + 3], dtype=np.int64)
    want = [1 + 10**9 * (int(c) + 2) // int(t) for c, t in zip(counts, total, strict=True)]
    assert source_audit.shares(counts, total).tolist() == want


def test_equal_subtrees_are_one_node():
    forest = source_audit.Forest(np.array([[1, 2, 1, 2, 0, 0, 0, 0], [0, 0, 1, 2, 1, 2, 0, 0]]))
    assert len(forest.leaves) == 3
    assert [len(left) for left, _ in forest.levels] == [2, 4, 2]
