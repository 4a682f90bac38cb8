"""Exact and near copies, repeated byte strings, components; each against a brute-force version."""

import hashlib
import random
import re

import numpy as np
import pytest

from quillwatch.llm import graph, ngram_join, suffix_dedup
from quillwatch.llm.exact_dedup import drop_exact_copies, exact_dedup

SCHEMA = "doc_id long, text string, kept string, block int, node string, keep_id string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)


def words(rng, n, size=400):
    return [f"w{int(rng.paretovariate(0.6)) % size}" for _ in range(n)]


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "one"), (4, "One"), (5, "a b c d e")]
    rows += [(6, "a b  c d e"), (7, "\u00e9t\u00e9 " * 40), (8, "x " * 3000), (9, "ab" * 500)]
    passage = " ".join(words(rng, 40, 10**6))
    for i in range(10, n):
        if i % 3 == 0 and i > 12:
            text = rows[rng.randrange(10, len(rows))][1].split()
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"edit{rng.randrange(99)}"
            rows.append((i, " ".join(text)))
        else:
            text = words(rng, rng.randrange(1, 120), 10**6)
            if i % 4 == 0:
                text.insert(len(text) // 2, passage)
            rows.append((i, " ".join(text)))
    rows.append((n, rows[20][1].upper()))
    rows += [(n + 1 + k, "the hot copy of a text " * 3) for k in range(80)]
    return rows


def test_exact_dedup_against_python(spark):
    rows = corpus() + [(20, corpus()[20][1])]  # one row repeated
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups: dict[str, list[int]] = {}
    for i, _ in rows:
        groups.setdefault(norm[i], []).append(i)
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        group = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (
            min(group), len(group), r.doc_id == min(group)
        )
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_exact_dedup_of_many_partitions_nulls_and_nothing(spark):
    rows = [(None, "t"), (None, "u"), (None, "u"), (7, "t")]
    docs = frame(spark, rows).repartition(40)
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()}
    assert got == {(None, 7, 2, False), (7, 7, 2, True), (None, None, 2, True)}
    assert exact_dedup(frame(spark, [])).count() == 0
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.text for r in left.collect()) == ["t", "u", "u"]


def near_brute(rows):
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if x]
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
        sets[i] = grams if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("page", [512, 3])
def test_ngram_components_against_python(spark, monkeypatch, page):
    monkeypatch.setattr(ngram_join, "PAGE", page)
    rows = corpus(5)
    got = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows)
    assert len(got) == len(rows)


def test_ngram_components_at_the_threshold_and_without_bands(spark, monkeypatch):
    base = [f"a{i}" for i in range(60)]
    rows = [(i, " ".join(base[:32] + [f"n{i}x{k}" for k in range(i)])) for i in range(1, 14)]
    monkeypatch.setattr(ngram_join, "minima", lambda tokens: np.zeros(0, dtype=np.int64))
    got = ngram_join.ngram_components(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_brute(rows)


def test_near_copies_drop_and_nulls(spark):
    rows = [(None, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f")]
    docs = frame(spark, rows)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs).collect()}
    assert got == {(None, 2, None), (3, 2, 2), (2, 2, 2)}
    left = ngram_join.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 2]
    assert ngram_join.ngram_components(frame(spark, [])).count() == 0


def test_tree_pairs_keep_every_similar_pair():
    rng = np.random.default_rng(1)
    sets = []
    for i in range(120):
        s = np.unique(rng.integers(0, 2**63, size=rng.integers(1, 90), dtype=np.uint64))
        if i % 2 and i > 1:
            s = np.unique(np.concatenate([sets[i - 1][: max(1, len(sets[i - 1]) * 9 // 10)], s[:3]]))
        sets.append(s)
    n = np.array([len(s) for s in sets])
    bits = np.stack([ngram_join.bitmap(s) for s in sets])
    tree = ngram_join.build_tree(n, bits, np.arange(120), n)
    i, j = ngram_join.dual(tree, tree)
    found = set(zip(i.tolist(), j.tolist(), strict=True))
    close = {
        (a, b)
        for a in range(120)
        for b in range(120)
        if a != b and ngram_join.similar(len(np.intersect1d(sets[a], sets[b])), n[a], n[b])
    }
    assert close <= found
    assert len(found) < 120 * 40
    for a, b in close:
        x, y = (ngram_join.wide_bitmap(sets[k]) for k in (a, b))
        assert ngram_join.reach(x, y, n[a], n[b])


def test_components_against_union(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    edges += [(k, k + 1) for k in range(400, 440)]
    parent = list(range(500))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {k: root(k) for e in edges for k in e if e[0] != e[1]}
    assert {r.node: r.component for r in got} == {k: want[k] for k in {r.node for r in got}}
    assert {k for k in want if want[k] != k} <= {r.node for r in got}


def repeats_brute(rows, length=50):
    first: dict[bytes, int] = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            first[s] = min(i, first.get(s, i))
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = True
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def digests(rows):
    return {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in rows}


@pytest.mark.parametrize(
    ("hot", "part", "most"), [(suffix_dedup.HOT, 32 << 20, 1 << 20), (3, 2000, 1 << 20), (9, 2000, 0)]
)
def test_repeats_against_python(spark, hot, part, most):
    rows = corpus(8)
    rows += [(900 + k, f"{k} " + "z" * (45 + k)) for k in range(12)]
    rows += [(950 + k, f"{k}" * 5 + "shared line of exactly the length fifty and more.." + f"{k}" * 9) for k in range(9)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=hot, part_bytes=part, filter_bytes=most).collect()
    assert len(got) == len(rows)
    assert digests(got) == repeats_brute(rows)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_hot_grams_beyond_the_list_and_frequent_strings(spark, monkeypatch, most):
    """A filter that takes many grams by mistake, and strings above and below the frequent bound."""
    monkeypatch.setattr(suffix_dedup, "HOT_LIST", 2)
    monkeypatch.setattr(suffix_dedup, "HOT_BITS", 1 << 9)
    monkeypatch.setattr(suffix_dedup, "FREQUENT", 40)
    rows = corpus(4) + [(700 + k, f"{k} " + "=" * 90 + f" {k}") for k in range(30)]
    rows += [(800 + k, f"{k}{k} a line that stands in a few of the texts, of over fifty bytes {k}") for k in range(6)]
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=2, part_bytes=2000, filter_bytes=most).collect()
    assert digests(got) == repeats_brute(rows)


def test_common_prefixes_are_those_of_the_bytes():
    rng = np.random.default_rng(1)
    texts = rng.integers(97, 99, (300, 80), dtype=np.uint8)
    texts[50:90] = texts[50]
    texts[60:70, 49] = 120
    symbols = np.ascontiguousarray(texts[np.lexsort(texts.T[::-1])])
    words = np.stack(suffix_dedup.words_at(symbols, np.arange(300) * 80))
    got = suffix_dedup.common_prefixes(words)
    want = [0]
    for a, b in zip(symbols, symbols[1:], strict=False):
        differ = np.flatnonzero(a[:56] != b[:56])
        want.append(int(differ[0]) if len(differ) else 56)
    assert got.tolist() == want
    assert suffix_dedup.common_prefixes(words[:, :0]).tolist() == []


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_a_separator_line_is_reduced_before_it_is_dealt(spark, monkeypatch, most):
    """One gram 57 times in every third text must not meet in one group occurrence by occurrence."""
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 6, 9999)) + ("\n" + "=" * 80 if i % 3 == 0 else "")) for i in range(600)]
    large = spark.sparkContext.accumulator(0)

    def watched(read):
        def of(group):
            large.add(int(sum(len(x) for x in group["keys"]) // 6 > 2000))
            return read(group)

        return of

    for name in {"shared_of", "often_of"} & set(vars(suffix_dedup)):
        monkeypatch.setattr(suffix_dedup, name, watched(getattr(suffix_dedup, name)))
    got = suffix_dedup.remove_repeats(frame(spark, rows), hot=300, part_bytes=2000, filter_bytes=most).collect()
    assert digests(got) == repeats_brute(rows)
    assert large.value == 0


def test_repeats_of_nulls_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SMALL_SPANS", 0)
    line = "q" * 30 + "r" * 40
    rows = [(None, line), (5, line), (5, line), (6, line)]
    got = suffix_dedup.remove_repeats(frame(spark, rows)).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in got) == [(0, 70), (5, 70), (5, 70), (6, 0)]
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_order_is_the_sorted_order():
    rng = np.random.default_rng(4)
    symbols = rng.integers(1, 4, size=(40, 30)).astype(np.uint8)
    ends = rng.integers(5, 30, size=40)
    symbols[np.arange(30) >= ends[:, None]] = 0
    wanted = (np.arange(30) < ends[:, None]) & (np.arange(30) < 12)
    order = suffix_dedup.suffix_order(symbols, ends, wanted)
    text = [bytes(symbols[k // 30][k % 30 :]).split(b"\0")[0] for k in order]
    assert text == sorted(text)
    assert len(order) == wanted.sum()


def test_long_words_of_two_letters_do_not_link(spark):
    """Words whose polynomial hashes modulo 2**64 are equal."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, other), (3, word), (4, f"x {other} y")]
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_components(frame(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}
