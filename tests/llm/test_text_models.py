"""Languages, toxicity, decontamination and the language model."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quillwatch.llm import decontamination, language_id, pitman_yor, toxicity

SCHEMA = "doc_id long, text string, lang string, score string, made int, items string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bucket(i, m):
    return zlib.crc32(str(i).encode()) % m


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def sentence(rng, syllables, n):
    return " ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("count", [3, 11])
def test_languages_are_told_apart(spark, count):
    rng = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzäéñß"
    kinds = [["".join(rng.choices(letters, k=3)) for _ in range(12)] for _ in range(count)]
    rows = []
    for i in range(60 * count):
        k = i % count
        rows.append((i, sentence(rng, kinds[k], rng.randrange(8, 60)), f"l{k}"))
    rows += [(9000, None, "l0"), (9001, "123 -- !", "l1"), (9002, "", None), (9003, "Q", None)]
    rows += [(None, rows[0][1], None), (0, rows[0][1], "l0")]
    got = language_id.identify_languages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    lang = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    assert all(r.held_out == (bucket(r.doc_id, 5) == 0) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (9000, 9001, 9002)] == ["und"] * 3
    assert by[9003].lang_pred.startswith("l")
    assert not by[None].held_out and by[None].lang_pred == "l0"
    assert all(0 <= r.score <= 1 for r in got)


def grams_brute(text):
    low = re.sub(rb"[^a-z\x80-\xff]+", b" ", f" {text.lower()} ".encode())
    return [low[i : i + 4] for i in range(len(low) - 3)]


def languages_brute(rows):
    """Exact sets of n-grams in place of the filters: the count of each language's n-grams."""
    whole, docs, out = Counter(), {}, {}
    for i, text, lang in rows:
        if lang and any(c.isalpha() for c in text or "") and (i is None or bucket(i, 5)):
            whole[lang] += 1
            docs.setdefault(lang, Counter()).update(set(grams_brute(text)))
    rates = {lang: {g: n / whole[lang] for g, n in each.items()} for lang, each in docs.items()}
    top = Counter()
    for each in rates.values():
        for g, rate in each.items():
            top[g] = max(top[g], rate)
    sets = {
        lang: {g for g, r in each.items() if r >= 0.003 and r >= 0.5 * top[g]}
        for lang, each in rates.items()
    }
    for i, text, _ in rows:
        found = grams_brute(text or "")
        out[i] = {lang: sum(g in known for g in found) for lang, known in sets.items()}
    return out, whole


@pytest.mark.parametrize("count", [3, 10])
def test_languages_against_python(spark, count):
    """Mixed texts, languages that share words, one very long text, unknown n-grams and ties."""
    rng = random.Random(11)
    kinds = [["".join(rng.choices("abcdefgäéñß", k=2)) for _ in range(9)] for _ in range(count)]
    for kind in kinds[1:]:
        kind[:3] = kinds[0][:3]
    rows = []
    for i in range(50 * count):
        other = kinds[rng.randrange(count)]
        text = sentence(rng, kinds[i % count] + other[:4], rng.randrange(1, 40))
        rows.append((i, rng.choice([text, text.title(), text.replace(" ", " 7, ")]), f"l{i % count}"))
    rows += [(9000, sentence(rng, kinds[1], 60_000), None), (9001, "Qqqqqq zzzz", None), (9002, "--", "l0")]
    rows += [(9003, None, "l0"), (None, rows[3][1], "l2"), (5, rows[5][1], rows[5][2])]
    want, whole = languages_brute(rows)
    usual = max(sorted(whole), key=lambda lang: whole[lang])
    got = language_id.identify_languages(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        counts = want[r.doc_id]
        if r.doc_id in (9002, 9003):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif not any(counts.values()):
            assert (r.lang_pred, r.score) == (usual, 0.0)
        else:
            assert counts[r.lang_pred] == max(counts.values())
            assert r.score == pytest.approx(counts[r.lang_pred] / sum(counts.values()), abs=1e-6)
    assert not any(want[9001].values())


def test_corrected_counts_of_full_filters():
    """Half of all rows set by chance: counts lose the share that passes by mistake."""
    rng = np.random.default_rng(3)
    slices = np.zeros((1 << language_id.ROW_BITS, 1), dtype=np.uint8)
    slices[rng.random(len(slices)) < 0.5] = 1
    text = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    own = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 300))
    for k in range(language_id.HASHES):
        keys, _ = language_id.grams(np.frombuffer(own.encode(), np.uint8), np.array([0, 300]))
        slices[language_id.rows_of(keys, k), 0] |= 2
    filters = language_id.LanguageFilters(("full", "own"), slices, 0)
    data = np.frombuffer((text + own).encode(), np.uint8)
    keys, of = language_id.grams(data, np.array([0, len(text), len(data)]))
    counts, total = filters.counts(keys, of, 2), np.bincount(of)[:, None]
    true = (counts - total * filters.rates()) / (1 - filters.rates())
    assert counts[0, 0] == pytest.approx(total[0, 0] / 8, rel=0.05)
    assert abs(true[0, 0]) < 0.01 * total[0, 0]
    assert true[1, 1] == pytest.approx(total[1, 0], rel=1e-3)


def test_languages_without_rows_or_labels(spark):
    assert language_id.identify_languages(frame(spark, [])).count() == 0
    got = language_id.identify_languages(frame(spark, [(1, "hello", None)])).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)


def test_filters_have_no_false_negatives():
    data = np.frombuffer("überall wörter ".encode(), dtype=np.uint8)
    keys, _ = language_id.grams(data, np.array([0, len(data)]))
    slices = np.zeros((1 << language_id.ROW_BITS, 1), dtype=np.uint8)
    for k in range(language_id.HASHES):
        slices[language_id.rows_of(keys, k), 0] |= 2
    filters = language_id.LanguageFilters(("a", "b"), slices, 0)
    counts = filters.counts(keys, np.zeros(len(keys), dtype=np.int64), 1)
    assert counts.tolist() == [[0, len(keys)]]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(2)
    calm = [f"word{i}" for i in range(400)]
    bad = ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(calm, k=rng.randrange(5, 60))
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(bad).upper())
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, toxic))
    rows += [(9000, None, None), (9001, "", None), (9002, "vile " * 5000, None), (None, "vile nasty rotten", None)]
    labels += [(5000, 1, 1), (None, 0, 1), (3, 0, None), (0, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    got = toxicity.score_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right >= 0.98 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score < 0.5 <= by[9002].score
    left = toxicity.drop_toxic(docs, marks)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in got if not r.predicted}


def features_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    pairs = [(gap, a, b) for gap in (1, 2) for a, b in zip(words, words[gap:], strict=False)]
    return [*sorted(set(words)), *sorted(set(pairs)), ""]  # the empty word is the bias


def ftrl_brute(rows):
    """FTRL-proximal, one coordinate after the other; weights by feature."""
    z, n = Counter(), Counter()

    def weight(key):
        if abs(z[key]) <= toxicity.L1:
            return 0.0
        rate = (toxicity.BETA + math.sqrt(n[key])) / toxicity.ALPHA + toxicity.L2
        return (math.copysign(toxicity.L1, z[key]) - z[key]) / rate

    for _ in range(toxicity.EPOCHS):
        for keys, label in rows:
            now = {key: weight(key) for key in keys}
            g = 1 / (1 + math.exp(-sum(now.values()))) - label
            for key in keys:
                sigma = (math.sqrt(n[key] + g * g) - math.sqrt(n[key])) / toxicity.ALPHA
                z[key] += g - sigma * now[key]
                n[key] += g * g
    return {key: weight(key) for key in z}


@pytest.mark.parametrize("shard_rows", [6000, 120])
def test_toxicity_against_python(spark, monkeypatch, shard_rows):
    """One learner, and several whose weights are averaged, against dictionaries of features."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", shard_rows)
    rng = random.Random(12)
    vocabulary = ["vile", "Rotten", "été", "日本", "x1", "calm", "day", "tree"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(vocabulary, k=rng.randrange(0, 12))
        toxic = int("vile Rotten" in " ".join(words) or rng.random() < 0.05)
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(words), "en"))
        labels.append((i, 1, toxic))
    rows += [(900, None, None), (901, "VILE rotten " * 9000, None), (None, "vile", None), (7, rows[7][1], "en")]
    labels += [(901, 1, None), (None, 1, 1), (8, 1, 1), (8, 1, 0), (77_777, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {}
    for i, _, toxic in labels:
        if i is not None and toxic is not None and bucket(i, 5):
            truth[i] = max(truth.get(i, 0), toxic)
    shards = max(1, round(len(truth) / shard_rows))
    ids = spark.createDataFrame([(i,) for i, _, _ in rows], "doc_id long").distinct()
    dealt = ids.select(
        "doc_id", F.xxhash64("doc_id"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards))
    )
    order = {i: (shard, place) for i, place, shard in dealt.collect()}
    parts = {}
    for i, text, _ in sorted((r for r in rows if r[0] in truth), key=lambda r: order[r[0]][1]):
        parts.setdefault(order[i][0], []).append((features_brute(text), truth[i]))
    assert len(parts) == (1 if shard_rows == 6000 else 3)
    mean = Counter()
    for part in parts.values():
        for key, w in ftrl_brute(part).items():
            mean[key] += w / len(parts)
    got = toxicity.score_toxicity(frame(spark, rows), marks).collect()
    assert len(got) == len(rows)
    texts = {i: text for i, text, _ in rows}
    for r in got:
        total = sum(mean[key] for key in features_brute(texts[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
    assert sum(w != 0 for w in mean.values()) > 3  # something is learned, and
    assert any(w == 0 for w in mean.values())  # the rest stays sparse


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(spark, [(1, "a b", None)]), none).collect()
    assert (got[0].score, got[0].predicted) == (0.0, 0)
    assert toxicity.score_toxicity(frame(spark, []), none).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination_brute(rows, items):
    wins: dict[tuple, set] = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOW))
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = {}
    for i, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        hit, ids = set(), set()
        for k in range(1, 11):
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in wins:
                    hit |= set(range(a, a + k))
                    ids |= wins[tuple(w[a : a + k])]
        out[i] = (len(w), len(hit), len(ids))
    return out


@pytest.mark.parametrize("bound", [1 << 20, 150])
def test_contamination_against_python(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "MAX_ITEM_BYTES", bound)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(50)] + ["Été", "naïve", "日本"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 25)))) for k in range(2, 20)]
    items += [(20, None), (21, "--- !"), (22, items[3][1]), (3, "Short item!"), (3, "another short one")]
    rows = [(0, None), (1, ""), (2, "!!! ???"), (3, "a SHORT   item, yes"), (4, "w " * 4000)]
    for i in range(5, 60):
        text = rng.choices(vocabulary, k=rng.randrange(1, 60))
        if i % 2:
            text[len(text) // 2 : 0] = [rng.choice(items)[1] or ""]
        rows.append((i, rng.choice([" ", ", ", "\n- "]).join(text)))
    docs = frame(spark, [(*r, None) for r in rows])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(docs, bench).collect()
    want = contamination_brute(rows, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in got} == want
    texts = dict(rows)
    for r in got:
        inside = [WORD.findall(texts[r.doc_id][s.start : s.end].translate(LOW)) for s in r.spans]
        assert sum(map(len, inside)) == r.n_hit
    left = decontamination.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {k for k, v in want.items() if not v[1]}


def test_a_large_benchmark_is_one_pass(spark):
    """5 MB of items, many with passages in common, in one automaton; every planted window is hit."""
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(40_000)]
    shared = " ".join(rng.choices(vocabulary, k=30))
    items = [(i, " ".join(rng.choices(vocabulary, k=200)) + (" " + shared) * (i % 3 == 0)) for i in range(2_600)]
    assert sum(len(t) for _, t in items) > 5 << 20 and max(len(t) for _, t in items) < 4000
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(decontamination.item_groups(bench)) == 1
    rows = [(0, " ".join(shared.split()[3:13])), (1, " ".join(shared.split()[3:12]))]
    for i in range(2, 30):
        words, a = items[i][1].split(), rng.randrange(190)
        rows.append((i, " ".join(rng.choices(vocabulary, k=20) + words[a : a + 10] + rng.choices(vocabulary, k=5))))
    got = {r.doc_id: r for r in decontamination.find_contamination(frame(spark, [(*r, None) for r in rows]), bench).collect()}
    assert (got[0].n_items, got[0].n_hit, got[1].n_hit) == (867, 10, 0)
    assert all((got[i].n_items, got[i].n_hit) == (1, 10) for i in range(2, 30))


def test_contamination_of_null_ids_and_anchors_as_items(spark):
    """Null ids are one item; an item that is an anchor of another counts by itself."""
    long = " ".join(f"w{i}" for i in range(12))
    items = [(None, long), (None, "tiny one"), (5, "w0 w1 w2 w3"), (6, None), (7, "..")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, long), (2, "x w0 w1 w2 w3 y"), (3, "a tiny one"), (4, "w1 w2 w3 w4")]
    got = decontamination.find_contamination(frame(spark, [(*r, None) for r in rows]), bench).collect()
    assert {r.doc_id: (r.n_hit, r.n_items) for r in got} == {1: (12, 2), 2: (4, 1), 3: (2, 1), 4: (0, 0)}


def test_contamination_without_items_or_documents(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.find_contamination(frame(spark, [(1, "a b", None)]), empty).collect()
    assert (got[0].n_words, got[0].n_hit, got[0].contaminated) == (2, 0, False)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.find_contamination(frame(spark, []), bench).count() == 0


def model_rows():
    rng = random.Random(4)
    vocabulary = [f"w{min(int(rng.paretovariate(0.8)), 300)}" for _ in range(800)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "Only"), (None, "w1 w2"), (5, "x " * 3000)]
    rows += [(2**60 + 1, "w1"), (2**60 + 2, "w2 w2")]
    rows += [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 50)))) for i in range(6, 150)]
    return rows + [rows[20]]


def test_model_counts_against_python_and_salts(spark, monkeypatch):
    rows = model_rows()
    docs = frame(spark, [(*r, None) for r in rows])
    monkeypatch.setattr(pitman_yor, "WORD_BYTES", 2500)
    plain = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    monkeypatch.setattr(pitman_yor, "BATCH_BYTES", 3000)
    monkeypatch.setattr(pitman_yor, "CONTEXT_BYTES", 1500)
    split = pitman_yor.score_documents(docs, hot_share=0.02).collect()
    assert sorted(str(r.doc_id) for r in split) == sorted(str(i) for i, _ in rows)

    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)) + [None]

    count = Counter()
    for i, text in rows:
        if i is None or bucket(i, 7) != 2:
            count.update(tokens(text))
    n, v = sum(count.values()), len(count)
    texts = dict(rows)
    for r in split:
        own = tokens(texts[r.doc_id])
        held = r.doc_id is not None and bucket(r.doc_id, 7) == 2
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held, len(own), n)
        assert r.n_known == sum(count[w] > 0 for w in own)
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(plain[r.doc_id].score, rel=1e-5, abs=1e-4)
    known = [r for r in split if r.held_out]
    assert sum(r.score for r in known) > sum(r.base_score for r in known)
    assert pitman_yor.score_documents(frame(spark, [])).count() == 0


def test_distinct_of_nothing():
    none = np.zeros(0, dtype=np.int64)
    assert [len(x) for x in pitman_yor.distinct(none, none, none)] == [0, 0, 0]


def test_model_parts_of_a_frequent_context_stay_bounded(spark, monkeypatch):
    """One context with a third of all tokens, its followers and one bigram of it in every text."""
    rng = random.Random(9)
    rows = []
    for i in range(800):
        words = [x for _ in range(12) for x in ("the", f"a{rng.randrange(300)}", f"b{rng.randrange(300)}")]
        rows.append((i, " ".join([*words, "the the the of of"]), None))
    docs = frame(spark, rows)
    plain = {r.doc_id: r.score for r in pitman_yor.score_documents(docs, hot_share=1.0).collect()}
    largest = spark.sparkContext.accumulator(0)
    score_part = pitman_yor.score_part

    def watched(group, *rest):
        times = [pitman_yor.unpack(b).sum() for b in group["times"] if b is not None]
        largest.add(int(sum(times) > 1200))
        return score_part(group, *rest)

    monkeypatch.setattr(pitman_yor, "score_part", watched)
    monkeypatch.setattr(pitman_yor, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(pitman_yor, "CONTEXT_BYTES", 1500)
    monkeypatch.setattr(pitman_yor, "CONTEXT_TOKENS", 100, raising=False)
    split = {r.doc_id: r.score for r in pitman_yor.score_documents(docs).collect()}
    assert split == pytest.approx(plain, rel=1e-5, abs=1e-4)
    assert largest.value == 0


def test_predictive_probabilities_sum_to_one():
    counts = np.array([1, 2, 5, 40, 900])
    root = pitman_yor.seat_root(counts, np.array([50, 20, 6, 3, 1]))
    each = root.chance(np.array([0, *np.repeat(counts, [50, 20, 6, 3, 1])]))
    assert each.sum() == pytest.approx(1.0)
    rng = np.random.default_rng(0)
    base = rng.dirichlet(np.ones(60))
    c = np.append(rng.integers(0, 50, 59), 300)
    got = pitman_yor.seat_contexts(
        np.full(60, 7, dtype=np.uint64), np.arange(60, dtype=np.uint64), c, base
    )
    assert got.sum() == pytest.approx(1.0)
    assert (got > 0).all()


def test_table_conditional_matches_seating():
    """Gibbs draws of t for one dish against the exact conditional by enumeration."""
    d, theta, base, others, c = pitman_yor.D1, pitman_yor.THETA1, 0.2, 3.0, 4
    weight = {}

    def seat(k, sizes, p):
        if k == c:
            weight[len(sizes)] = weight.get(len(sizes), 0) + p
            return
        seat(k + 1, [*sizes, 1], p * (theta + d * (others + len(sizes))) * base)
        for i, s in enumerate(sizes):
            seat(k + 1, [*sizes[:i], s + 1, *sizes[i + 1 :]], p * (s - d))

    seat(0, [], 1.0)
    total = sum(weight.values())
    odds = pitman_yor.table_odds(np.array([c]), np.array([others]), np.array([base]), d, theta)[0]
    for t in range(1, c + 1):
        assert odds[t - 1] == pytest.approx(weight[t] / total)


def test_byte_planes_round_trip():
    for x in ([], [0], [1, 2**40, 255], list(range(1000))):
        assert pitman_yor.unpack(pitman_yor.pack(np.array(x, dtype=np.uint64))).tolist() == x


def test_seating_looks_only_at_possible_numbers_of_tables(monkeypatch):
    n, cells = 20_000, 0
    c = np.where(np.arange(n) % 100 == 0, 50, 2)
    table_odds = pitman_yor.table_odds

    def counted(*args):
        nonlocal cells
        odds = table_odds(*args)
        cells += odds.size
        return odds

    monkeypatch.setattr(pitman_yor, "table_odds", counted)
    u, w = np.full(n, 7, dtype=np.uint64), np.arange(n, dtype=np.uint64)
    got = pitman_yor.seat_contexts(u, w, c, np.full(n, 1 / n))
    assert got.sum() == pytest.approx(1.0)
    assert cells < 15 * n * pitman_yor.SWEEPS  # all columns are 32


def test_tables_are_never_more_than_customers():
    c = np.array([2, 3, 40, 2])
    few = [pitman_yor.draw_tables(c, np.full(4, 1e9), np.full(4, 0.9), (np.uint64(k),), 0.75, 1.0)
           for k in range(50)]
    assert (np.stack(few) <= c).all() and (np.stack(few) >= 1).all()


def test_words_are_found_and_pairs_ordered():
    rng = np.random.default_rng(3)
    for size in (1, 2, 5000):
        known = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
        asked = rng.choice(known, 3 * size)
        assert (pitman_yor.places(known, asked) == np.searchsorted(known, asked)).all()
    for top in (5, 1 << 31, 1 << 60):
        u, w = (rng.integers(0, top, 300, dtype=np.uint64) // np.uint64(top // 5) for _ in range(2))
        u, w = (x * np.uint64(top // 5) for x in (u, w))
        assert pitman_yor.pair_order(u, w).tolist() == np.lexsort((w, u)).tolist()
    none = np.zeros(0, dtype=np.uint32)
    assert len(pitman_yor.pair_order(none, none)) == 0
