"""Fingerprints, near-duplicate documents and vectors against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from sparkloom.llm import fingerprint, near_dedup, vector_dedup
from sparkloom.llm.components import connected_components


def shingles(t, n):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 6, 60, 200]))) for _ in range(n // 3)]
    while len(texts) < n:
        w = rng.choice(texts).split(" ")
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    return [*texts, None, "", " \t", "Wörd Ünd", "WÖRD ünd", "wörd ünd"]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    texts = corpus(words)
    ids = [7 * i for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in zip(ids, texts, strict=True)], "doc_id bigint, text string, digest string, sig int")
    sets = {i: shingles(t, words) for i, t in zip(ids, texts, strict=True)}
    linked = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components(ids, linked)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, near_dedup.Settings(words=words)).collect()}
    assert got == {i: (len(sets[i]), expected[i], expected[i] == i) for i in ids}
    if words == 5:
        kept = near_dedup.keep_first(docs)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in ids if expected[i] == i)


def test_near_duplicates_of_empty_and_repeated_rows(spark):
    schema = "doc_id bigint, text string"
    assert near_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = near_dedup.near_duplicates(spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")], schema)).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 5), (5, 5), (5, 5), (9, 5)]


def test_pigeonhole_keys_meet_under_the_threshold():
    s = near_dedup.Settings()
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 256, s.values, dtype=np.uint8)
        b = a.copy()
        for i in rng.choice(s.values, sum(e + 1 for e in s.errors) - 1, replace=False):
            b[i] ^= rng.integers(1, 256, dtype=np.uint8)
        x, y = near_dedup.all_keys(np.stack([a, b]), s)
        assert (x == y).any()


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, small, monkeypatch):
    from sparkloom.llm import components as module

    monkeypatch.setattr(module, "SMALL", small)
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {x for p in links if p[0] != p[1] for x in p}
    assert got == {k: v for k, v in components(sorted({x for p in links for x in p}), links).items() if k in nodes}


def test_fingerprints(spark):
    texts = corpus(9, 60)
    docs = spark.createDataFrame([(i * 2, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, sig int").repartition(5)
    rows = sorted(fingerprint.fingerprints(docs).collect(), key=lambda r: r.doc_id)
    plain = [t or "" for t in texts]
    after = plain[1:] + plain[:1]
    by_text, errors = {}, []
    for r, t, n in zip(rows, plain, after, strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + n[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        for other, near in ((edited, r.near_edited), (n, r.near_next)):
            a, b = shingles(t, 5), shingles(other, 5)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.06


def test_fingerprint_edge_cases(spark):
    schema = "doc_id bigint, text string"
    assert fingerprint.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], schema)).first()
    assert one.near_next == 1.0 and one.n_chars == 15
    same = fingerprint.fingerprints(spark.createDataFrame([(1, "x"), (1, "x"), (None, None), (2, "y " * 30_000)], schema)).collect()
    assert len(same) == 4 and {r.fingerprint for r in same if r.doc_id is None} == {""}


def test_next_rows_over_many_ranges(spark):
    ids = random.Random(4).sample(range(-5000, 5000), 700)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(df, "doc_id", "text", ["text"]).collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def brute_vectors(rows, least=0.95):
    unit = {}
    for i, v in rows:
        if v and None not in v and all(map(math.isfinite, v)) and any(v):
            n = math.sqrt(sum(x * x for x in v))
            unit[i] = [x / n for x in v]
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and sum(x * y for x, y in zip(unit[a], unit[b], strict=True)) >= least]
    part = components([i for i, _ in rows], linked)
    return {i: (sum(i in p for p in linked), part[i], part[i] == i) for i, _ in rows}


@pytest.mark.parametrize("block", [4, 64])
def test_vectors(spark, block):
    rng = np.random.default_rng(block)
    base = rng.normal(size=(30, 12))
    made = [(b + rng.normal(size=12) * s).tolist() for b in base for s in (0, 0, 0.05, 0.2, 0.3)]
    made += [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("nan")] + [1.0] * 11, [float("inf")] + [1.0] * 11, [1.0, 2.0], [2.0, 4.0], (np.array(made[0]) * 1e-200).tolist(), (np.array(made[0]) * 1e200).tolist()]
    rows = [(11 * i, v) for i, v in enumerate(made)]
    df = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, id string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df, block=block).collect()}
    expected = brute_vectors(rows[:-2])
    n = len(rows)
    tiny, huge = rows[-2][0], rows[-1][0]
    twins = [i for i, v in rows[:-2] if v and len(v) == 12 and v != [0.0] * 12 and None not in v and all(map(math.isfinite, v)) and np.dot(v, made[0]) / np.linalg.norm(v) / np.linalg.norm(made[0]) >= 0.95]
    for i in twins:
        expected[i] = (expected[i][0] + 2, *expected[i][1:])
    expected[tiny] = expected[huge] = (len(twins) + 1, expected[twins[0]][1], False)
    assert len(got) == n and got == expected


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    got = vector_dedup.near_vectors(spark.createDataFrame([(1, None), (None, [1.0])], "vec_id bigint, embedding array<float>")).collect()
    assert sorted((r.vec_id or 0, r.n_links) for r in got) == [(0, 0), (1, 0)]


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    a, b, c, d = (" ".join(rng.sample(words, 80)) for _ in range(4))
    # 5 has a copy of 2's text and one of its own; 7 shares an id with a near copy of 3's and with an original that 9 nearly copies; 3 and 2 are apart.
    rows = [(2, a), (5, a), (5, b), (3, c), (7, c + " more"), (7, d), (9, d + " more"), (5, b), (8, b + " more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.text) for r in near_dedup.keep_first(docs).collect()}
    assert got == {(2, a), (5, b), (3, c), (7, d)} and near_dedup.keep_first(docs).count() == 5
    parts = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert parts == sorted([(2, 2, True), (5, 2, False), (5, 5, True), (5, 5, True), (8, 5, False), (3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False)])


@pytest.mark.parametrize("family", [0, 1 << 15])
def test_families_in_blocks(spark, family):
    """One family of near copies that fall into many components, in small blocks, as a whole and by key."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(5000)]
    base = [rng.choice(words) for _ in range(150)]
    texts = []
    for _ in range(90):
        w = list(rng.choice(texts[-6:])) if texts and rng.random() < 0.4 else list(base)
        for _ in range(rng.choice([1, 6, 9, 12])):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(w)
    rows = [(3 * i, " ".join(w)) for i, w in enumerate(texts)]
    sets = {i: shingles(t, 2) for i, t in rows}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = components(list(sets), linked)
    assert 5 < len(set(expected.values())) < 80
    settings = near_dedup.Settings(words=2, block=8, mass=1500, family=family)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), settings).collect()
    assert {r.doc_id: r.component_id for r in got} == expected


def test_common_counts():
    rng = np.random.default_rng(2)
    x, y = ([np.unique(np.concatenate([rng.integers(0, 40, 30), rng.integers(0, 4000, n)]).astype(np.uint64)) for n in rng.integers(0, 90, k)] for k in (37, 52))
    got = near_dedup.common_counts([*x, x[0][:0]], y)
    assert (got[:-1] == [[len(np.intersect1d(a, b)) for b in y] for a in x]).all() and not got[-1].any()


def test_a_link_of_an_id_that_repeats(spark):
    rng = random.Random(12)
    w, v = ([rng.choice("abcdefghijklmnop") + str(rng.randrange(999)) for _ in range(60)] for _ in range(2))
    rows = [(5, " ".join(w)), (5, " ".join(v)), (9, " ".join([*w, "x"])), (11, " ".join([*v, "y"]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {5} and len(got) == 4


def test_vectors_of_a_close_threshold_and_at_it(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(20, 8))
    rows = [(i, (b + rng.normal(size=8) * s).tolist()) for i, (b, s) in enumerate([(b, s) for b in base for s in (0, 0.001, 0.01)])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), cosine=0.99995).collect()}
    assert got == brute_vectors(rows, 0.99995)
    tie = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [1.0, 1.0, 1.0, 1.0]), (3, [1.0, -1.0, -1.0, -1.0])]  # 0.5 exactly, and -0.5
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_vectors(spark.createDataFrame(tie, "vec_id bigint, embedding array<float>"), cosine=0.5).collect()}
    assert got == {1: (2, 1), 2: (1, 1), 3: (1, 1)}


def test_vectors_that_share_an_id(spark):

    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 6))
    rows = [(int(rng.integers(0, 25)), (base[rng.integers(0, 12)] + rng.normal(size=6) * rng.choice([0, 0.05, 0.3])).tolist()) for _ in range(160)]
    rows += [(i, [float(x) for x in v]) for i, v in ((1, [1, 0, 0, 0, 0, 0]), (1, [0, 1, 0, 0, 0, 0]), (2, [1, 0.01, 0, 0, 0, 0]), (3, [0, 0, 1, 0, 0, 0]))]
    unit = np.array([v for _, v in rows])
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.95
    reach = [{i} for i in range(len(rows))]
    for i in range(len(rows)):
        for j in np.flatnonzero(close[i]):
            if reach[i] is not reach[j]:
                reach[i] |= reach[j]
                for k in reach[j]:
                    reach[k] = reach[i]
    expected = sorted((i, int(close[k].sum()) - 1, min(rows[m][0] for m in reach[k])) for k, (i, _) in enumerate(rows))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(df, block=16).collect())
    assert got == expected


def test_near_duplicates_broadcast_nothing_that_grows(spark, monkeypatch):
    plans, staged = [], near_dedup.staged

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df, label)

    monkeypatch.setattr(near_dedup, "staged", seen)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(3, 60))], "doc_id bigint, text string")
    seen(near_dedup.keep_first(docs), "kept")
    assert len(plans) > 8 and not [p for p in plans if "BroadcastExchange" in p]
