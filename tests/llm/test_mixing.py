"""Scores: unigram against brute force, the model as a distribution and on held-out texts."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import mixing
from sparkloom.llm.common import text_chunks, word_hashes


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["the", "of", "Étude", "langue", "word", "River", "stone,", "x y"] + [f"rare{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words[:8]) if rng.random() < 0.8 else rng.choice(words) for _ in range(rng.choice([0, 3, 40, 120]))) for _ in range(150)]
    return [*enumerate([*texts, None, "", "\x00 odd \x01", texts[3]]), (900, "the of " * 20_000)]


@pytest.mark.parametrize("hot", [0, 5, 200_000])
def test_base_scores(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_WORDS", hot)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, word int, score int")
    got = {r.doc_id: r for r in mixing.score_documents(docs, mixing.held_out()).collect()}
    held = {r.doc_id for r in docs.where(mixing.held_out()).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
    counts = collections.Counter(w for i in tokens if i not in held for w in tokens[i])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, len(ts), sum(counts[w] > 0 for w in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ts), rel_tol=1e-9)
    assert got[3].score == pytest.approx(got[153].score)
    uniform = {i: -math.log10(257) * (len((t or "").encode()) + 1) for i, t in rows}
    assert all(r.score < 0 for r in got.values())
    assert sum(got[i].score for i in held) > sum(uniform[i] for i in held) * 0.6


def test_bytes_are_a_distribution():
    buf = np.frombuffer(b"some words of some text, some words " * 20, np.uint8)
    key, run, word = mixing.runs_of(buf, np.array([0, len(buf)]))
    n, ones = mixing.slot_counts(np.ones(len(run), np.int64), run, word)
    mixer = mixing.Mixer(np.minimum(n, 255), mixing._inputs(ones, n), mixing.newton_weights(np.zeros((20, mixing.GATES))), mixing._start_refine())
    for at in (0, 5, 100):
        every = (run[at] & ~np.uint64(0xFF)) | np.arange(256, dtype=np.uint64)
        assert math.isclose((2.0 ** -mixer.bits(every, np.repeat(word[at], 256))).sum(), 1.0, rel_tol=1e-9)
    scorer = mixing.Scorer(mixer)
    costs = scorer.costs_of(key, run, word)
    assert np.allclose(costs, mixer.bits(run, word))
    assert np.allclose(scorer.spelled(buf[:9], np.array([0, 4, 9])), [costs_of_word(mixer, b"some"), costs_of_word(mixer, b" word")])


def costs_of_word(mixer, w):
    _, run, word = mixing.runs_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
    return mixer.bits(run, word).sum()


def test_scores_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(mixing, "HOT_WORDS", 4)
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    got = {r.doc_id: r for r in mixing.score_documents(docs, mixing.held_out()).collect()}
    texts = {i: (t or "").encode().lower() for i, t in rows}
    train = [texts[i] for i in texts if not got[i].held_out]
    counts = collections.Counter(w for t in train for w in t.split())
    table = spark.createDataFrame([(w.decode(), n) for w, n in counts.items()], "word string, n bigint")
    mixer = mixing.fit(table)
    white = [sum(t.count(c.encode()) for t in train) for c in mixing.WHITE]
    n, once, segments = sum(counts.values()), sum(v == 1 for v in counts.values()), sum(white) + len(train)
    some, known = (n + 1) / (segments + 2), 1 - once / n
    for i, t in texts.items():
        models = []
        for m in mixing.MIXES:
            w = 1 / (1 + math.exp(-(math.log(known / (1 - known)) + m)))
            bits = sum(math.log2(w * counts[x] / n + (1 - w) * 2.0 ** -costs_of_word(mixer, x)) * k for x, k in collections.Counter(t.split()).items())
            bits += len(t.split()) * math.log2(some) + (sum(t.count(c.encode()) for c in mixing.WHITE) + 1 - len(t.split())) * math.log2(1 - some)
            bits += sum(t.count(c.encode()) * math.log2((k + 1) / (segments + 7)) for c, k in zip(mixing.WHITE, white, strict=True)) + math.log2((len(train) + 1) / (segments + 7))
            models.append(bits)
        best = max(models)
        expected = best + math.log2(sum(2.0 ** (b - best) for b in models) / 3)
        assert math.isclose(got[i].score, expected * math.log10(2), rel_tol=1e-9)


def test_tallies_against_counting():
    rng = np.random.default_rng(3)
    tally = mixing.Tally()
    counts = collections.Counter()
    for n in (0, 1, 5000, 300):
        key = rng.integers(0, 900, n).astype(np.uint64) * np.uint64(0x1000000000001)
        counts.update(key.tolist())
        tally.add(key, key + np.uint64(1), key + np.uint64(2))
    key, n, one, two = tally.merge()
    assert dict(zip(key.tolist(), n.tolist(), strict=True)) == dict(counts) and (one == key + np.uint64(1)).all() and (two == key + np.uint64(2)).all()


def test_slopes_and_curvatures_against_brute_force():
    buf = np.frombuffer(b"some words of some text, some words " * 9, np.uint8)
    _, run, word = mixing.runs_of(buf, np.array([0, len(buf)]))
    n, ones = mixing.slot_counts(np.ones(len(run), np.int64), run, word)
    by_gate, by_level = mixing.moments(mixing.Tables(n, ones), np.ones(len(run), np.int64), run, word)
    slots = mixing._context_slots(run, word)
    slope, bend, events = collections.Counter(), collections.Counter(), 0
    for r in range(len(run)):
        byte = int(run[r]) & 255
        for k in range(8):
            y = byte >> (7 - k) & 1
            at = [int(s[k][r]) for s in slots]
            seen = [n[a] - 1 for a in at]
            x = [math.log((ones[a] - y + 0.4) / (m - (ones[a] - y) + 0.4)) for a, m in zip(at, seen, strict=True)]
            p = 1 / (1 + math.exp(-sum(w * v for w, v in zip(mixing.START_WEIGHTS, x, strict=True))))
            gate = k
            for m in seen[2:]:
                gate = gate * 4 + (m > 0) + (m > 2) + (m > 12)
            for i in range(5):
                slope[i, gate] += (y - p) * x[i]
            bend[gate] += p * (1 - p) * x[1] * x[3]
            events += 1
    assert all(math.isclose(by_gate[i, g], v, rel_tol=1e-4, abs_tol=1e-4) for (i, g), v in slope.items())
    at = 5 + mixing._PAIRS.index((1, 3))
    assert all(math.isclose(by_gate[at, g], v, rel_tol=1e-4, abs_tol=1e-4) for g, v in bend.items())
    assert by_level[1].sum() == events


def test_scores_do_not_depend_on_partitions(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    one, two = ({r.doc_id: r for r in mixing.score_documents(docs.repartition(k), mixing.held_out()).collect()} for k in (2, 7))
    assert all(math.isclose(one[i].score, two[i].score, rel_tol=1e-9) for i in one)
    sizes = {i: len((t or "").encode()) + 1 for i, t in rows}
    assert all(math.isclose(r.bits_per_byte, -r.score / math.log10(2) / sizes[i], rel_tol=1e-9) for i, r in one.items())


def test_runs_do_not_cross_texts():
    import pyarrow as pa

    texts = ["ab cd", "", "ab cd", "x", "ab cd"]
    (_, buf, bounds), = text_chunks(pa.array(texts))
    key, run, word = mixing.runs_of(buf, bounds)
    assert len(key) == sum(len(t) + 1 for t in texts)
    assert (key[:6] == key[7:13]).all() and (key[:6] == key[15:]).all() and (run[:6] == run[7:13]).all()


def test_word_hashes_against_splitting():
    import pyarrow as pa

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "B", " ", "\t", "\n", "é", "\x0b", "\x1c", "zz"]) for _ in range(rng.randint(0, 20))) for _ in range(300)] + [None]
    seen = {}
    for lo, buf, bounds in text_chunks(pa.array(texts), 64):
        h, _, first = word_hashes(buf, bounds)
        for i in range(len(bounds) - 1):
            words = (texts[lo + i] or "").encode().lower().split()
            own = h[first[i] : first[i + 1]].tolist()
            assert len(own) == len(words)
            for w, x in zip(words, own, strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in mixing.score_documents(docs, F.lit(True)).collect()}
    assert (got[1].n_known, got[1].train_tokens, got[1].base_score) == (0, 0, 0.0) and got[1].score < got[2].score < 0
    assert mixing.score_documents(docs.limit(0), mixing.held_out()).count() == 0
