"""The pipeline's stages, each on its predecessor's rows, against brute force."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tests_support import shingles  # noqa: E402

EN = "the of and that with from this have not they which their would about there".split()


def make(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(EN) for _ in range(60)) for _ in range(30)]
    texts += [texts[0], texts[1] + " extra", "12345 !!", None, "my password = hunter22x and more words here", ""]
    rows = [(i, t, "en", "s", len(t or ""), i * 10) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, sig int")


def test_stages(spark, tmp_path):
    rows, docs = make(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "secrets", "packing"]
    kept = {r[0]: r[1] for r in rows if r[1] and any(c.isalpha() for c in r[1])}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, out, "unused").write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        assert sorted(out.columns) == sorted(docs.columns)
        got = {r.doc_id: r for r in out.collect()}
        if name == "near_dedup":
            sets = {i: shingles(t, 5) for i, t in kept.items()}
            kept = {i: t for i, t in kept.items() if not any(j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in sets)}
        if name == "secrets":
            kept = {i: t.replace("password = hunter22x", "[assign]") for i, t in kept.items()}
        assert {i: r.text for i, r in got.items()} == kept
        assert all(r.n_chars == len(r.text) and r.sig == 10 * i for i, r in got.items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, out, "unused").collect()
    assert {p.doc_id for p in pieces} == set(kept)
    for i in kept:
        own = [p for p in pieces if p.doc_id == i]
        assert sum(p.length for p in own) == own[0].doc_tokens


def test_stages_on_an_empty_table(spark):
    _, docs = make(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "unused").count() == 0


def test_stages_on_odd_rows(spark):
    rng = random.Random(9)
    words = [" ".join(rng.choice(EN) for _ in range(60)) for _ in range(4)]
    long = " ".join(rng.choice(EN) for _ in range(60_000)) + " token = abcdefgh9"
    rows = [(1, words[0]), (1, words[0]), (1, words[1]), (2, words[0]), (None, words[0]), (None, None), (3, None), (4, ""), (5, long), (6, long), (None, words[2])]
    docs = spark.createDataFrame([(i, t, "en" if k % 4 else None, None, None, "x") for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    told = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    with_text = sorted(((i, t) for i, t in rows if t), key=key)
    assert told(stages["language"](spark, docs, "unused")) == with_text
    assert stages["language"](spark, docs.withColumn("lang", docs.source), "unused").count() == 0
    gone = [(2, words[0]), (6, long)]
    left = stages["near_dedup"](spark, docs, "unused")
    assert told(left) == sorted((r for r in rows if r not in gone), key=key) and left.columns == docs.columns
    masked = stages["secrets"](spark, left, "unused").collect()
    assert sorted(((r.doc_id, r.text) for r in masked), key=key) == sorted(((i, t and t.replace("token = abcdefgh9", "[assign]")) for i, t in rows if (i, t) not in gone), key=key)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked)
    pieces = stages["packing"](spark, left, "unused").collect()
    assert sum(p.length for p in pieces if p.doc_id == 5) == next(p.doc_tokens for p in pieces if p.doc_id == 5) > 60_000
    assert sorted(p.doc_tokens for p in pieces if p.doc_id in (3, 4)) == [1, 1] and len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
