"""Token output, packing and byte-level BPE against the tokenizer libraries."""

import base64
import hashlib
import os
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from sparkloom.llm import byte_bpe, packing, token_orc  # noqa: E402

TEXTS = ["Hello  world, it's\n\n a test", None, "", "  lead and trail  ", "naïve café — 東京 123 ½", "a" * 3000, "word " * 2500, "<|endoftext|> x a<|endoftext|>b", "Hello  world, it's\n\n a test", "\t\n", "É́ Straße İ"]
SCHEMA = "doc_id bigint, text string, extra int, ids string, n_tokens int, part string, start int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, i, "clash", -1, "p", 9) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 7, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def ids_of(name, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids + [end] for e in tok.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


@pytest.mark.parametrize("name, keeps_space", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_equal_the_library(name, keeps_space, monkeypatch):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from sparkloom.llm.common import _LETTERS, PieceEncoder

    monkeypatch.setattr(PieceEncoder, "MOST", 40)
    monkeypatch.setattr(PieceEncoder, "GROUP", 60)
    encoder = PieceEncoder(public_tokenizers.path(name), keeps_space)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.sampled_from(" \n\tabE's9½é東 ͏.,-<|>\u200d\x1c\u3000") | st.characters(exclude_categories=["Cs"]), max_size=40), max_size=6))
    def check(texts):
        expected = [np.array(e.ids, "<u4").tobytes() for e in encoder.tok.encode_batch(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == expected

    check()
    assert encoder.encode([None, ""]) == [b"", b""]
    # Every letter that is tried as a simple one, alone and among marks, digits and line ends.
    check.hypothesis.inner_test([f"{c} x{c}. {c}'S{c}!!12\n{c}{c.lower()}" for c in map(chr, _LETTERS)])


def test_files_that_pieces_would_change_are_refused(tmp_path):
    from tokenizers import Tokenizer, models

    from sparkloom.llm.common import PieceEncoder

    vocab = {c: k for k, c in enumerate(sorted(set(chr(c) for c in range(32, 127)) | {"[UNK]", "s "}))}
    Tokenizer(models.BPE(vocab, [("s", " ")], unk_token="[UNK]")).save(str(tmp_path / "odd.json"))
    with pytest.raises(ValueError, match="split"):
        PieceEncoder(str(tmp_path / "odd.json"), True)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_orc_round_trip(spark, docs, tmp_path):
    path = str(tmp_path / "orc")
    token_orc.write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    got = sorted(map(tuple, token_orc.token_digests(token_orc.read_tokens(spark, path)).collect()))
    expected, at = [], 0
    all_ids = ids_of("word_bpe_49k.json", 1)
    for doc_id, ids in sorted([*((i * 3, x) for i, x in enumerate(all_ids)), (0, all_ids[0])]):
        expected.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == sorted(expected)
    assert token_orc.find_documents(spark, path, [9]).first().ids == all_ids[3]
    files = spark.read.orc(path).selectExpr("input_file_name() f", "doc_id").groupBy("f").agg({"doc_id": "min"}).orderBy("f").collect()
    assert [r[1] for r in files] == sorted(r[1] for r in files)


def test_orc_of_an_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "empty")
    token_orc.write_tokens(docs.limit(0), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    assert token_orc.token_digests(token_orc.read_tokens(spark, path)).count() == 0


def test_packing_holds_every_id_once(spark, docs):
    rows = packing.pack_documents(docs).collect()
    all_ids = {i * 3: x for i, x in enumerate(ids_of("byte_bpe_50k.json", 0))}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(all_ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(all_ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, pieces in by_doc.items():
        assert sum(n for _, n in pieces) == len(all_ids[doc]) * (2 if doc == 0 else 1)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_placement_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    packer = packing.SumOfSquares(64)
    for k in range(400):
        size = int(rng.integers(1, 64))
        before = packer.counts.copy()
        costs = {}
        for h in range(64 - size + 1):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + size] += h + size < 64
                costs[h] = int((after[1:64] ** 2).sum())
        assert costs[packer.level_for(size)] == min(costs.values())
        packer.place((k, 0, b"\0\0\0\0" * size, size))
    held = packer.held
    assert sum(len(p[2]) // 4 for pieces in packer.settle() for p in pieces) == held


def library():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


@pytest.mark.parametrize("hot, epoch", [(0, 10**6), (40, 3), (250_000, 10**6)])
def test_bpe_equals_the_library(spark, docs, hot, epoch, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HOT", hot)
    monkeypatch.setattr(byte_bpe, "EPOCH", epoch)
    monkeypatch.setattr(byte_bpe, "ROWS", 2 if epoch == 3 else 256)
    path, own = library()
    expected = {i * 3: own.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    coded = byte_bpe.encode(docs.coalesce(1), path, public_tokenizers.PATTERN)
    got = coded.collect()
    assert len(got) == len(TEXTS) + 1 and all(r.ids == expected[r.doc_id] for r in got)
    decoded = {r.doc_id: bytes(r.text) for r in byte_bpe.decode_ids(coded, path).collect()}
    assert decoded == {i * 3: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert byte_bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    _, own = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = byte_bpe.op8_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_long_matches_merge_alike():
    path, own = library()
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 40, 900):
        word = "".join(rng.choice(list("abetßé"), n))
        assert byte_bpe.merge_long(word.encode(), byte_bpe.load_ranks(path)) == own.encode_ordinary(word)
    assert len(byte_bpe.merge_long(b"ab" * 100_000, byte_bpe.load_ranks(path))) < 100_001


def test_files_with_wide_ids_are_refused(tmp_path):
    file = tmp_path / "wide.tiktoken"
    file.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b + (1 << 20)}\n" for b in range(256)))
    with pytest.raises(ValueError, match="bits"):
        byte_bpe.load_ranks(str(file))


def test_cuckoo_table_finds_every_pair():
    pairs = {(a, (a * 7 + k) % 5000): k for a in range(500) for k in range(5)}
    slots, size = byte_bpe.cuckoo_table(pairs)
    for (a, b), r in pairs.items():
        assert (a << 40) | (b << 20) | r in [int(slots[p]) for p in byte_bpe._places(a, b, size)]
