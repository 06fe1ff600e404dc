"""What a Python worker holds of a batch, and of steps before."""

import numpy as np
import pyarrow as pa
import public_tokenizers

from sparkloom.llm import common, language, near_dedup


def _batches(n):
    texts = [None if k % 50 == 7 else " ".join(f"w{(k * j) % 97}" for j in range(k % 40)) for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(texts, pa.string()), pa.array(range(n), pa.int64())], ["doc_id", "text", "row"])


def test_sets_and_signatures_are_made_a_few_rows_at_a_time():
    s, batch = near_dedup.Settings(words=2), _batches(2000)
    for run in (near_dedup._digests(s), near_dedup._full_sets(s.words)):
        got = list(run(iter([batch])))
        assert max(b.num_rows for b in got) <= near_dedup.ROWS < batch.num_rows
        one_by_one = [b for k in range(batch.num_rows) for b in run(iter([batch.slice(k, 1)]))]
        assert pa.Table.from_batches(got).to_pylist() == pa.Table.from_batches(one_by_one).to_pylist()


def test_texts_are_hashed_in_short_chunks(monkeypatch):
    sizes, hashes = [], near_dedup.word_hashes
    monkeypatch.setattr(near_dedup, "word_hashes", lambda buf, bounds: sizes.append(len(buf)) or hashes(buf, bounds))
    texts = pa.array(["ab " * 20_000] * 30 + ["cd " * 200_000])
    assert len(list(near_dedup.shingle_sets(texts, 2))) == 31
    assert max(sizes[:-1]) <= near_dedup.CHUNK and sizes[-1] == 600_000


def test_steps_of_other_operators_forget_encoders():
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = language.Model(["en"], np.zeros((language.TABLE, 1), np.float32), np.ones((1, 32), bool))
    assert model.languages
    common.PieceEncoder.shared(path, True)
    list(near_dedup._digests(near_dedup.Settings())(iter([_batches(3)])))
    assert not common._encoders


def test_fitting_languages_forgets_encoders():
    common.PieceEncoder.shared(public_tokenizers.path("byte_bpe_50k.json"), True)
    batch = pa.RecordBatch.from_arrays([pa.array(["some words", "mots"]), pa.array(["en", "fr"])], ["text", "lang"])
    assert {r["lang"] for b in language._count(iter([batch])) for r in b.to_pylist()} == {"en", "fr"}
    assert not common._encoders
