"""What a step of the fold over a word's merges evaluates."""

import random

import public_tokenizers
from pyspark.sql import functions as F

from sparkloom.llm.byte_bpe import BITS, MASK, NO_PAIR, _Starts, fold_merges, load_ranks, merge_long, merge_pairs


def test_a_step_reads_each_id_once(spark):
    frame = spark.createDataFrame([([[1, 2]], [3])], "words array<array<bigint>>, ranks array<bigint>")
    plan = frame.select(fold_merges(F.col("words"), F.col("ranks"), 7).alias("x"))._jdf.queryExecution().analyzed().toString()
    # The ids to the left and right of the merge; two places of the table, up to twice, for each of the two pairs; five values that are bound.
    reads = plan.count("get(")
    assert 0 < reads <= 2 + 2 * 4 + 5, reads


def test_bytes_start_merged_only_where_that_changes_nothing():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    starts, ranks = _Starts(path), load_ranks(path)
    pairs, rng = merge_pairs(ranks), random.Random(5)
    parts = [b"in", b"ing", b"th", b"e", b"s", b"aa", b"a", b"tion", b"\xd0\xb0", b"\xd1", b"0", b".", b" "]
    words = [w for w in (b"".join(rng.choices(parts, k=rng.randint(2, 9))) for _ in range(3000)) if w not in ranks]
    states = starts.arrays(words).to_pylist()
    for word, state in zip(words, states, strict=True):
        ids = [x & MASK for x in state]
        assert [x >> BITS for x in state] == [pairs.get(p, NO_PAIR >> BITS) for p in zip(ids, ids[1:], strict=False)] + [NO_PAIR >> BITS]
        while (best := min(((pairs[p], k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs), default=None)) is not None:
            ids[best[1] : best[1] + 2] = [best[0]]
        assert ids == merge_long(word, ranks)
    # The fold is left with fewer ids than bytes.
    assert sum(map(len, states)) < 0.8 * sum(map(len, words))
