import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.tokens import EOS, IGNORED, PAD
from sparkloom.operators import corpus, dialogue, judging, mixture, packing, policy
from sparkloom.plans import corpus_queries, judge_queries
from sparkloom.sources import readers


def docs(spark, n=300, seed=1, sources=("a", "b", "c")):
    rng = random.Random(seed)
    rows = [(i, "a" if rng.random() < 0.5 else rng.choice(sources), rng.choice([0, 1, 5, 50, 400])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")


@pytest.mark.parametrize("plan", [{"a": (1000, 10**6), "b": (10**6, 7)}, {"a": (0, 5)}, {"a": (1, 0), "c": (500, 3)}])
def test_budget_cut(spark, plan):
    rows, df = docs(spark)
    spent, kept, expected = dict.fromkeys(plan, 0), dict.fromkeys(plan, 0), []
    for i, s, n in rows:
        if s not in plan:
            expected.append(i)
        elif spent[s] < plan[s][0] and kept[s] < plan[s][1]:
            expected.append(i)
            spent[s], kept[s] = spent[s] + n, kept[s] + 1
    got = mixture.budget_cut(df, mixture.plan_table(spark, plan), "doc_id")
    assert sorted(r.doc_id for r in got.collect()) == expected


@pytest.mark.parametrize(("rows_limit", "size_limit"), [(5, 10**9), (10**6, 2000), (7, 1500)])
def test_chunks(spark, rows_limit, size_limit):
    rows, df = docs(spark)
    expected, chunk, n, b = {}, 0, 0, 0
    for i, s, t in rows:
        expected[i] = chunk
        n, b = n + 1, b + int((2 * t + len(s) + 24) * 1.3)
        if n >= rows_limit or b >= size_limit:
            chunk, n, b = chunk + 1, 0, 0
    got = mixture.chunk_by_rows_and_bytes(df, "doc_id", rows_limit, size_limit)
    assert {r.doc_id: r.chunk_id for r in got.collect()} == expected
    narrow = mixture.chunk_by_rows_and_bytes(df, "doc_id", rows_limit, size_limit, span=11)
    assert {r.doc_id: r.chunk_id for r in narrow.collect()} == expected


def test_chunks_by_shard(spark):
    rows, df = docs(spark, 120)
    expected, state = {}, {}
    for i, s, t in rows:
        chunk, n, b = state.get(s, (0, 0, 0))
        expected[i] = chunk
        n, b = n + 1, b + int((2 * t + len(s) + 24) * 1.3)
        state[s] = (chunk + 1, 0, 0) if n >= 6 or b >= 900 else (chunk, n, b)
    got = mixture.chunk_by_rows_and_bytes(df, "doc_id", 6, 900, shard="source", span=9)
    assert {r.doc_id: r.chunk_id for r in got.collect()} == expected
    assert mixture.chunk_by_rows_and_bytes(df.limit(0), "doc_id", 6, 900).count() == 0
    some = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, None, 7)], "doc_id bigint, source string, n_tokens bigint")
    assert sorted((r.doc_id, r.chunk_id) for r in mixture.chunk_by_rows_and_bytes(some, "doc_id", 1, 900, shard="source").collect()) == [(1, 0), (2, 0), (3, 1)]


def token_rows(spark, seed=2, n=60):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 3, 20, 70]))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, tokens array<int>")


@pytest.mark.parametrize("length", [1, 4, 16, 64])
def test_pack_drop_tail(spark, length):
    rows, df = token_rows(spark)
    stream = [t for _, ids in rows for t in [*ids, EOS]]
    expected = [stream[k : k + length] for k in range(0, len(stream) - length + 1, length)]
    got = packing.pack_drop_tail(df, "doc_id", length, EOS).orderBy("chunk_id").collect()
    assert [r.input_ids for r in got] == expected
    later = packing.pack_drop_tail(df, "doc_id", length, EOS, skip=3).orderBy("chunk_id").collect()
    assert [r.input_ids for r in later] == expected[3:]


def test_pack_pad_and_masks(spark):
    df = spark.createDataFrame([(0, [1, PAD]), (1, [2]), (2, [])], "doc_id bigint, tokens array<int>")
    got = packing.pack_pad_tail(df, "doc_id", 4, EOS, PAD).orderBy("chunk_id").collect()
    assert [r.input_ids for r in got] == [[1, PAD, EOS, 2], [EOS, EOS, PAD, PAD]]
    assert [r.labels for r in got] == [[1, IGNORED, EOS, 2], [EOS, EOS, IGNORED, IGNORED]]
    pair = spark.createDataFrame([(0, [1, 2, 3], [4]), (1, [5], [6, 7])], "k bigint, prompt_ids array<int>, target_ids array<int>")
    got = packing.pack_prompt_mask(pair, "k", 4, EOS, PAD).orderBy("chunk_id").collect()
    assert [r.input_ids for r in got] == [[1, 2, 3, 4], [EOS, 5, 6, 7], [EOS, PAD, PAD, PAD]]
    assert [r.labels for r in got] == [[IGNORED] * 3 + [4], [EOS, IGNORED, 6, 7], [EOS] + [IGNORED] * 3]


def test_holdout(spark):
    rows, df = docs(spark, 55)
    df = df.withColumn("shard", F.floor(F.col("doc_id") / 20))
    held = {r.doc_id for r in corpus.validation_rows(df, 0.1, "shard", "doc_id").collect()}
    assert held == {18, 19, 38, 39, 54}
    assert corpus.training_rows(df, 0.1, "shard", "doc_id").count() == 50
    assert corpus.training_rows(df, 0, "shard", "doc_id").count() == 55
    assert corpus.validation_rows(df, 0, "shard", "doc_id").count() == 0


def test_positions(spark):
    rows, df = docs(spark, 200)
    got = {r.doc_id: r.position for r in corpus.with_position(df, "doc_id", "n_tokens").collect()}
    at = 0
    for i, _, n in rows:
        assert got[i] == at
        at += n


def test_batches_drop_the_rest(spark):
    _, df = docs(spark, 50)
    got = corpus.fixed_batches(df, 16, 3, "doc_id").collect()
    assert len(got) == 48 and {(r.batch_id, r.place) for r in got} == {(b, p) for b in range(3) for p in range(16)}


@pytest.mark.parametrize("cap", [1, 3, 10, 100])
def test_code_cap(spark, cap):
    rng = random.Random(cap)
    rows = [(i, rng.choice(["ok = 1", "print 'x'", "", "class A(object):\n pass"])) for i in range(40)]
    df = spark.createDataFrame(rows, "k bigint, code string")
    examined, expected, stop = 0, [], False
    for k, code in rows:
        if not code or stop:
            continue
        examined += 1
        if code == "ok = 1":
            expected.append(k)
            stop = examined >= cap
    assert [r.k for r in mixture.current_code(df, cap, "k").orderBy("k").collect()] == expected


def test_turn_pairs(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "User", "q1"), (1, 2, "note", "n"), (1, 3, "assistant", "a1"), (1, 4, "assistant", "a2"), (1, 5, "user", "q2"), (1, 6, "user", "q3"), (1, 7, "ASSISTANT", "a3"), (2, 0, "assistant", "x"), (2, 1, "user", ""), (2, 2, None, "z")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.turn, r.question, r.answer) for r in dialogue.turn_pairs(df).collect()}
    assert got == {(1, 3, "q1", "a1"), (1, 7, "q3", "a3")}


def test_votes(spark):
    rows = [("p", 0, "b"), ("p", 1, "a"), ("p", 2, "a"), ("p", 3, "b"), ("q", 0, None), ("r", 0, None), ("r", 1, "z")]
    df = spark.createDataFrame(rows, "k string, i bigint, a string")
    got = {r.k: (r.a, r.votes, r.total, r.agreement) for r in judging.majority_vote(df, "k", "i", "a").collect()}
    assert got == {"p": ("b", 2, 4, 0.5), "q": (None, 0, 1, 0.0), "r": ("z", 1, 2, 0.5)}
    with pytest.raises(ValueError):
        judging.vote(df, "k", "i", "a", "a", "other")


def test_best_of_n_without_gold(spark):
    df = spark.createDataFrame([("p", 0, "x"), ("p", 1, "<ANSWER>1</ANSWER>"), ("p", 2, "<ANSWER>2</ANSWER>")], "k string, i bigint, t string")
    r = judging.best_of_n(df, "k", "i", "t", None).first()
    assert (r.i, round(r.score, 6)) == (1, 0.075)


def test_empty_metrics(spark):
    df = spark.createDataFrame([], "correct boolean, agreement double")
    assert judging.vote_metrics(df).count() == 0
    assert judging.accuracy_by_operation(spark.createDataFrame([], "op string, correct boolean")).count() == 4


def test_loss_with_nothing_masked_in(spark):
    df = spark.createDataFrame([(1, -1.0, -2.0, -1.5, 1.0, False)], "k bigint, n double, o double, r double, a double, m boolean")
    assert list(policy.full_loss(df, "k", "n", "o", "r", "a", "m").first()[1:6]) == [0.0] * 5


def test_advantages(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, 8.0), (2, 0, 5.0)], "k bigint, i bigint, r double")
    assert {(r.k, r.i): r.advantage for r in policy.advantages(df, "k", "r").collect()} == {(1, 0): -2.0, (1, 1): 0.0, (1, 2): 5.0, (2, 0): 0.0}


def test_length_buckets(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([920, 921, 1126, 1127, 18022, 18023])], "k bigint, n_tokens bigint")
    assert sorted((r.k, r.bucket) for r in corpus.length_buckets(df, 5, 1, "k").collect()) == [(1, 1024), (2, 1024), (4, 16384)]


SF = "/root/testdata/sf0.001"


def by_sql(sql, sf=SF):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for name in ("orders", "lineitem", "conversations"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return sorted(db.execute(sql).fetchall())


def test_whole_sft_union(spark):
    got = [tuple(r) for r in corpus_queries.QUERIES["sft_union_whole"](spark, SF).collect()]
    assert sorted(r for r in got if r[0] != "synthetic") == by_sql(corpus_queries.SQL["sft_union"])
    made = [r for r in got if r[0] == "synthetic"]
    texts = {r.id: r.text.removeprefix("Question: ").split("\nAnswer: ") for r in readers.generated_problems(spark, 2_000).collect()}
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert sorted(made) == sorted(("synthetic", k, digest(f"Question: {q}\nAnswer: <REASON>"), digest(f"{a}</REASON>\n<ANSWER>{a.split(' = ')[1]}</ANSWER>")) for k, (q, a) in texts.items())


def test_whole_word_problem_formats(spark):
    got = [tuple(r) for r in judge_queries.QUERIES["word_problem_formats_whole"](spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sorted(got) == by_sql(judge_queries.SQL["word_problem_formats_whole"])


@pytest.mark.parametrize("name", ["trace_texts_whole", "two_field_filter_whole"])
def test_whole_caps(spark, name):
    sf = SF.replace("0.001", "0.01")
    got = sorted(map(tuple, corpus_queries.QUERIES[name](spark, sf).collect()))
    assert got == by_sql(corpus_queries.SQL[name], sf) and len(got) > 300


def test_positions_of_null_and_equal_keys(spark):
    rows = [(None, 5), (3, 2), (1, 7), (3, 2), (None, 1), (9, None)] + [(k, 1) for k in range(20, 60)]
    df = spark.createDataFrame(rows, "k bigint, w bigint").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0))
    expected, at = [], 0
    for k, w in order:
        expected.append((k, w, at))
        at += w or 0
    got = corpus.with_position(df, "k", "w", 7).collect()
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert sorted(r.position for r in corpus.with_position(df, "k").collect()) == list(range(len(rows)))


def test_budget_keeps_rows_with_a_null_key(spark):
    df = spark.createDataFrame([(None, "a", 4), (1, "a", 4), (2, "a", 4), (None, "b", 1), (None, None, 2)], "k bigint, source string, n_tokens bigint")
    got = mixture.budget_cut(df, mixture.plan_table(spark, {"a": (5, 10)}), "k").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, "a", 4), (1, "a", 4), (None, "b", 1), (None, None, 2)], key=str)
