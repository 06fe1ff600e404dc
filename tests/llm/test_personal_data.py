"""Personal data: base spans against the plain patterns, the graph against a second computation, planted cases."""

import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import personal_data as pd

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def base(t):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (k == 0, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), k == 2 and 14 <= len(d) <= 19 and luhn(d), k == 3 and 10 <= len(d) <= 15)[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def spans(df):
    return {r.doc_id: [(s.start, s.kind, s.end) for s in r.found] for r in pd.find(df).collect()}


def test_base_spans_against_plain_patterns(spark):
    rng = random.Random(2)
    parts = ["a", "B9", "@", ".", "%", "_", "+", "-", " ", "\n", "é", "日", "😀", "1", "25", "255", "256", "0012", "4111111111111111", "4111 1111 1111 1111", "+1 (017) 555-7713", "10.0.0.1", "x.y@mail.example.com", "(", ")", ".com", "@b.c", "00000"]
    texts = [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(4000))]
    got = spans(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 4] == base(t), t


def luhn_number(rng, good):
    while True:
        d = "".join(rng.choice("0123456789") for _ in range(16))
        if luhn(d) == good:
            return d


def planted(rng):
    docs, hidden = [], {}
    for i in range(60):
        docs.append(f"note {rng.randint(10, 99)} my card number is {luhn_number(rng, True)} thanks a lot")
    for i in range(6):
        d = luhn_number(rng, False)
        docs.append(f"é and my card number is {d}, thanks all")
        hidden[len(docs) - 1] = [(docs[-1].index(d), 6, docs[-1].index(d) + 16)]
    for i in range(8):
        d = f"{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        docs.append(f"so call me at {d} tonight")
        hidden[len(docs) - 1] = [(docs[-1].index(d), 7, docs[-1].index(d) + len(d))]
    for i in range(30):
        docs.append(f"so call me at +1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)} tonight")
    for i in range(30):
        docs.append(f"order number is {rng.randint(10000, 99999)} of {rng.randint(100000, 999999)} in version {i}.0 of 2024-01-{i:02d}")
    return docs, hidden


def test_contexts_discover_and_leave_others_alone(spark):
    docs, hidden = planted(random.Random(4))
    got = spans(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string"))
    assert {i: s for i, t in enumerate(docs) if (s := [x for x in got[i] if x[1] >= 4])} == hidden
    # Copies of a document change no score.
    more = docs + [docs[61]] * 200
    again = spans(spark.createDataFrame(list(enumerate(more)), "doc_id bigint, text string"))
    assert all(again[i] == got[i] for i in got) and again[len(docs)] == got[61]


def test_graph_against_second_computation(spark):
    rng = random.Random(6)
    names = ["of the", "card no.", "ring", "is", "at home"]
    docs = []
    for i in range(600):
        kind = rng.randrange(5)
        value = (f"u{i % 50}@mail.example.com", f"{i % 200}.1.2.3", luhn_number(rng, rng.random() < 0.7), f"+1 (017) 555-{1000 + i}", str(rng.randint(10000, 99999)))[kind]
        docs.append(f"x {names[kind] if rng.random() < 0.8 else rng.choice(names)} {value} {rng.choice(['now', 'then', 'please'])} y")
    edges = pd.graph(pd.located(spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")))
    contexts, accepted = pd.bootstrap(edges)
    by_context, kind_of = defaultdict(set), {}
    for r in edges.collect():
        by_context[r.context].add(r.value)
        kind_of[r.value] = r.kind
    taken = {}
    for _ in range(pd.ROUNDS):
        trust = {}
        for c, values in by_context.items():
            for k in range(4):
                s = sum(1.0 if kind_of[v] == k else taken[v][1] if v in taken and taken[v][0] == k else 0.0 for v in values)
                if s >= pd.SUPPORT and s / (len(values) + 1) >= pd.TRUST:
                    trust[c, k] = round(s / (len(values) + 1), 6)
        new = {}
        for v in {v for v in kind_of if kind_of[v] is None}:
            scores = []
            for k in range(4):
                left = 1.0
                for c in by_context:
                    if v in by_context[c]:
                        left *= 1 - min(trust.get((c, k), 0.0), 0.999)
                scores.append(round(1 - left, 6) if re.search(pd.LIKE[pd.BASE[k]], v) else 0.0)
            best = max(range(4), key=lambda k: (scores[k], -k))
            if scores[best] >= pd.ACCEPT:
                new[v] = (best, scores[best])
        taken = new
    assert taken and {r.value: (r.kind, r.score) for r in accepted.collect()} == taken
    assert {(r.context, k): r[f"s{k}"] for r in contexts.collect() for k in range(4) if r[f"s{k}"]} == trust


def test_defined_cases(spark):
    long = "9" * 100_000 + " " + "a" * 100_000 + "@ " + "1." * 50_000 + "\n" + "+1((" * 20_000 + " a@b." * 3_000 + " 10.0.0.1"
    rows = [(1, None, 1), (2, "", 2), (3, "é 10.0.0.1", 3), (3, "é 10.0.0.1", 3), (3, "x", 3), (None, "a@b.c", 4), (4, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, found int")
    got = sorted((r.doc_id or 0, [(s.start, s.kind, s.end) for s in r.found]) for r in pd.find(docs).collect())
    assert got == [(0, [(0, 0, 5)]), (1, []), (2, []), (3, []), (3, [(2, 1, 10)]), (3, [(2, 1, 10)]), (4, base(long.replace("a" * 100_000, "é" * 100_000)))]  # the plain pattern takes a run's square
    assert pd.find(docs.limit(0)).count() == 0


def test_no_python_and_digest(spark, tmp_path):
    spark.createDataFrame([(7, "mail a@b.c and 10.0.0.1")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = pd.op13_personal_data(spark, str(tmp_path))
    r = df.first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) == (1, 1, 0, 0, "email:5:10,ip:15:23") and r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_running_sums(spark):
    got = spark.range(1).select(pd.running(F.sequence(F.lit(1), F.lit(2000))).alias("s"), pd.running(F.expr("cast(array() as array<int>)")).alias("e")).first()
    assert got.s == [k * (k + 1) // 2 for k in range(1, 2001)] and got.e == []
