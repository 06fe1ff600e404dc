"""The audit of filters against a simulation of every order."""

import random
import re
from itertools import permutations

from sparkloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, part string, n int, digest string"


def simulated(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    fails, out = [], {}
    for d, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        flags = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        fails.append((lang or "", d, {f for f in flags if flags[f]}))
    for part in {p for p, _, _ in fails}:
        mine = [(d, f) for p, d, f in fails if p == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                out_now = [x for x in left if f in x[1]]
                gone = [x for x in mine if f in x[1] and x not in left]
                left = [x for x in left if f not in x[1]]
                removals[f] += len(out_now)
                redundant = sum(f in x[1] for x in mine) - len(out_now)
                assert gone or not redundant
                out[part, "".join(order), step] = [len(left), len(out_now), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in out_now), sum(x[0] in toxic for x in out_now)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removals[order[step - 1]])
    return out


def test_against_simulation(spark):
    rng = random.Random(5)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \t", "a b", "A", "Ab c\x0bd", "x # y", "a a a a", "a a a a |", long, long + " $", "W " * 300, long.upper(), "é" * 40 + " Z", "x " * 90_000]
    rows = [(rng.choice([None, *range(30)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(150)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    docs = spark.createDataFrame([(*r, "s", 1, "x", 7, "y") for r in rows], SCHEMA)
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.audit(filter_audit.text_groups(docs, told)).collect()}
    assert got == simulated(rows, labels) and len(got) == 3 * 600


def test_empty_tables(spark):
    docs, told = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.text_groups(docs, told)).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", 3, None, None, None)], SCHEMA)
    got = filter_audit.audit(filter_audit.text_groups(one, told)).where("filter_order = 'BACDE'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got] == [(1, 0, 0, 0, 0), (0, 1, 0, 1, 120), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0), (0, 0, 0, 0, 0)]


def test_one_scan_of_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, None, None, None)], SCHEMA)
    docs.write.parquet(str(tmp_path / "d"))
    plan = filter_audit.audit(filter_audit.text_groups(spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
