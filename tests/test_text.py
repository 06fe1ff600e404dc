import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text, tokens, verify


def column(spark, values, f, schema="x string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_numbers(spark):
    values = ["a 1 b 2.5", "1 / 2 then 7", "none", None, "-3/4 x 5 /6", "  "]
    assert column(spark, values, text.last_number) == ["2.5", "1/2", None, None, "5/6", None]
    assert column(spark, values, text.first_number) == ["1", "1/2", None, None, "-3/4", None]


def test_hash_answer(spark):
    assert column(spark, ["x #### 1,234.5 y", "#### none 7", "so 9", None], text.hash_answer) == ["1234.5", "7", "9", None]


def brute_boxed(t):
    start = t.rfind("\\boxed{")
    start, skip = (start, 7) if start >= 0 else (t.rfind("boxed{"), 6)
    if start < 0:
        return None
    depth, out = 1, []
    for c in t[start + skip :]:
        depth += (c == "{") - (c == "}")
        if depth == 0:
            return "".join(out)
        out.append(c)
    return None


def test_boxed_against_brute_force(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice(["\\boxed{", "boxed{", "{", "}", "a", "\n", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    assert column(spark, values, text.boxed) == [brute_boxed(v) for v in values]


def test_annotations(spark):
    values = ["<<2+3=5>>5 apples", "no", "<<a*b = 6>> and <<1+1=2>>2.0", "<<=5>>", "<<x\n=3>>"]
    assert column(spark, values, text.annotations_to_calls) == ["<TOOL>calc(2+3)</TOOL> apples", "no", "<TOOL>calc(a*b)</TOOL> and <TOOL>calc(1+1)</TOOL>", "<<=5>>", "<TOOL>calc(x)</TOOL>"]


def brute_apart(t):
    def one(m):
        s, sign = m[0].removeprefix("-"), "<NEG>" if m[0][0] == "-" else "<NUM>"
        whole, _, rest = s.partition(".")
        return f"{sign} {' '.join(whole)}" + (f" <DECIMAL> {' '.join(rest)}" if rest else "")

    return re.sub(r"-?\d+(?:\.\d+)?", one, t, flags=re.A)


def test_digits(spark):
    rng = random.Random(4)
    values = ["".join(rng.choice("12.- ab\n") for _ in range(rng.randint(0, 15))) for _ in range(500)]
    assert column(spark, values, text.digits_apart) == [brute_apart(v) for v in values]
    assert column(spark, ["-3.14 and 123 x"], lambda x: text.digits_together(text.digits_apart(x))) == ["-3.14 and 123 x"]


def brute_encode(t):
    ids = []
    for p in re.split("(" + "|".join(map(re.escape, tokens.MARKERS)) + ")", t):
        ids += [tokens.MARKER_IDS[p]] if p in tokens.MARKER_IDS else [ord(c) if ord(c) < 128 else 63 for c in p]
    return ids


def test_encode_against_brute_force(spark):
    rng = random.Random(5)
    values = ["".join(rng.choice([*tokens.MARKERS, "a", "<", ">", "é", "😀", "\n", "NUM>"]) for _ in range(rng.randint(0, 10))) for _ in range(500)] + [None, ""]
    got = column(spark, values, tokens.encode_chars)
    assert got == [None if v is None else brute_encode(v) for v in values]
    assert column(spark, ["a<EOS>"], lambda x: tokens.encode_chars(x, bos=True)) == [[tokens.BOS, 97, tokens.EOS]]


def test_decode_drops_unknown_ids(spark):
    assert column(spark, [[97, 30000, tokens.EOS, 98], []], tokens.decode_chars, "x array<int>") == ["a<EOS>b", ""]


def test_overflow(spark):
    assert column(spark, [[0, 32693, 32694, 100_000]], tokens.remap_overflow, "x array<int>") == [[0, 32693, 32694 + 32694 % 64, 32694 + 100_000 % 64]]


@pytest.mark.parametrize(
    ("pred", "gold", "same"),
    [
        ("42", "42", True), ("42.0", "42", True), ("50%", "0.5", True), ("1/2", "2/4", True), ("1/2", "0.5", True), ("$5$", "5", True), ("(7)", "7", True),
        ("x = 5", "y = 5", True), ("answer = 5", "5", True), ("the answer is 42", "42", True), ("x^2 + y^2 = z^2", "z^2", False), ("answer -5", "-5", False),
        ("", "5", False), (None, "5", False), ("5", None, False), ("41", "42", False), ("\\frac{1}{2}", "0.5", True), ("1/3", "2/6", True), ("abc", "abc", True), ("abc", "abd", False),
        ("999999999999999999/999999999999999998", "1", True), ("1e3", "1000", True),
    ],
)
def test_equivalence(spark, pred, gold, same):
    row = spark.createDataFrame([(pred, gold)], "p string, g string").select(verify.is_equivalent(F.col("p"), F.col("g"))).first()
    assert row[0] is same


def test_rewards(spark):
    good = "<REASON>r</REASON>\n<ANSWER>4</ANSWER>"
    rows = spark.createDataFrame([(0, good, "4"), (1, good, "5"), (2, "", "5"), (3, "50% is it 50%", "50"), (4, "4" + "x" * 299, "4"), (5, None, "4")], "i int, t string, g string").orderBy("i")
    t, g = F.col("t"), F.col("g")
    got = [tuple(r) for r in rows.select(verify.reward_correct(t, g), verify.reward_format(t), verify.reward_length(t, g), verify.reward(t, g)).collect()]
    assert got[0] == (1.0, 1.0, 1.0, 1.5)
    assert got[1] == (0.0, 1.0, 0.0, 0.3)
    assert got[2] == (0.0, 0.0, 0.0, 0.0)
    assert got[3][0] == 1.0
    assert got[4][2] == 0.5
    assert got[5] == (0.0, 0.0, 0.0, 0.0)
