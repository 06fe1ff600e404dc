import pytest
from pyspark.sql import functions as F

from sparkloom.functions import arithmetic, calculator


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("1 + 2 * 3", "7"), ("(1 + 2) * 3", "9"), ("-2 ** 2", "-4"), ("2 ** -1", "0.5"), ("7 // -2", "-4"), ("7 % -3", "-2"), ("sqrt(16)", "4"), ("round(2.5)", "2"), ("1 < 2", "True"), ("max(1, 2, 3)", "3"),
        ("factorial(5)", "120"), ("1 / 4", "0.25"), ("1, 2", "(1, 2)"), ("gcd(12, 18)", "6"), ("min(3.0, 4)", "3"), ("1e3", "1000"), ("2 ** 3 ** 2", "512"), (" 5 ", "5"), ("log(100, 10)", "2"),
    ],
)
def test_values(expression, value):
    assert calculator.calculate(expression) == value


@pytest.mark.parametrize("expression", ["", None, "1 / 0", "a", "x.y", "1 < 2 < 3", "2 ** 100000", "factorial(1000)", "__import__", "1;2", "(" * 70 + "1" + ")" * 70, "9" * 600, "abs(x=1)", "1 +", "(1", "(-1) ** 0.5", "-" * 100 + "1"])
def test_errors(expression):
    with pytest.raises(calculator.CalculatorError):
        calculator.calculate(expression)


def test_resolve():
    call = "<TOOL>calc(1+1)</TOOL>"
    assert calculator.resolve("plain") == ("plain", "no_call")
    assert calculator.resolve(f"a {call} b {call}") == ("a 2 b 2", "ok")
    assert calculator.resolve(f"{call} <TOOL>calc(1/0)</TOOL>") == ("2 <TOOL>calc(1/0)</TOOL>", "error")
    assert calculator.resolve(call * 64)[1] == "stuck"
    assert calculator.resolve(call * 63)[1] == "ok"
    assert calculator.resolve("<TOOL>calc((2+3)*4)</TOOL>")[1] == "no_call"
    assert calculator.resolve(None) == (None, "no_call")


def test_sql_surface(spark):
    calculator.register(spark)
    assert spark.sql("SELECT calculate('2*3') a, resolve_calls('<TOOL>calc(4)</TOOL>').text b").first() == ("6", "4")
    got = spark.sql("SELECT place, tool, expr FROM VALUES ('<TOOL>calc( 1 )</TOOL> x <tool>exec(2)</tool>') v(t), LATERAL tool_calls(t)").collect()
    assert sorted(map(tuple, got)) == [(0, "calc", "1"), (1, "exec", "2")]


def brute_sum(a, b):
    x, y, carry, lines, out = str(a), str(b), 0, [], ""
    n = max(len(x), len(y))
    x, y = x.zfill(n), y.zfill(n)
    name = lambda i: arithmetic.PLACES[i] if i < len(arithmetic.PLACES) else f"10^{i}"
    for i in range(n):
        p, q = int(x[n - 1 - i]), int(y[n - 1 - i])
        s = p + q + carry
        terms = f"{p}+{q}" + (f"+{carry}" if carry else "")
        carry = s // 10
        lines.append(f"{name(i):<14} {terms} = {s}, write {s % 10}" + (f", carry {carry}" if carry else ""))
        out = str(s % 10) + out
    if carry:
        lines.append(f"{name(n):<14} 0+0+{carry} = {carry}, write {carry}")
        out = str(carry) + out
    return "\n".join([*lines, f"Result: {out}"])


def test_worked_sum(spark):
    pairs = [(0, 0), (12345, 678), (999, 1), (5, 5), (99999999, 99999999), (123456789012, 987654321)]
    rows = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", arithmetic.worked_sum(F.col("a"), F.col("b")).alias("t")).collect()
    for r in rows:
        assert r.t == brute_sum(r.a, r.b)


def test_worked_product(spark):
    row = spark.createDataFrame([(12, 34)], "a bigint, b bigint").select(arithmetic.worked_product(F.col("a"), F.col("b"))).first()[0]
    assert row == "12 × 4 = 48\n12 × 3 (×10^1) = 360\n48 + 360 = 408\nResult: 408"


def test_problems_follow_the_seed(spark):
    from sparkloom.sources.readers import generated_problems

    a, b, c = (generated_problems(spark, 200, s).orderBy("id").collect() for s in (1, 1, 2))
    assert a == b and a != c
    for r in a:
        expr, _, result = r.text.split("Answer: ")[1].partition(" = ")
        assert calculator.calculate(expr) == result and not result.startswith("-")


def test_parameter_count(spark):
    m = {k: F.lit(v) for k, v in arithmetic.MODEL.items()}
    assert spark.range(1).select(arithmetic.parameter_count(**m, ffn=F.lit(2048)).alias("c")).first().c.total == 44_382_208
