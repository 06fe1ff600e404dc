"""Worked sums and products, problems from a key, schedules and parameter counts: closed forms on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import let

# Names of the places of a decimal number.
PLACES = ("ones", "tens", "hundreds", "thousands", "ten-thousands", "hundred-thousands", "millions", "ten-millions", "hundred-millions")


def _padded(name: str, width: int = 14) -> str:
    return name + " " * max(0, width - len(name))


def worked_sum(a: Column, b: Column) -> Column:
    """One line a column of a + b, lowest first, then the result. The carry into column i is (a mod 10^i + b mod 10^i) div 10^i."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return let(F.struct(a.alias("a"), b.alias("b"), (a + b).alias("c")), lambda s: F.when((s["a"] >= 0) & (s["b"] >= 0), _sum_by_digits(s["a"], s["b"], s["c"])).otherwise(_sum_of_any(s["a"], s["b"])))


def _told(terms: str, total: int) -> str:
    return f" {terms} = {total}, write {total % 10}" + (f", carry {total // 10}" if total >= 10 else "")


# What a line says of two digits and a carry, by (10 first + second) * 2 + carry; then of a carry alone.
_SAID = [_told(f"{x}+{y}" + ("+1" if c else ""), x + y + c) for x in range(10) for y in range(10) for c in range(2)] + [_told(f"0+0+{c}", c) for c in range(2)]


def _sum_by_digits(a: Column, b: Column, c: Column) -> Column:
    """Of numbers that aren't negative: what a line says is looked up."""
    names = F.array(*[F.lit(_padded(p)) for p in PLACES], *[F.lit(f"10^{i}".ljust(14)) for i in range(len(PLACES), 19)])
    powers, said = F.array(*[F.lit(10**i).cast("bigint") for i in range(19)]), F.array(*[F.lit(s) for s in _SAID])
    div = lambda x, y: F.call_function("div", x, y)

    def line(p: Column, i: Column) -> Column:
        carry = div(a % p + b % p, p)
        alone = (i > 0) & (p > a) & (p > b)
        place = F.when(alone, F.lit(200).cast("bigint")).otherwise((div(a, p) % 10 * 10 + div(b, p) % 10) * 2)
        return F.concat(F.get(names, i), F.get(said, (place + carry).cast("int")))

    digits = F.slice(powers, F.lit(1), F.length(c.cast("string")))
    return F.concat(F.array_join(F.transform(digits, line), "\n"), F.lit("\nResult: "), c.cast("string"))


def _sum_of_any(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a.cast("string")), F.length(b.cast("string")))
    names = F.array(*[F.lit(_padded(p)) for p in PLACES])

    def power(i: Column) -> Column:
        return F.pow(F.lit(10.0), i).cast("bigint")

    def line(i: Column) -> Column:
        place = F.coalesce(F.get(names, i), F.concat(F.lit("10^"), i.cast("string"), F.repeat(F.lit(" "), F.greatest(F.lit(11) - F.length(i.cast("string")), F.lit(0)))))
        p = power(i)
        carry = F.call_function("div", a % p + b % p, p)
        da, db = F.call_function("div", a, p) % 10, F.call_function("div", b, p) % 10
        total = da + db + carry
        text = lambda x: x.cast("string")
        terms = F.when(i >= n, F.concat(F.lit("0+0+"), text(carry))).otherwise(F.concat(text(da), F.lit("+"), text(db), F.when(carry > 0, F.concat(F.lit("+"), text(carry))).otherwise("")))
        return F.concat(place, F.lit(" "), terms, F.lit(" = "), text(total), F.lit(", write "), text(total % 10), F.when(total >= 10, F.concat(F.lit(", carry "), text(F.call_function("div", total, F.lit(10))))).otherwise(""))

    columns = F.length((a + b).cast("string"))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), columns - 1), line), "\n"), F.lit("\nResult: "), (a + b).cast("string"))


def worked_product(a: Column, b: Column) -> Column:
    """One line a digit of b, lowest first, their sum if there are several, then the result."""
    a, b = a.cast("bigint"), b.cast("bigint")
    digits = F.sequence(F.lit(0), F.length(b.cast("string")) - 1)
    digit = lambda i: F.call_function("div", b, F.pow(F.lit(10.0), i).cast("bigint")) % 10
    part = lambda i: a * digit(i) * F.pow(F.lit(10.0), i).cast("bigint")
    line = lambda i: F.concat(a.cast("string"), F.lit(" × "), digit(i).cast("string"), F.when(i > 0, F.concat(F.lit(" (×10^"), i.cast("string"), F.lit(")"))).otherwise(""), F.lit(" = "), part(i).cast("string"))
    product = (a * b).cast("string")
    total = F.when(b >= 10, F.concat(F.lit("\n"), F.array_join(F.transform(digits, lambda i: part(i).cast("string")), " + "), F.lit(" = "), product)).otherwise("")
    return F.concat(F.array_join(F.transform(digits, line), "\n"), total, F.lit("\nResult: "), product)


def problem(key: Column, seed: int = 42, digits: int = 3) -> Column:
    """struct(op, a, b, question, answer) that the seed and the key determine. Differences aren't negative; quotients are exact."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), key, F.lit(k)), F.lit(1 << 40))
    up = lambda k, high: draw(k) % F.lit(high)
    high, small = 10**digits, 10 ** min(digits, 2)
    op = F.element_at(F.array(*[F.lit(o) for o in ("add", "sub", "mul", "div")]), (up(0, 4) + 1).cast("int"))
    x, y, s, t = up(1, high), up(2, high), up(1, small), up(2, small)
    b_div = F.greatest(t, F.lit(1))
    a = F.when(op == "add", x).when(op == "sub", F.greatest(x, y)).when(op == "mul", s).otherwise(s * b_div)
    b = F.when(op == "add", y).when(op == "sub", F.least(x, y)).when(op == "mul", t).otherwise(b_div)
    sign = F.element_at(F.create_map(*[F.lit(v) for v in ("add", "+", "sub", "-", "mul", "*", "div", "/")]), op)
    expr = F.concat(a.cast("string"), F.lit(" "), sign, F.lit(" "), b.cast("string"))
    result = F.when(op == "add", a + b).when(op == "sub", a - b).when(op == "mul", a * b).otherwise(F.call_function("div", a, b))
    return F.struct(op.alias("op"), a.alias("a"), b.alias("b"), F.concat(F.lit("What is "), expr, F.lit("?")).alias("question"), F.concat(expr, F.lit(" = "), result.cast("string")).alias("answer"))


def cosine_schedule(step: Column, warmup: int, most: int, least: float = 0.1) -> Column:
    """Linear to 1 at warmup, then half a cosine down to `least` at `most` and beyond."""
    progress = (step - warmup) / float(max(1, most - warmup))
    return F.when(step < warmup, step / float(max(1, warmup))).when(step >= most, F.lit(least)).otherwise(least + (1.0 - least) * 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress)))


# Sizes of the model whose parameters are counted.
MODEL = {"vocab": 32768, "layers": 8, "width": 512, "state": 64, "decay": 64, "rate": 64, "value": 32, "gate": 128}


def parameter_count(vocab: Column, layers: Column, width: Column, state: Column, decay: Column, rate: Column, value: Column, gate: Column, ffn: Column, tied: bool = True, first_norm: bool = True) -> Column:
    """struct(per_block, embedding, total) of a model with time mixing, channel mixing and low-rank maps."""
    heads = F.call_function("div", width, state)
    mixing = 4 * width * width + 13 * width + 2 * width * (decay + rate + value + gate) + heads * state
    block = mixing + width + 2 * width * ffn + 4 * width
    embedding = vocab * width
    total = embedding + layers * block + (2 * width if first_norm else 0) + 2 * width + (F.lit(0) if tied else embedding)
    return F.struct(block.alias("per_block"), embedding.alias("embedding"), total.alias("total"))


# Tokens in all, and each source's share.
TOTAL_TOKENS = 2_000_000_000
SHARES = {"ultradata_math": 0.4, "fineweb_edu": 0.3, "python_code": 0.3}


def source_plan(total: int = TOTAL_TOKENS, shares: dict[str, float] | None = None) -> dict[str, int]:
    shares = shares or SHARES
    if abs(sum(shares.values()) - 1) > 1e-9:
        raise ValueError("shares must add up to 1")
    return {s: int(total * x + 1e-6) for s, x in shares.items()}


def documents_needed(tokens: Column, mean: Column, safety: float = 1.15) -> Column:
    """documents_for on columns; null where there is no mean."""
    return F.floor(tokens / F.nullif(mean, F.lit(0.0)) * safety).cast("bigint")


def documents_for(tokens: int, mean: int, safety: float = 1.15) -> int:
    return int(tokens / mean * safety)
