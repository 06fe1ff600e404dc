"""Equivalence of answers, and rewards. Numbers are ASCII decimals with optional sign and exponent, percents, and fractions of up to 18 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import NUMBER, boxed, last_number, let, stripped

TOLERANCE = 1e-6
_FLOAT = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
_PERCENT = r"^-?\d+(?:\.\d+)?\s*%$"
_RATIO = r"^(-?\d{1,18})\s*/\s*(\d{1,18})$"
_LATEX = r"\\frac\{(-?\d{1,18})\}\{(\d{1,18})\}"
PLAIN = r"^-?\d+(?:\.\d+)?$"


def _clean(x: Column) -> Column:
    return stripped(F.btrim(stripped(x), F.lit("$")))


def normalized(x: Column) -> Column:
    """struct(kind, num, p, q, sym): kind is `num`, `ratio` (p / q) or `sym` (anything else); null for null or blank."""
    t = stripped(F.btrim(_clean(x), F.lit("()")))

    def kinds(s: Column) -> Column:
        bare = F.regexp_replace(s, r"\s*%$", "")
        number = lambda v: v.try_cast("double")

        def value(kind, num=None, p=None, q=None, sym=None) -> Column:
            return F.struct(F.lit(kind).alias("kind"), (F.lit(None) if num is None else num).cast("double").alias("num"), (F.lit(None) if p is None else p).cast("bigint").alias("p"), (F.lit(None) if q is None else q).cast("bigint").alias("q"), (F.lit(None) if sym is None else sym).cast("string").alias("sym"))

        ratio = lambda pattern: value("ratio", p=F.regexp_extract(s, pattern, 1).try_cast("bigint"), q=F.regexp_extract(s, pattern, 2).try_cast("bigint"))
        nonzero = lambda pattern: F.coalesce(F.nullif(F.regexp_extract(s, pattern, 2), F.lit("")).try_cast("bigint"), F.lit(0)) != 0
        return (
            F.when(s.isNull() | (s == ""), F.lit(None))
            .when(F.endswith(s, F.lit("%")) & bare.rlike(_FLOAT), value("num", number(bare) / 100.0))
            .when(s.rlike(_RATIO) & nonzero(_RATIO), ratio(_RATIO))
            .when(s.rlike(_FLOAT), value("num", number(s)))
            .when(s.rlike(_LATEX) & nonzero(_LATEX), ratio(_LATEX))
            .otherwise(value("sym", sym=s))
        )

    return let(t, kinds)


def as_double(n: Column) -> Column:
    return F.when(n["kind"] == "num", n["num"]).when(n["kind"] == "ratio", n["p"].cast("double") / n["q"])


def _numeric(n: Column) -> Column:
    return F.coalesce(n["kind"] != "sym", F.lit(False))


def _same_number(a: Column, b: Column) -> Column:
    cross = (a["p"].cast("decimal(18,0)") * b["q"].cast("decimal(18,0)")) == (b["p"].cast("decimal(18,0)") * a["q"].cast("decimal(18,0)"))
    return F.when((a["kind"] == "ratio") & (b["kind"] == "ratio"), cross).otherwise(F.abs(as_double(a) - as_double(b)) <= TOLERANCE)


def is_equivalent(pred: Column, gold: Column) -> Column:
    """The first rule that decides: equal texts; equal numbers, when both are; equal last plain number with the same count of words, four at most;
    `answer = N` beside `N`; equal last number when what is left without digits is the same, or nothing on one side."""
    def judged(s: Column) -> Column:
        p, g = s["p"], s["g"]
        pt, gt = F.filter(F.split(p, r"\s+"), lambda w: w != ""), F.filter(F.split(g, r"\s+"), lambda w: w != "")
        last = lambda a: F.try_element_at(a, F.lit(-1))
        short = (F.size(pt) == F.size(gt)) & (F.size(pt) <= 4) & last(pt).rlike(PLAIN) & (last(pt) == last(gt))
        framed = (F.size(pt) == F.size(gt) + 2) & (F.try_element_at(pt, F.lit(-2)) == "=") & F.lower(F.try_element_at(pt, F.lit(-3))).isin("answer", "ans", "result") & last(pt).rlike(PLAIN) & (last(pt) == last(gt))
        pn, gn = last(F.regexp_extract_all(p, F.lit(NUMBER), F.lit(0))), last(F.regexp_extract_all(g, F.lit(NUMBER), F.lit(0)))
        ps, gs = (stripped(F.regexp_replace(x, r"\d+(?:\.\d+)?", "")) for x in (p, g))
        embedded = (pn == gn) & ((ps == "") | (gs == "") | (ps == gs))
        # Null unless both are numbers; read once, and only where texts differ.
        both = F.struct(normalized(p).alias("p"), normalized(g).alias("g"))
        numbers = let(both, lambda v: F.when(_numeric(v["p"]) & _numeric(v["g"]), _same_number(v["p"], v["g"])))
        no = F.lit(False)
        return (
            F.when(s["p"].isNull() | s["g"].isNull() | (p == "") | (g == ""), no)
            .when(p == g, F.lit(True))
            .otherwise(F.coalesce(numbers, F.coalesce(short, no) | F.coalesce(framed, no) | F.coalesce(embedded, no)))
        )

    return let(F.struct(_clean(pred).alias("p"), _clean(gold).alias("g")), judged)


def reward_correct(pred: Column, gold: Column) -> Column:
    """1.0 or 0.0: the whole text, what is boxed, the last number, or the whole text as a number is equivalent to gold."""
    read = F.struct(normalized(last_number(pred)).alias("last"), normalized(pred).alias("whole"), normalized(gold).alias("gold"))
    close = lambda a, g: F.when(_numeric(a) & _numeric(g), (F.abs(as_double(a) - as_double(g)) <= TOLERANCE).cast("double"))
    return (
        F.when(F.coalesce(pred, F.lit("")).eqNullSafe("") | F.coalesce(gold, F.lit("")).eqNullSafe(""), 0.0)
        .when(is_equivalent(pred, gold) | F.coalesce(is_equivalent(boxed(pred), gold), F.lit(False)), 1.0)
        .otherwise(let(read, lambda v: F.coalesce(close(v["last"], v["gold"]), close(v["whole"], v["gold"]), F.lit(0.0))))
    )


def reward_format(text: Column) -> Column:
    """Half for a reason pair, half for an answer pair after it; a quarter where the order is wrong or the other pair is missing."""
    at = lambda tag: F.instr(text, tag)
    ro, rc, ao, ac = (at(t) for t in ("<REASON>", "</REASON>", "<ANSWER>", "</ANSWER>"))
    reason, answer = (ro > 0) & (rc > 0), (ao > 0) & (ac > 0)
    first = F.when(~reason, 0.0).when(ro < rc, 0.5).otherwise(0.25)
    second = F.when(~answer, 0.0).when((ao < ac) & reason & (rc < ao), 0.5).otherwise(0.25)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(first + second)


def reward_length(text: Column, gold: Column, best: int = 200) -> Column:
    """0 if wrong; 1 up to `best` characters; down to 0 at twice as many."""
    found = F.coalesce(F.nullif(boxed(text), F.lit("")), last_number(text), F.lit(""))
    n = F.length(text)
    return F.when(~is_equivalent(found, gold) | (n == 0), 0.0).when(n <= best, 1.0).when(n >= 2 * best, 0.0).otherwise(1.0 - (n - best) / float(best))


def reward_breakdown(text: Column, gold: Column, correct: float = 1.0, form: float = 0.3, length: float = 0.2) -> Column:
    """struct(correct, form, length, total), each part computed once."""
    parts = F.struct(reward_correct(text, gold).alias("correct"), reward_format(text).alias("form"), reward_length(text, gold).alias("length"))
    return let(parts, lambda p: F.struct(*[p[c].alias(c) for c in ("correct", "form", "length")], (correct * p["correct"] + form * p["form"] + length * p["length"]).alias("total")))


def reward(text: Column, gold: Column, correct: float = 1.0, form: float = 0.3, length: float = 0.2) -> Column:
    return reward_breakdown(text, gold, correct, form, length)["total"]
