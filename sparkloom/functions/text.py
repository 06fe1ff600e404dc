"""Text columns: white space, numbers, answers, annotations, digit marks. ASCII classes throughout, so that engines agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that answers and annotations are read by.
FRACTION = r"-?\d+\s*/\s*\d+"
NUMBER = r"-?\d+(?:\.\d+)?"
FINAL = r"####\s*(-?\d[\d,]*(?:\.\d+)?)"
ANNOTATION = r"<<\s*([^=\n]+?)\s*=\s*[^\n]*?>>(?:\s*-?\d+(?:\.\d+)?)?"
TOOL_CALL = r"(?is)<TOOL>\s*(calc|exec)\s*\(([^)]*)\)\s*</TOOL>"

# Code that only an older version of the language accepts.
LEGACY_CODE = (
    r"""(?:^|\n)\s*print\s+["']""",
    r"(?:^|\n)\s*class\s+\w+\s*\(\s*object\s*\)\s*:",
    r"""\bu["']""",
    r"\bapply\s*\(",
    r"""\bexec\s+['"]""",
)


def let(value: Column, body) -> Column:
    """body(x) with x bound to value once."""
    return F.transform(F.array(value), body)[0]


def stripped(x: Column) -> Column:
    """Without white space of any kind at both ends; `trim` takes spaces alone."""
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def blank_to_null(x: Column) -> Column:
    return F.nullif(stripped(x), F.lit(""))


def _pick(x: Column, at: int) -> Column:
    fractions, numbers = F.regexp_extract_all(x, F.lit(FRACTION), F.lit(0)), F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0))
    return F.coalesce(F.replace(F.try_element_at(fractions, F.lit(at)), F.lit(" "), F.lit("")), F.try_element_at(numbers, F.lit(at)))


def last_number(x: Column) -> Column:
    """The last fraction if there is one, else the last number, else null."""
    return _pick(x, -1)


def first_number(x: Column) -> Column:
    return _pick(x, 1)


def hash_answer(x: Column) -> Column:
    """The number after the first `####` that has one, without commas; else the last number."""
    return F.coalesce(F.nullif(F.replace(F.regexp_extract(x, FINAL, 1), F.lit(","), F.lit("")), F.lit("")), last_number(x))


def boxed(x: Column) -> Column:
    """What the braces of the last `\\boxed{` enclose (of the last `boxed{` if none has a backslash); null if they don't close."""
    with_slash, plain = F.regexp_extract(x, r"(?s)^.*\\boxed\{(.*)$", 1), F.regexp_extract(x, r"(?s)^.*boxed\{(.*)$", 1)
    tail = F.when(F.contains(x, F.lit("\\boxed{")), with_slash).when(F.contains(x, F.lit("boxed{")), plain)

    def enclosed(t: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

        def step(acc: Column, c: Column) -> Column:
            depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
            return F.when(acc["depth"] == 0, acc).otherwise(F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n")))

        end = F.aggregate(F.split(t, ""), start, step)
        return let(end, lambda e: F.when(e["depth"] == 0, F.substring(t, F.lit(1), e["n"] - 1)))

    return F.when(tail.isNotNull(), let(tail, enclosed))


def math_answer(x: Column) -> Column:
    return F.coalesce(stripped(boxed(x)), last_number(x))


def annotations_to_calls(x: Column) -> Column:
    """`<<expression=result>>number` becomes a call; the number goes."""
    return F.regexp_replace(x, ANNOTATION, "<TOOL>calc($1)</TOOL>")


def first_tool_call(x: Column) -> Column:
    """struct(tool, expression) of the first call, or null."""
    return F.when(F.regexp_like(x, F.lit(TOOL_CALL)), F.struct(F.lower(F.regexp_extract(x, TOOL_CALL, 1)).alias("tool"), stripped(F.regexp_extract(x, TOOL_CALL, 2)).alias("expr")))


def is_legacy_code(x: Column) -> Column:
    found = F.lit(False)
    for p in LEGACY_CODE:
        found = found | x.rlike(p)
    return found


def is_refusal(x: Column) -> Column:
    return F.startswith(F.lower(stripped(x)), F.lit("<nooutput>"))


def operation(question: Column) -> Column:
    """The first of + - * / that the question contains, in this order; addition if none."""
    return F.when(F.contains(question, F.lit("+")), "add").when(F.contains(question, F.lit("-")), "sub").when(F.contains(question, F.lit("*")), "mul").when(F.contains(question, F.lit("/")), "div").otherwise("add")


def last_result(x: Column) -> Column:
    """After the last `Result:`, else after the last `=`, else all; stripped."""
    return stripped(F.when(F.contains(x, F.lit("Result:")), F.substring_index(x, "Result:", -1)).otherwise(F.substring_index(x, "=", -1)))


# ---------------------------------------------------------------- digits apart, digits together

_MARK = "\u0001"


def digits_apart(x: Column) -> Column:
    """`12.5` to `<NUM> 1 2 <DECIMAL> 5`, `-3` to `<NEG> 3`. Numbers are put between marks, the text is cut there, and every second piece rewritten."""
    spaced = lambda s: F.array_join(F.filter(F.split(s, ""), lambda c: c != ""), " ")

    def rewritten(number: Column) -> Column:
        bare = F.regexp_replace(number, "^-", "")
        sign = F.when(F.startswith(number, F.lit("-")), F.lit("<NEG> ")).otherwise(F.lit("<NUM> "))
        whole, rest = F.substring_index(bare, ".", 1), F.substring_index(bare, ".", -1)
        return F.when(F.contains(bare, F.lit(".")), F.concat(sign, spaced(whole), F.lit(" <DECIMAL> "), spaced(rest))).otherwise(F.concat(sign, spaced(bare)))

    pieces = F.split(F.regexp_replace(x, f"({NUMBER})", f"{_MARK}$1{_MARK}"), _MARK)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, rewritten(p)).otherwise(p)), "")


def digits_together(x: Column) -> Column:
    """Undoes digits_apart; marks go, and white space between any two digits with them."""
    x = F.regexp_replace(x, r"<NUM>\s*", "")
    x = F.regexp_replace(x, r"<NEG>\s*", "-")
    x = F.regexp_replace(x, r"\s*<DECIMAL>\s*", ".")
    return stripped(F.regexp_replace(x, r"(?<=\d)\s+(?=\d)", ""))


RUN = 256


def running_sums(values: Column) -> Column:
    """array<int>: the sums up to each element, in runs of RUN, since appending copies what there is."""

    def sums(run: Column, base: Column) -> Column:
        whole = F.aggregate(run, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(whole, F.lit(2), F.size(run))

    def of(v: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(v) - 1, F.lit(RUN)).cast("int")), lambda k: F.slice(v, k * RUN + 1, F.lit(RUN)))
        total = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc + x)
        return let(runs, lambda rs: let(F.transform(rs, total), lambda ts: F.flatten(F.transform(rs, lambda r, i: sums(r, total(F.slice(ts, F.lit(1), i)))))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.array().cast("array<int>")))


def matches_at(x: Column, pattern: str) -> Column:
    """array<struct<place, start, stop, value>>: a pattern's matches from left to right, with their places in characters. Starts follow from the lengths of the
    matches and of what lies between them. The pattern must not match nothing."""

    def placed(m: Column) -> Column:
        steps = F.transform(m["v"], lambda _, i: F.length(F.get(m["b"], i)) + F.coalesce(F.length(F.get(m["v"], i - 1)), F.lit(0)))
        return let(running_sums(steps), lambda starts: F.transform(m["v"], lambda v, i: F.struct(i.alias("place"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(v)).alias("stop"), v.alias("value"))))

    x = F.coalesce(x, F.lit(""))
    return let(F.struct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)).alias("v"), F.split(x, pattern, -1).alias("b")), placed)


def tool_calls(x: Column) -> Column:
    """array<struct<place, tool, expr, start, stop>>: every call of a text, from left to right."""
    part = lambda v, i: F.regexp_extract(v, TOOL_CALL, i)
    return F.transform(matches_at(x, TOOL_CALL), lambda m: F.struct(m["place"].alias("place"), F.lower(part(m["value"], 1)).alias("tool"), stripped(part(m["value"], 2)).alias("expr"), m["start"].alias("start"), m["stop"].alias("stop")))
