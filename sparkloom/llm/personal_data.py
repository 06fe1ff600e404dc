"""Personal data in texts: four kinds by their form, and others by the contexts that these are found in. DataFrame functions alone.

1. Emails, IP addresses, card and phone numbers are matched by patterns and checked (parts up to 255, Luhn's sum, numbers of digits). Positions follow from the
   lengths of the matches and of what lies between them, by running sums.
2. Candidates are tokens with an @ between letters or digits, or with five digits or more. One that is itself of a kind is a seed; one that only holds such
   a match is no candidate. A candidate's contexts are the word before it, the two words before it, and the word after it, in lower case.
3. Contexts and distinct values form a graph. A context's score for a kind is the sum of its values' scores (a seed's is 1) over the number of its
   values and one more; it is trusted from TRUST on, if the sum is SUPPORT at least. A value that is no seed has for each kind 1 less the product of 1 - score over its
   trusted contexts, if it looks like one of the kind at all (LIKE), and is accepted from ACCEPT on. Accepted values count in the next round; there are ROUNDS. Values are distinct, so copies of a text
   change no score.
4. Every place where an accepted value stands as a candidate is a span of kind likely_*. Matches of the four kinds always stay.

Defined cases: null text counts as empty and has no span; rows that repeat are searched each by itself, null ids as well; an empty table gives no row; offsets are code
points, ends exclusive; spans come by start and then kind, in the order of KINDS; a value that two kinds accept equally is of the first; columns besides id and
text are left out. Patterns never take back what they took but for a phone's last digit, so time grows with a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import let, staged, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"likely_{k}" for k in BASE))
ROUNDS, TRUST, SUPPORT, ACCEPT = 3, 0.6, 3, 0.8
DIGITS = 5

# Possessive forms of the kinds' patterns. A match may only start where one could not have started earlier: at the end of the last match, or
# where the character before can't be part of its beginning.
_LOCAL = "[A-Za-z0-9._%+-]"
_EMAIL = rf"{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": rf"(?:\G|(?<!{_LOCAL})){_EMAIL}", "ip": rf"(?<![0-9]){_IP}", "card": rf"(?<![0-9]){_CARD}", "phone": _PHONE}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_GOOD_IP = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

_UNIT = "[A-Za-z0-9@._%+()/-]"
_NUMBER = r"[+(]*+[0-9][0-9().-]*+(?:\x20[0-9(][0-9().-]*+)*+"
CANDIDATE = rf"(?<!{_UNIT})(?:{_NUMBER}(?!{_UNIT})|[A-Za-z._%+()/-]*+[0-9@]{_UNIT}*+)"
# What an accepted value of a kind must look like: an address with a sign that parts it, or so many digits and their separators.
LIKE = {"email": "@", "ip": r"^[0-9]+(?:\.[0-9]+){2,}+(?:/[0-9]+)?$", "card": r"^(?:[0-9][ -]?+){12,19}+$", "phone": r"^\+?(?:[ ().-]*+[0-9]){6,15}+$"}
_OUTSIDE = "@._%/-"
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
RUN = 256


def running(values: Column) -> Column:
    """The sums up to each element. In runs of RUN, since appending copies what there is."""

    def sums(block: Column, base: Column) -> Column:
        whole = F.aggregate(block, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        return F.slice(whole, F.lit(2), F.size(block))

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(RUN)).cast("int")), lambda b: F.slice(v, b * RUN + 1, F.lit(RUN)))
        return let(blocks, lambda bs: let(F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x)), lambda totals: F.flatten(F.transform(bs, lambda b, i: sums(b, F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0), lambda acc, x: acc + x))))))

    return let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.expr("cast(array() as array<int>)")))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>>: the matches, each with what lies between it and its neighbours."""

    def located(x: Column) -> Column:
        gaps = F.transform(x["v"], lambda _, i: F.length(F.get(x["b"], i)) + F.coalesce(F.length(F.get(x["v"], i - 1)), F.lit(0)))
        return let(running(gaps), lambda starts: F.transform(x["v"], lambda v, i: F.struct(F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(v)).alias("end"), v.alias("value"), F.get(x["b"], i).alias("before"), F.get(x["b"], i + 1).alias("after"))))

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("b")), located)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits have a Luhn sum that ends in 0."""
    at = lambda d, i: F.ascii(F.substring(d, F.length(d) - i + 1, F.lit(1))) - 48
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, twice(at(d, i))).otherwise(at(d, i)))
    return let(digits, lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(False))


def holds(kind: str, value: Column) -> Column:
    """Whether a match of a kind's pattern passes the kind's check."""
    if kind == "ip":
        return value.rlike(_GOOD_IP)
    if kind == "card":
        return _luhn(_digits(value))
    return F.length(_digits(value)).between(10, 15) if kind == "phone" else F.lit(True)


def _spans_of(text: Column, kind: str) -> Column:
    good = F.filter(matches(text, PATTERNS[kind]), lambda m: holds(kind, m["value"]))
    return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def _no_spans() -> Column:
    return F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, value>> in order; kind is the place in KINDS."""
    needed = {"email": "@", "phone": "+"}
    found = [F.when(F.contains(text, F.lit(needed[k])), _spans_of(text, k)).otherwise(_no_spans()) if k in needed else _spans_of(text, k) for k in BASE]
    return F.sort_array(F.concat(*found))


def _of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _contexts(before: Column, after: Column) -> Column:
    """The contexts that have a letter, by where they stand."""
    lead, follow = F.lower(F.right(before, F.lit(64))), F.lower(F.left(after, F.lit(32)))
    one = F.regexp_extract(lead, rf"(?<!{_WORD})({_WORD}{{1,24}}+){_GAP}*$", 1)
    two = F.regexp_replace(F.regexp_extract(lead, rf"(?<!{_WORD})({_WORD}{{1,24}}+{_GAP}++{_WORD}{{1,24}}+){_GAP}*$", 1), f"{_GAP}+", " ")
    next_one = F.regexp_extract(follow, rf"^{_GAP}*+({_WORD}{{1,24}}+)(?!{_WORD})", 1)
    return F.filter(F.array(F.concat(F.lit("1 "), one), F.concat(F.lit("2 "), two), F.concat(F.lit("3 "), next_one)), lambda c: c.rlike(r"^. .*\p{L}"))


def _kind_of(value: Column) -> Column:
    """The kind that a whole value is of; -1 where it only holds a match of one, null where it holds none."""
    card = F.regexp_extract(value, PATTERNS["card"], 0)
    whole = {k: value.rlike(rf"^(?:{p})$") & holds(k, value) for k, p in (("email", _EMAIL), ("ip", _IP), ("phone", _PHONE))}
    part = value.rlike(PATTERNS["email"]) | value.rlike(PATTERNS["ip"]) | value.rlike(PATTERNS["phone"])
    is_card = lambda c: F.when(_luhn(_digits(c)), F.when(c == value, BASE.index("card")).otherwise(-1)).when(part, -1)
    return F.when(whole["email"], 0).when(whole["ip"], 1).when(whole["phone"], 3).otherwise(let(card, is_card))


def candidates(text: Column) -> Column:
    """array<struct<start, end, value, kind, contexts>>: kind is that of a seed, else null."""

    def trimmed(m: Column) -> Column:
        left = F.ltrim(m["value"], F.lit(_OUTSIDE))
        value = F.rtrim(left, F.lit(_OUTSIDE + "+("))
        start = m["start"] + F.length(m["value"]) - F.length(left)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), m["before"].alias("before"), m["after"].alias("after"))

    tried = F.filter(F.transform(matches(text, CANDIDATE), trimmed), lambda m: m["value"].rlike("[A-Za-z0-9]@[A-Za-z0-9]") | (F.regexp_count(m["value"], F.lit("[0-9]")) >= DIGITS))
    told = F.transform(tried, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), _kind_of(m["value"]).alias("kind"), _contexts(m["before"], m["after"]).alias("contexts")))
    return F.filter(told, lambda c: F.coalesce(c["kind"], F.lit(0)) >= 0)


def located(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, base, candidates, staged without the texts: row numbers are then as fixed as the file."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), base_spans(text).alias("base"), candidates(text).alias("candidates")), "located")


def graph(located: DataFrame) -> DataFrame:
    """context, value, kind: each context with each distinct value that it was met with; staged."""
    met = located.select(F.explode("candidates").alias("c")).select(F.explode("c.contexts").alias("context"), "c.value", "c.kind")
    return staged(met.groupBy("context", "value").agg(F.first("kind").alias("kind")), "graph")


def trusted(edges: DataFrame, accepted: DataFrame | None) -> DataFrame:
    """context, s0 to s3: its score for each kind, 0 where it isn't trusted for it; contexts that no kind trusts are left out. accepted: value, kind, score."""
    ways = range(len(BASE))
    sums = edges.groupBy("context").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).cast("double").alias(f"s{k}") for k in ways])
    if accepted is not None:
        found = accepted.select("value", F.col("kind").alias("found"), "score")
        more = edges.where("kind is null").join(found, "value").groupBy("context").agg(*[F.sum(F.when(F.col("found") == k, F.col("score")).otherwise(0.0)).alias(f"m{k}") for k in ways])
        sums = sums.join(more, "context", "left").select("context", "n", *[(F.col(f"s{k}") + F.coalesce(f"m{k}", F.lit(0.0))).alias(f"s{k}") for k in ways])
    score = lambda k: F.col(f"s{k}") / (F.col("n") + 1)
    kept = sums.select("context", *[F.when((F.col(f"s{k}") >= SUPPORT) & (score(k) >= TRUST), F.round(score(k), 6)).otherwise(0.0).alias(f"s{k}") for k in ways])
    return kept.where(F.greatest(*[F.col(f"s{k}") for k in ways]) > 0)


def accepted_by(edges: DataFrame, contexts: DataFrame) -> DataFrame:
    """value, kind, score of the values that are no seeds and that trusted contexts accept."""
    ways = range(len(BASE))
    scores = edges.where("kind is null").join(contexts, "context").groupBy("value").agg(*[F.round(1 - F.exp(F.sum(F.log(1 - F.least(f"s{k}", F.lit(0.999))))), 6).alias(f"s{k}") for k in ways])
    scores = scores.select("value", *[F.when(F.col("value").rlike(LIKE[kind]), F.col(f"s{k}")).otherwise(0.0).alias(f"s{k}") for k, kind in enumerate(BASE)])
    top = F.array_max(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(-k).alias("k")) for k in ways]))
    return scores.select("value", top.alias("t")).where(F.col("t.score") >= ACCEPT).select("value", (-F.col("t.k")).alias("kind"), F.col("t.score").alias("score"))


def bootstrap(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contexts with their scores, values accepted) of the last round."""
    accepted = None
    for _ in range(ROUNDS):
        contexts = staged(trusted(edges, accepted), "contexts")
        accepted = staged(accepted_by(edges, contexts), "accepted")
    return contexts, accepted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: array<struct<start, kind, end, value>> of each row, in order; kind is the place in KINDS."""
    rows = located(docs, id_col, text_col)
    _, accepted = bootstrap(graph(rows))
    unknown = rows.select("row", F.explode("candidates").alias("c")).where("c.kind is null").select("row", "c.start", "c.end", "c.value")
    likely = unknown.join(accepted.select("value", "kind"), "value").groupBy("row").agg(F.collect_list(F.struct("start", (F.col("kind") + len(BASE)).alias("kind"), "end", "value")).alias("likely"))
    return rows.select("row", "doc_id", "base").join(likely, "row", "left").select("doc_id", F.sort_array(F.concat("base", F.coalesce("likely", _no_spans()))).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and a digest of the four kinds' spans, and all spans as text."""
    found = find(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    counts = [F.size(_of_kind(F.col("found"), k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
