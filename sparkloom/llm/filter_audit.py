"""How five document filters overlap, in any order of applying them, from joint-failure counts by inclusion and exclusion.

For every set T of filters, J(T) is the number of documents that fail all of T: the sum of the product of their flags. All the rest is
arithmetic on these 32 counts, for each part and for all, good and toxic documents alike:

- survivors of a set S: the sum over T within S of (-1)^|T| J(T) (Moebius inversion), so what an order keeps, removes and loses at each step;
- failing f alone: the sum over T that hold f of (-1)^(|T| - 1) J(T);
- the game v(S) = documents that S removes has the Harsanyi dividends (-1)^(|T| + 1) J(T), which a set's members share equally: f's Shapley
  value is the sum over T that hold f of dividend / |T|, here times the number of orders, so that it stays whole.

Equal texts agree in every flag but E, so documents are first counted by text, part and labels. Whether a document fails E is
told by its text's smallest id, hence only a text's groups meet, never its documents.

Defined cases: null text counts as empty (no words, so B holds off: 0 < 0 is false); a null lang and an empty one are the same part; a null id
neither fails E nor makes another fail; rows that repeat an id and a text both pass or both fail E; a document is good (toxic) if any of its rows in
labels says so, and rows of labels without a document count for nothing; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
KINDS = ("all", "good", "toxic")
SALTS = 64


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at the text alone."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def _any_is(column: str) -> Column:
    return F.max(F.coalesce(F.col(column) == 1, F.lit(False)))


def text_groups(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, good, toxic, A to E (as 0 or 1), n: documents counted by all that decides about them. A text may have several rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    flags = text_flags(text)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.cast("int").alias(f) for f, c in flags.items()])
    keys = ["part", "digest", *flags]
    counted = named.groupBy("id", *keys).agg(F.count(F.lit(1)).alias("n"))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(_any_is("quality").alias("good"), _any_is("toxic").alias("toxic"))
    # Rows without an id meet no label; the salt keeps them from coming to one task.
    salted = counted.withColumn("salt", F.when(F.col("id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(0))
    labelled = salted.join(told.withColumn("salt", F.lit(0).cast("long")), ["id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    groups = labelled.groupBy(*keys, "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"))
    # A text has a group for each part and pair of labels, so a window over its groups is small whatever the number of copies.
    told_first = groups.withColumn("smallest", F.min("first.id").over(W.partitionBy("digest")))
    passing = F.col("unnamed") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    by_e = F.array(F.struct(F.lit(0).alias("E"), passing.alias("n")), F.struct(F.lit(1).alias("E"), (F.col("n") - passing).alias("n")))
    return told_first.select("part", "good", "toxic", *flags, F.inline(by_e))


def members(s: int) -> list[str]:
    return [f for i, f in enumerate(FILTERS) if s >> i & 1]


def joint_failures(groups: DataFrame) -> DataFrame:
    """part, and for each of all, good and toxic an array with J(T) at the place of T, whose bits name its filters."""
    weights = {"all": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}

    def joint(weight: Column, s: int) -> Column:
        product = weight
        for f in members(s):
            product = product * F.col(f)
        return F.sum(product)

    # Counts by flags first: the 96 sums then have at most 32 rows a part and pair of labels to go over.
    flagged = groups.groupBy("part", "good", "toxic", *FILTERS).agg(F.sum("n").alias("n"))
    sums = flagged.groupBy("part").agg(*[joint(w, s).cast("long").alias(f"{k}{s}") for k, w in weights.items() for s in range(SETS)])
    return sums.select("part", *[F.array(*[F.col(f"{k}{s}") for s in range(SETS)]).alias(k) for k in KINDS])


def _sign(t: Column) -> Column:
    return 1 - 2 * (F.bit_count(t) % 2)


def _over_sets(joint: Column, counts: Column, term) -> Column:
    """The sum over all T that counts(T) holds for of term(T, J(T))."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(SETS - 1)), F.lit(0).cast("long"), lambda acc, t: acc + F.when(counts(t), term(t, F.get(joint, t))).otherwise(0))


def survivors(joint: Column) -> Column:
    """array: the documents that fail no filter of S, at the place of S."""
    return F.transform(F.sequence(F.lit(0), F.lit(SETS - 1)), lambda s: _over_sets(joint, lambda t: t.bitwiseAND(s) == t, lambda t, j: _sign(t) * j))


def audit(groups: DataFrame) -> DataFrame:
    """part, filter_order, step, and what the step's filter does there; see op11_filter_audit."""
    has = lambda bit: lambda t: t.bitwiseAND(bit) != 0
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    alone = F.transform(bits, lambda bit: _over_sets(F.col("all"), has(bit), lambda t, j: -_sign(t) * j))
    shapley = F.transform(bits, lambda bit: _over_sets(F.col("all"), has(bit), lambda t, j: -_sign(t) * j * F.floor(F.lit(len(ORDERS)) / F.bit_count(t))))
    solved = joint_failures(groups).select("part", F.transform(bits, lambda bit: F.get(F.col("all"), bit)).alias("failing"), alone.alias("alone"), shapley.alias("shapley"), *[survivors(F.col(k)).alias(k) for k in KINDS])
    stepped = solved.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def taken(upto: Column) -> Column:
        """The set of the filters of an order's first steps."""
        place = lambda f: F.instr("filter_order", f)
        return sum((F.when(place(f) <= upto, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    at = stepped.withColumn("before", taken(F.col("step") - 1)).withColumn("after", taken(F.col("step"))).withColumn("f", F.instr(F.lit(FILTERS), F.substring("filter_order", F.col("step"), F.lit(1))) - 1)
    lost = {k: F.get(F.col(k), F.col("before")) - F.get(F.col(k), F.col("after")) for k in KINDS}
    of = lambda c: F.get(F.col(c), F.col("f")).cast("long").alias(c)
    return at.select(
        "part",
        "filter_order",
        "step",
        F.get(F.col("all"), F.col("after")).alias("kept"),
        lost["all"].alias("removed"),
        (of("failing") - lost["all"]).alias("redundant"),
        of("alone").alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        of("shapley").alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part, order of the filters and step: kept (after it), removed, redundant (failing, but removed earlier), unique_fails, good_lost, toxic_lost, shapley."""
    return audit(text_groups(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
