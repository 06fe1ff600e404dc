"""One-permutation MinHash fingerprints, in DataFrame functions alone.

A text's words (A-Z lower-cased) give shingles of five, each hashed once. The upper bits of a hash name its bin, the rest is its value.
One value per bin that is greater than any hash is added, so that sorting the hashes and taking the first of each bin gives all bins in
order: the minima of those that are met, the added value of those that are empty. An empty bin borrows from another: the first met bin
of a fixed sequence of probes of its own, which ends in an order of all bins, so the choice never depends on how many are
met (optimal densification). A fingerprint is the lowest BITS of every bin as hexadecimal digits. Two fingerprints' likeness is the share of
equal digits, less what chance gives: (share - 2 ** -BITS) / (1 - 2 ** -BITS), at least 0.

Defined cases: null text counts as empty; no words: an empty fingerprint, like only to another empty one (1) and to nothing else (0); fewer
words than five: the whole sequence is the one shingle; rows are ordered by (doc_id, text), null ids first, so rows that repeat follow each other;
a single row is its own next; an empty table gives no row; columns besides id and text are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import let, table

WORDS = 5
BINS = 256
BIN_BITS = 8
BITS = 4
PER_LONG = 16
PROBES = 8
LOW = (1 << (64 - BIN_BITS)) - 1  # a value greater than any hash has in its bin
BUCKETS_A_PARTITION = 4
MAX_BOUNDS = 16_384

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column) -> Column:
    """array<bigint>: a hash of every five words in a row."""
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        parts = [h] + [F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - k, F.lit(0))) for k in range(1, WORDS)]
        zipped = F.slice(F.arrays_zip(*parts), F.lit(1), F.greatest(F.size(h) - (WORDS - 1), F.lit(0)))
        return F.when(F.size(h) >= WORDS, F.transform(zipped, lambda x: F.xxhash64(x))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.expr("cast(array() as array<bigint>)"))

    return let(hashed, shingles)


def _empty(value: Column) -> Column:
    return value.bitwiseAND(F.lit(LOW)) == F.lit(LOW)


def _bin_of(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - BIN_BITS)


def bins(hashes: Column) -> Column:
    """array<bigint> of BINS values in the order of signed hashes; an array without elements for no hashes."""
    added = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), 64 - BIN_BITS).bitwiseOR(F.lit(LOW)))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (_bin_of(x) != _bin_of(F.get(s, i - 1))))

    return let(F.sort_array(F.concat(hashes, added)), firsts)


def densified(values: Column) -> Column:
    """Every empty bin gets the value of the first met bin among its probes."""

    def fill(d: Column) -> Column:
        def borrowed(i: Column) -> Column:
            tried = F.transform(F.array(*[F.lit(k) for k in range(PROBES)]), lambda k: F.get(d, F.pmod(F.xxhash64(i, k), F.lit(BINS)).cast("int")))
            by_order = F.array_min(F.transform(d, lambda v, j: F.when(~_empty(v), F.struct(F.xxhash64(j, i).alias("at"), v.alias("v")))))
            # With the bin's number in it, so that bins that borrow the same value don't all agree, or differ, by one chance.
            return F.xxhash64(F.coalesce(F.get(F.filter(tried, lambda v: ~_empty(v)), F.lit(0)), by_order["v"]), i)

        return F.transform(d, lambda v, i: F.when(_empty(v), borrowed(i)).otherwise(v))

    return let(values, fill)


def packed(values: Column) -> Column:
    """array<bigint>: the lowest BITS of each value, PER_LONG of them to a long."""

    def pack(d: Column) -> Column:
        longs = []
        for w in range(0, BINS, PER_LONG):
            longs.append(F.aggregate(F.slice(d, w + 1, PER_LONG), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v.bitwiseAND(F.lit((1 << BITS) - 1).cast("long")))))
        return F.array(*longs)

    return let(values, pack)


def signature(text: Column) -> Column:
    """array<bigint> with BINS / PER_LONG elements; null for a text without words."""
    return let(shingle_hashes(text), lambda h: F.when(F.size(h) > 0, packed(densified(bins(h)))))


def as_text(sig: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, with the bias of BITS taken off."""

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        return F.bit_count(z)

    chance = 2.0**-BITS
    share = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, n: acc + n) / F.lit(float(BINS))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def with_next(rows: DataFrame, key: str, tie: str, columns: list[str]) -> DataFrame:
    """Adds next_<column> from the row after in the order of (key, tie), and from the first row for the last. One shuffle and no window over
    the whole table: rows are dealt into ranges between values of key, and every range gets a copy of the next one's first rows."""
    spark = rows.sparkSession
    wanted = max(1, min(MAX_BOUNDS, BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = rows.agg(F.expr(f"percentile_approx({key}, array({','.join(str(k / wanted) for k in range(1, wanted))}), 10000)") if wanted > 1 else F.lit(None).cast("array<bigint>"), F.min(key), F.sum(F.col(key).isNull().cast("int"))).first()
    first = None if got[2] else got[1]
    bounds = sorted({b for b in got[0] or [] if b is not None and (first is None or b > first)})
    step = max(1, int(len(bounds) ** 0.5))
    coarse, fine = bounds[::step], [bounds[k : k + step] for k in range(0, len(bounds), step)]
    if bounds:
        upto = lambda values: F.size(F.filter(values, lambda b: b <= F.col(key)))
        head = upto(F.array(*[F.lit(int(b)) for b in coarse]))
        tables = F.array(*[F.array(*[F.lit(int(b)) for b in part]) for part in fine])
        bucket = F.when(F.col(key).isNull() | (head == 0), F.lit(0)).otherwise((head - 1) * step + upto(F.get(tables, head - 1)))
    else:
        bucket = F.lit(0)
    last = len(bounds)
    at = F.col("_bucket")
    is_bound = F.array_contains(F.get(F.array(*[F.array(*[F.lit(int(b)) for b in part]) for part in fine]), F.floor((at - 1) / F.lit(step)).cast("int")), F.col(key)) if bounds else F.lit(False)
    copies = F.array_compact(
        F.array(
            F.struct(at.alias("b"), F.lit(0).alias("copy")),
            F.when((at > 0) & F.coalesce(is_bound, F.lit(False)), F.struct((at - 1).alias("b"), F.lit(1).alias("copy"))),
            F.when(F.col(key).eqNullSafe(F.lit(first).cast("long")), F.struct(F.lit(last).alias("b"), F.lit(2).alias("copy"))),
        )
    )
    dealt = rows.withColumn("_bucket", bucket).withColumn("_to", F.explode(copies))
    w = W.partitionBy("_to.b").orderBy("_to.copy", key, tie)
    out = dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("_to.copy = 0").drop("_bucket", "_to")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sig", signature(F.col("text"))), "doc_id", "text", ["text", "sig"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    return (
        rows.select("doc_id", n.cast("long").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
        .select("doc_id", "n_chars", "sig", "next_sig", F.sha2("edited", 256).alias("edited_sha256"), signature(F.col("edited")).alias("edited_sig"))
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            as_text(F.col("sig")).alias("fingerprint"),
            as_text(F.col("edited_sig")).alias("edited_fingerprint"),
            likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
            likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
        )
    )


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
