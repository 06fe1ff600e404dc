"""Near-duplicate documents by MinHash signatures, a multi-index join under a signature distance, and full sets.

1. Each document's set of distinct word shingles gives a digest, which collapses equal sets into classes, and a signature of MinHash
   values of 8 bits. The signature distance is the number of values that differ.
2. The signature is cut into chunks. Chunk i may differ in errors[i] values; a key is a chunk with that many of its values left out, for
   every choice of them. Two signatures at distance less than sum(errors[i] + 1) = 27 agree in some key, by the pigeonhole principle: none
   under that distance is missed. The guarantee ends there: a pair at similarity 0.8 exactly differs in 28.7 values on average, and shares
   no key with probability 7e-5; above it, less.
3. Every member of a key is compared with the key's smallest class; links found are confirmed on the full sets. What is then connected is
   one component, so a key whose members all are needs no more comparison, however many there are. Of the keys that still hold several
   components, those with many members are compared with a few of them, by hash, once more.
4. What then still shares a key with another component is compared in blocks: the documents that such keys connect are a family, a family
   is dealt into blocks of bounded size, and each pair of blocks is one task's work on full sets, which gives a forest of the links
   found. A document's set goes to each pair of blocks once, and no pair of documents is ever a row. A family of more than `family`
   documents is compared by key instead.

No key's or family's members are gathered in one task: minima are partial aggregates, comparisons are joins or pairs of blocks. No table that
grows with the documents is broadcast: a row gives many keys, which estimates of size don't know, so joins are by merge.

Defined cases: null text or no words: empty set, linked with nothing; fewer words than a shingle has: the whole sequence is the one
shingle; rows that repeat an id share its result if their sets are equal, and are documents of their own if not; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import U64, PieceEncoder, by_merge, discard, mix64, row_slices, staged, table, text_chunks, word_hashes
from sparkloom.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    """similarity: least share of shingles in common, in percent; words: per shingle; errors: values that may differ, by chunk;
    chunk: values of one; turns, leaders: how often, and with how many of its members, those of a key with more than block members are compared
    before they are in blocks; doubt: greatest signature distance of a member from a leader that is worth a look at the full sets (at 0.8 five
    standard deviations off); block, mass: documents and shingles of a block; family: documents of one that are compared as a whole."""

    words: int = 5
    percent: int = 80
    chunk: int = 6
    errors: tuple[int, ...] = field(default=(1,) * 3 + (0,) * 21)
    doubt: int = 53
    turns: int = 1
    leaders: int = 8
    block: int = 2048
    mass: int = 1 << 20
    family: int = 1 << 15

    @property
    def values(self) -> int:
        return self.chunk * len(self.errors)


_ROW_LIMIT = 4096  # shingles that are hashed against all values at a time
ROWS = 512  # rows that a worker holds with their sets at a time
CHUNK = 1 << 18  # bytes of text at a time: some eight arrays of 8 bytes each


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix64(np.arange(1, n + 1, dtype=U64) * U64(0xA24BAED4963EE407)) | U64(1)
    b = mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9FB21C651E98DF25))
    return a, b


def shingle_sets(column, words: int):
    """Yields (row, sorted distinct 64-bit shingle hashes) for each text of an Arrow column."""
    for lo, buf, bounds in text_chunks(column, CHUNK):
        h, _, first = word_hashes(buf, bounds)
        for i in range(len(bounds) - 1):
            own = h[first[i] : first[i + 1]]
            k = min(words, len(own))
            if not k:
                yield lo + i, own
                continue
            acc = own[: len(own) - k + 1].copy()
            for j in range(1, k):
                acc = mix64(acc * U64(0x9E3779B97F4A7C15) + own[j : len(own) - k + 1 + j])
            if len(own) < words:
                acc = mix64(acc + U64(len(own)))
            yield lo + i, np.unique(acc)


def signature(shingles: np.ndarray, values: int) -> np.ndarray:
    """The low 8 bits of the smallest hash under each of `values` functions."""
    a, b = _multipliers(values)
    low = np.full(values, np.iinfo(np.uint64).max, dtype=U64)
    for i in range(0, len(shingles), _ROW_LIMIT):
        part = shingles[i : i + _ROW_LIMIT]
        for j in range(0, values, 16):  # rows of 16 functions stay in the cache
            np.minimum(low[j : j + 16], (a[j : j + 16, None] * part + b[j : j + 16, None]).min(axis=1), out=low[j : j + 16])
    return (mix64(low) & U64(0xFF)).astype(np.uint8)


def _key_plan(s: Settings) -> list[tuple[int, ...]]:
    return [tuple(c * s.chunk + i for i in keep) for c, e in enumerate(s.errors) for keep in combinations(range(s.chunk), s.chunk - e)]


def all_keys(sigs: np.ndarray, s: Settings) -> np.ndarray:
    """Every chunk of each signature with its allowed errors left out in every way, as 64-bit hashes: a row a signature. Choices have
    distinct seeds, so keys of different choices don't meet."""
    plan = _key_plan(s)
    out = np.empty((len(sigs), len(plan)), dtype=U64)
    wide, seeds = sigs.astype(U64), np.arange(len(plan), dtype=U64) * U64(0xC2B2AE3D27D4EB4F)
    for k, places in enumerate(plan):
        x = np.zeros(len(sigs), dtype=U64)
        for i in places:
            x = (x << U64(8)) | wide[:, i]
        out[:, k] = mix64(x * U64(0x9E3779B97F4A7C15) + seeds[k])
    return out.view(np.int64)


def _digest(shingles: np.ndarray) -> bytes:
    place = np.arange(1, len(shingles) + 1, dtype=U64)
    return np.array([int(mix64(shingles * place + U64(k)).sum(dtype=U64)) for k in (11, 29)], dtype=U64).tobytes()


def _digests(s: Settings) -> Callable:
    def run(batches):
        import pyarrow as pa

        PieceEncoder.release()
        for batch in row_slices(batches, ROWS):
            rows, sizes, digests, sigs = [], [], [], []
            for row, shingles in shingle_sets(batch.column(1), s.words):
                rows.append(row)
                sizes.append(len(shingles))
                if len(shingles):
                    digests.append(_digest(shingles))
                    sigs.append(signature(shingles, s.values).view(np.int64))
                else:
                    digests.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), batch.column(2).take(pa.array(rows))], ["doc_id", "n_shingles", "digest", "sig", "row"])

    return run


def _emit_keys(s: Settings) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            sigs = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(len(ids), s.values)
            keys = all_keys(sigs, s)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], ["key", "id"])

    return run


def _full_sets(words: int) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in row_slices(batches, ROWS):
            rows, sets, digests = [], [], []
            for row, shingles in shingle_sets(batch.column(1), words):
                rows.append(row)
                sets.append(shingles.tobytes())
                digests.append(_digest(shingles) if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(sets, pa.large_binary()).cast(pa.binary()), pa.array(digests, pa.binary())], ["first", "shingles", "digest"])

    return run


def _confirm(percent: int) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                merged = np.sort(np.concatenate([p, q]), kind="stable")
                both = int((merged[1:] == merged[:-1]).sum())
                ok.append(bool(both) and 100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def _close_enough(s: Settings) -> Column:
    """Signature distance and set sizes allow the similarity. Values are compared eight to a long: a byte of x ^ y that isn't zero leaves one bit."""
    different = []
    for i in range(s.values // 8):
        z = F.col("p.sig")[i].bitwiseXOR(F.col("q.sig")[i])
        for n, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, n)).bitwiseAND(F.lit(mask))
        different.append(F.bit_count(z))
    total = different[0]
    for d in different[1:]:
        total = total + d
    p, q = F.col("p.size"), F.col("q.size")
    return (100 * F.least(p, q) >= s.percent * F.greatest(p, q)) & (total <= s.doubt)


def _groups(mixed: DataFrame, s: Settings) -> DataFrame:
    """(group, id, part): documents that must be compared with all of their group. A group is a family, the documents that mixed keys
    connect; where a family has more than s.family documents, each of its keys is a group."""
    heads = mixed.groupBy("key").agg(F.min("id").alias("head"))
    linked = connected_components(mixed.join(by_merge(heads), "key").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())
    linked = staged(linked, "families")
    wide = linked.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") > s.family).select("component")
    placed = mixed.join(by_merge(linked), F.col("id") == F.col("node"), "left").join(by_merge(wide.withColumn("wide", F.lit(True))), "component", "left")
    return placed.select(F.when(F.col("wide"), F.xxhash64("key")).otherwise(F.xxhash64("component", F.lit(0))).alias("group"), "id", "part").distinct()


def _links_in_blocks(mixed: DataFrame, sizes: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """Links between the parts of each group, as a forest. A group is dealt by hash into blocks of about s.block documents and s.mass
    shingles; a pair of blocks is one piece of work and gives fewer rows than it has documents, however many pairs are alike."""
    group = staged(_groups(mixed, s).join(by_merge(sizes), "id"), "groups")
    blocks = group.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("mass"), F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most")
    blocks = blocks.select("group", F.greatest(F.ceil(F.col("n") / s.block), F.ceil(F.col("mass") / s.mass)).cast("int").alias("blocks"))
    placed = group.join(by_merge(blocks), "group").withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int"))
    dealt = placed.select("group", "id", "part", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("group", "id", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("second"))
    work = dealt.join(by_merge(sets), "id").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "second")
    out = staged(work.select("group", "x", "y", "second", "id", "part", "shingles").mapInArrow(_compare_blocks(s.percent), "a long, b long"), "links")
    discard(group)
    return out


COLUMNS = 2048  # of shingles that a matrix product takes at a time


def common_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x has in common with each of y. Shingles that many of y hold are counted by matrix products, the others
    by their lists of holders."""
    every, place = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    cut = sum(map(len, x))
    row_x, row_y = np.repeat(np.arange(len(x)), [len(v) for v in x]), np.repeat(np.arange(len(y)), [len(v) for v in y])
    at_x, at_y = place[:cut], place[cut:]
    held = np.bincount(at_y, minlength=len(every))
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    often = held > max(8, len(y) // 32)
    number = np.cumsum(often) - 1
    for low in range(0, int(often.sum()), COLUMNS):
        sides = []
        for rows, at, n in ((row_x, at_x, len(x)), (row_y, at_y, len(y))):
            take = often[at] & (number[at] >= low) & (number[at] < low + COLUMNS)
            m = np.zeros((n, COLUMNS), dtype=np.float32)
            m[rows[take], number[at[take]] - low] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    seldom = ~often[at_y]
    order = np.argsort(at_y[seldom], kind="stable")
    holders, held = row_y[seldom][order], np.where(often, 0, held)
    starts = np.cumsum(held) - held
    few = held[at_x] > 0
    row_x, at_x = row_x[few], at_x[few]
    for low in range(0, len(at_x), 1 << 16):  # each entry has few holders
        rows, at = row_x[low : low + (1 << 16)], at_x[low : low + (1 << 16)]
        n = held[at]
        ends = np.cumsum(n)
        which = np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1])
        first, last = rows[0], rows[-1] + 1
        cells = np.bincount((np.repeat(rows, n) - first) * len(y) + holders[which], minlength=(last - first) * len(y))
        out[first:last] += cells.reshape(last - first, len(y))
    return out


def forest_of_links(ids, parts, sets, second, percent: int) -> list[tuple[int, int]]:
    """Links that connect what links between documents of different parts connect. second: which are of the second block; a pair has one of
    each, or any two where there is no second block."""
    one, two = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(ids)),) * 2
    if not len(one) or (parts == parts[0]).all():
        return []
    sizes = np.array([len(v) for v in sets])
    both = common_counts([sets[i] for i in one], [sets[i] for i in two])
    linked = (100 * both >= percent * (sizes[one][:, None] + sizes[two][None, :] - both)) & (parts[one][:, None] != parts[two][None, :])
    label = np.unique(parts, return_inverse=True)[1]
    out = []
    for r in np.flatnonzero(linked.any(axis=1)):
        i = one[r]
        to = two[linked[r]]
        _, first = np.unique(label[to], return_index=True)
        for j in to[first]:
            if label[j] != label[i]:
                out.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return out


def _compare_blocks(percent: int) -> Callable:
    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        now = None

        def done():
            ids, parts, second, sets = zip(*held, strict=True)
            found = forest_of_links(np.array(ids), np.array(parts), list(sets), np.array(second), percent)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            second, ids, parts = (batch.column(k).to_pylist() for k in range(3, 6))
            for k, key in enumerate(keys):
                if key != now and held:
                    yield done()
                now = key
                held.append((ids[k], parts[k], second[k], np.frombuffer(batch.column(6)[k].as_py(), U64)))
        if held:
            yield done()

    return run


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id is the component's)."""
    return _found(docs, settings, id_col, text_col).drop("row")


def _row(text_col: str) -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(text_col)


def _found(docs: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """The rows of near_duplicates with the row's hash. A class is named by its smallest doc_id, or by its digest where rows of that doc_id are in
    several classes."""
    s = settings
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), _row(text_col).alias("row"))
    members = staged(texts.mapInArrow(_digests(s), "doc_id long, n_shingles long, digest binary, sig array<long>, row long"), "members")
    named = members.where("digest is not null and doc_id is not null")
    split = named.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x <> y").select(F.col("doc_id").alias("first"), F.lit(True).alias("split"))
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("first"), F.min("n_shingles").alias("size"), F.min("sig").alias("sig"))
    classes = staged(classes.join(by_merge(staged(split, "split")), "first", "left").select("digest", F.when(F.col("split"), F.xxhash64("digest")).otherwise(F.col("first")).alias("id"), "first", "size", "sig"), "classes")

    keys = classes.select("id", "sig").mapInArrow(_emit_keys(s), "key long, id long")
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader", "n")
    shared = staged(keys.join(by_merge(leaders), "key"), "keys")
    # One pass over the texts gives the full sets of all documents that share a key with another.
    sharing = shared.select("id").distinct().join(by_merge(classes.select("id", "first", "digest")), "id")
    sharing = staged(sharing, "sharing")
    read = texts.join(by_merge(sharing.select(F.col("first").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(_full_sets(s.words), "first long, shingles binary, digest binary")
    sets = staged(read.join(by_merge(sharing), ["first", "digest"]).groupBy("id").agg(F.first("shingles").alias("shingles")), "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        pairs = staged(pairs, "pairs")
        both = pairs.join(by_merge(left), "a").join(by_merge(right), "b").select("a", "b", "x", "y")
        out = staged(both.mapInArrow(_confirm(s.percent), "a long, b long"), "links")
        discard(pairs)
        return out

    known = classes.select("id", "size", "sig")
    close = _close_enough(s)

    def worth_a_look(pairs: DataFrame) -> DataFrame:
        p, q = known.alias("p"), known.alias("q")
        return pairs.distinct().join(by_merge(p), F.col("a") == F.col("p.id")).join(by_merge(q), F.col("b") == F.col("q.id")).where(close).select("a", "b")

    def still_mixed(parts: DataFrame) -> DataFrame:
        """(key, id, part, n) of the keys whose members are of several components."""
        placed = shared.join(by_merge(parts), F.col("id") == F.col("node"), "left").select("key", "id", "n", F.coalesce("component", "id").alias("part"))
        mixed = placed.groupBy("key").agg(F.min("part").alias("least"), F.max("part").alias("most")).where("least <> most").select("key")
        return staged(placed.join(by_merge(mixed), "key"), "mixed")

    links = confirmed(worth_a_look(shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))))
    parts = staged(connected_components(links), "parts")
    mixed = still_mixed(parts)
    for turn in range(s.turns):
        large = mixed.where(F.col("n") > s.block)
        if large.isEmpty():
            break
        leaders = large.groupBy("key").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(turn * s.leaders + k)).alias("at"), F.col("id").alias("to"), F.col("part").alias("of"))).alias(f"l{k}") for k in range(s.leaders)])
        met = large.join(by_merge(leaders), "key").select("id", "part", F.explode(F.array(*[f"l{k}" for k in range(s.leaders)])).alias("l")).where("part <> l.of")
        links = links.union(confirmed(worth_a_look(met.select(F.least("id", "l.to").alias("a"), F.greatest("id", "l.to").alias("b")))))
        parts = staged(connected_components(links), "parts")
        discard(mixed)
        mixed = still_mixed(parts)
    links = links.union(_links_in_blocks(mixed, classes.select("id", "size"), sets, s))
    final = staged(connected_components(links), "parts")
    discard(shared, sharing, sets, mixed, parts)

    placed = staged(classes.join(by_merge(final), F.col("id") == F.col("node"), "left").select("digest", "id", "first", F.coalesce("component", "id").alias("part")), "placed")
    renamed = placed.where("id <> first").select("part").distinct()
    least = staged(placed.join(by_merge(renamed), "part", "left_semi").groupBy("part").agg(F.min("first").alias("least")), "least")
    of_class = placed.join(by_merge(least), "part", "left").select("digest", F.coalesce("least", "part").alias("component"))
    out = members.join(by_merge(of_class), "digest", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row")


def keep_first(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that no smaller document of their component stands for; rows that repeat its id, or have none, stay."""
    found = _found(docs, settings, id_col, "text")
    gone = found.where("not kept").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    return docs.join(by_merge(gone), (F.col(id_col) == F.col("_id")) & (_row("text") == F.col("_row")), "left_anti").select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Settings(words=2))
