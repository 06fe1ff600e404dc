"""Scoring texts by online logistic mixing of bit predictors, and a smoothed unigram score beside it.

A text (in lower case, A-Z only) is its bytes and an END, each of which is the bits of its Huffman code after the byte before it. Every bit is predicted in
its contexts: the last three bytes and the last five, whatever they are, the word so far, and that with the word before it. A context and the code's node name a
slot with counts of zeros and ones. The slots' estimates, in the logistic domain, are summed by weights that a gate selects (how sure the two contexts of
words are); the sum's probability is refined by a map from levels of the sum to what was met there. After each STEP bits the gate's weights take a step down the
slope of their cost, and the map's levels a step to the bits, before the next ones are predicted. A text's score is the sum over its bits, and of nothing else.

Fitting: counts of pairs of bytes give the code; one pass over all training texts counts the slots, whose number follows the input up to MOST_BITS. Sums don't
depend on how rows are dealt, so neither do scores, but for rounding. Weights start from START_WEIGHTS and the map from the sum's own probability in each text.

Texts are read side by side, a bit of each at a time. One of more than SEGMENT bytes is read in segments, each of which starts from those weights and
that map; contexts run on.

The unigram score needs each word's exact count: those above a threshold, at most HOT_WORDS of them, go to every worker; the others are joined with one
row for each document and word.

Defined cases: null text counts as empty: one token, the end; rows that repeat are scored each by itself, though the counts hold both; a
table without training rows gives N = V = 0 and unigram scores of 0 by log10(1 / 1); columns besides id and text are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import _BYTE_CODE, _LOWER, _SPACE, U64, _powers, mix64, staged, table, text_chunks, word_spans
from sparkloom.llm.mixing import HOT_WORDS, WHITE, _gathered, _hashes, _hot_threshold, _strings, _word_counts, held_out

ORDERS = (3, 5)
CONTEXTS = 4  # so many bytes; the word so far; that and the word before
END = 0xFF  # never a byte of UTF-8
PAD = max(ORDERS)  # bytes before a text's first
MOST_BITS = (22, 22, 22, 22)  # of slots' numbers
NODES = 256
SCALE = 16.0  # of estimates that are kept as bytes
GATES = 9
LEVELS = 33  # of the refinement, over [-8, 8] in the logistic domain
LIMIT = 8.0
STEP = 4  # bits that are predicted before weights and map move
RATE = 0.02  # of weights
MAP_RATE = 0.02
START_WEIGHTS = (0.4, 0.45, 0.3, 0.45)
FLOOR = 1e-4  # of a bit's probability
CHUNK = 1 << 15  # bytes of text at a time whose slots are looked up: arrays of some eight bytes a bit stay in the cache
READ = 1 << 21  # bytes of text that are read side by side
SEGMENT = 2048
BLOCK = 1 << 16
TASK = 1 << 28


# ---------------------------------------------------------------- bits and their contexts


@dataclass
class Code:
    """sizes, starts: of the bits of each pair of a byte and the one after it, of which the latter is coded; cells: all pairs' bits, one after another, 2 * node + bit."""

    sizes: np.ndarray
    starts: np.ndarray
    cells: np.ndarray


def code_of(counts: np.ndarray) -> Code:
    """The Huffman codes of bytes after each byte, by the counts of pairs, each of which counts one more."""
    paths = [p for k in range(NODES) for p in _paths(counts[NODES * k : NODES * (k + 1)].tolist())]
    sizes = np.array([len(p) for p in paths], np.int64)
    return Code(sizes, np.cumsum(sizes) - sizes, np.array([c for p in paths for c in p], np.int64))


def _paths(counts: list[int]) -> list[list[int]]:
    """Each byte's bits. Nodes are numbered from the one that is met most, so that a context's usual slots lie together."""
    heap = [(n + 1, b) for b, n in enumerate(counts)]
    heapq.heapify(heap)
    children, weight = {}, {}
    name = NODES
    while len(heap) > 1:
        (n, a), (m, b) = heapq.heappop(heap), heapq.heappop(heap)
        children[name], weight[name] = (a, b), n + m
        heapq.heappush(heap, (n + m, name))
        name += 1
    number = {x: k for k, x in enumerate(sorted(weight, key=lambda x: (-weight[x], -x)))}
    paths: list[list[int]] = [[] for _ in range(NODES)]
    todo = [(name - 1, [])]
    while todo:
        at, path = todo.pop()
        for bit, child in enumerate(children[at]):
            own = [*path, 2 * number[at] + bit]
            if child < NODES:
                paths[child] = own
            else:
                todo.append((child, own))
    return paths


def contexts_of(buf: np.ndarray, bounds: np.ndarray, bits: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each byte of the texts and their ENDs as a pair with the byte before it, and for each context the number of its first slot. Nothing before a text's start counts."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    full = np.full(len(buf) + n * (PAD + 1), END, dtype=np.uint8)
    heads = np.arange(n) * (PAD + 1) + PAD + bounds[:-1]  # where each text's bytes start, after its padding
    full[np.arange(len(buf)) + np.repeat(np.arange(n) * (PAD + 1) + PAD, sizes)] = _LOWER[buf]
    at = np.arange(len(buf) + n) + np.repeat(np.arange(n) * PAD + PAD, sizes + 1)
    wide = full.astype(U64)
    last, orders = np.zeros(len(full), U64), []
    for k in range(1, PAD + 1):
        last[k:] |= wide[:-k] << U64(8 * (k - 1))
        if k in ORDERS:
            orders.append(last.take(at))
    first = np.zeros(len(full), dtype=bool)
    first[1:] = _SPACE[full[:-1]]
    first[heads] = True
    begins = np.flatnonzero(first)
    p, inv = _powers(len(full) + 1)
    acc = np.empty(len(full) + 1, dtype=U64)
    acc[0] = 0
    np.cumsum(_BYTE_CODE[full] * p[: len(full)], out=acc[1:])
    part = np.cumsum(first)[at] - 1
    begin = begins.take(part)
    word = (acc.take(at) - acc.take(begin)) * inv.take(begin) + (at - begin).astype(U64)
    # The word before: of a text's first there is none.
    ends = np.maximum(np.append(begins[1:], 1) - 1, begins)
    whole = mix64((acc[ends] - acc[begins]) * inv[begins] + (ends - begins).astype(U64))
    before = np.append(U64(0), whole[:-1])
    before[np.searchsorted(begins, heads)] = 0
    pair = word + before.take(part) * U64(0xD6E8FEB86659FD93)
    # Nodes are those of the code after the last byte, which a word that has not begun doesn't tell.
    last = wide.take(at - 1)
    hashes = [mix64(x * U64(0x9E3779B97F4A7C15)) for x in orders] + [mix64(x + last) for x in (word, pair)]
    return (last << U64(8) | wide.take(at)).astype(np.int64), [(h >> U64(64 - b)).astype(np.int64) for h, b in zip(hashes, bits, strict=True)]


def slots_in(bits: tuple[int, ...]) -> list[int]:
    return [(1 << b) + NODES for b in bits]


def _cells(code: Code, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which byte each bit is of, 2 * node + bit of each bit)."""
    sizes = code.sizes.take(pairs)
    of = np.repeat(np.arange(len(pairs)), sizes)
    at = (code.starts.take(pairs) - (np.cumsum(sizes) - sizes)).take(of)
    at += np.arange(len(of))
    return of, code.cells.take(at)


def count_bits(counts: list[np.ndarray], code: Code, bits: tuple[int, ...], buf: np.ndarray, bounds: np.ndarray) -> None:
    """Adds some texts' bits to the counts of zeros and ones (in turn) of each context's slots."""
    pairs, bases = contexts_of(buf, bounds, bits)
    of, cells = _cells(code, pairs)
    for k in range(CONTEXTS):
        at = (2 * bases[k]).take(of)
        at += cells
        np.add.at(counts[k], at, np.int32(1))


def estimates(counts: np.ndarray) -> np.ndarray:
    """Each slot's estimate in the logistic domain, as a byte. Drawn to nothing where little was seen."""
    zeros, ones = counts[0::2].astype(np.float64), counts[1::2].astype(np.float64)
    return np.clip(np.rint(SCALE * np.log((ones + 0.4) / (zeros + 0.4))), -127, 127).astype(np.int8)


@dataclass
class Model:
    """bits: of the slots' numbers; tables: each context's estimates by slot."""

    code: Code
    bits: tuple[int, ...]
    tables: list[np.ndarray]


def _sure(x: np.ndarray) -> np.ndarray:
    size = np.abs(x)
    return (size > 8).view(np.int8) + (size > 40).view(np.int8)


def inputs_of(model: Model, pairs: np.ndarray, bases: list[np.ndarray]) -> np.ndarray:
    """For each bit eight bytes in one number: the estimates, the gate and the bit."""
    of, cells = _cells(model.code, pairs)
    rows, nodes, sure = np.empty((len(cells), 8), np.int8), cells >> 1, []
    for k in range(CONTEXTS):
        at = bases[k].take(of)
        at += nodes
        x = model.tables[k].take(at)
        rows[:, k] = x
        if k >= CONTEXTS - 2:
            sure.append(_sure(x))
    rows[:, 6] = sure[0] * np.int8(3) + sure[1]
    rows[:, 7] = cells & 1
    return rows.view(U64).ravel()


# ---------------------------------------------------------------- reading side by side


class Readers:
    """What moves while segments are read side by side: each one's weights by gate and its map, which start as the same for all."""

    def __init__(self, n: int):
        # Weights are by the estimates' scale. A row of four is moved as one item, which is faster than by columns.
        self.weights = np.tile(np.array(START_WEIGHTS, np.float32) / np.float32(SCALE), (n * GATES, 1)).view(np.complex128).ravel()
        self.levels = np.tile((1 / (1 + np.exp(-np.linspace(-LIMIT, LIMIT, LEVELS)))).astype(np.float32), n)
        self.gates, self.rungs = np.arange(n) * GATES, np.arange(n, dtype=np.int32) * LEVELS
        self.rate, self.map_rate = np.float32(RATE / SCALE**2), np.float32(MAP_RATE)

    def read(self, rows: np.ndarray, who) -> np.ndarray:
        """log2 of the probability of rows (bit by segment), by weights and maps as they were; then these take their step. The gate is that of the first bit; where
        two bits are at one level, the later moves it."""
        v = rows.view(np.int8).reshape(*rows.shape, 8)
        x = [v[..., k].astype(np.float32) for k in range(CONTEXTS)]
        y = v[..., 7].astype(np.float32)
        gate = self.gates[who] + v[0, :, 6]
        item = self.weights.take(gate)
        w = item.view(np.float32).reshape(-1, CONTEXTS)
        dot = x[0] * w[:, 0]
        for k in range(1, CONTEXTS):
            dot += x[k] * w[:, k]
        np.minimum(np.maximum(dot, -_HIGH, out=dot), _HIGH, out=dot)
        level = (dot * _STEEP + _MIDDLE).astype(np.int32) + self.rungs[who]
        miss, q = y - _ONE / (_ONE + np.exp(-dot)), self.levels.take(level)
        far = y - q
        # 1 less the mean of both distances.
        chance = _ONE - np.minimum(np.abs(miss + far) * _HALF, _MOST)
        miss *= self.rate
        for k in range(CONTEXTS):
            x[k] *= miss
            w[:, k] += x[k].sum(axis=0)
        self.weights[gate] = item
        far *= self.map_rate
        self.levels[level] = q + far
        return np.log2(np.multiply.reduce(chance, axis=0, dtype=np.float64))


_HIGH, _STEEP, _MIDDLE = np.float32(LIMIT - 0.01), np.float32((LEVELS - 1) / (2 * LIMIT)), np.float32(LEVELS / 2)
_ONE, _HALF, _MOST = np.float32(1), np.float32(0.5), np.float32(1 - FLOOR)


def read_bits(rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log2 of the probability of each of some segments. rows: the inputs of their bits, one segment after another; bounds: where each starts, and the end."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    at, sizes = bounds[:-1][order].copy(), sizes[order]
    readers, cost = Readers(n), np.zeros(n)
    whole, ahead = sizes // STEP, np.arange(STEP)[:, None]
    for a in np.searchsorted(-whole, -np.arange(int(whole[0]) if n else 0), side="left").tolist():
        cost[:a] += readers.read(rows.take(at[:a] + ahead), slice(a))
        at[:a] += STEP
    for k in range(STEP - 1):  # the bits after a segment's last whole step, one by one
        who = np.flatnonzero(sizes % STEP > k)
        cost[who] += readers.read(rows[at[who] + k][None], who)
    out = np.empty(n)
    out[order] = cost
    return out


def read_texts(model: Model, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """log2 of each text's probability."""
    n, rows, lengths, texts = len(bounds) - 1, [], [], []
    low = 0
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK, side="right")) - 1))
        part = bounds[low : high + 1] - bounds[low]
        pairs, bases = contexts_of(buf[bounds[low] : bounds[high]], part, model.bits)
        heads = part + np.arange(len(part))
        pieces = -(-np.diff(heads) // SEGMENT)
        of = np.repeat(np.arange(len(pieces)), pieces)
        lengths.append(np.add.reduceat(model.code.sizes[pairs], heads[of] + SEGMENT * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))))
        texts.append(of + low)
        # A long text's slots are looked up by parts, so that what is held beside the inputs stays small.
        for k in range(0, len(pairs), 2 * CHUNK):
            at = slice(k, k + 2 * CHUNK)
            rows.append(inputs_of(model, pairs[at], [x[at] for x in bases]))
        low = high
    if not n:
        return np.zeros(0)
    return np.bincount(np.concatenate(texts), weights=read_bits(np.concatenate(rows), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])), minlength=n)


# ---------------------------------------------------------------- fitting


def pair_counts(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each pair of a byte and the next one comes, with END before and after each text."""
    n = len(bounds) - 1
    full = np.full(len(buf) + n + 1, END, np.int32)
    full[np.arange(1, len(buf) + 1) + np.repeat(np.arange(n), np.diff(bounds))] = _LOWER[buf]
    return np.bincount((full[:-1] << 8) | full[1:], minlength=NODES * NODES)


def _pairs(batches):
    import pyarrow as pa

    counts = np.zeros(NODES * NODES, np.int64)
    for batch in batches:
        for _, buf, bounds in text_chunks(batch.column(0), 1 << 18):
            counts += pair_counts(buf, bounds)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], ["pair", "n"])


def _packed(counts: np.ndarray) -> bytes:
    """Counts as planes of their bytes, as many as the largest needs."""
    planes = max(1, (int(counts.max()).bit_length() + 7) // 8)
    return np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T[:planes]).tobytes()


def _unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    planes = np.frombuffer(data, np.uint8).reshape(-1, size)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


_BLOCKS = "context int, block int, size int, data binary"


def _blocks(rows):
    import pyarrow as pa

    for row in rows:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["context", "block", "size", "data"])


def _count(code: Code, bits: tuple[int, ...]) -> Callable:
    """A partition's counts, in blocks of BLOCK at most."""

    def run(batches):
        counts = [np.zeros(2 * n, np.int32) for n in slots_in(bits)]
        for batch in batches:
            for _, buf, bounds in text_chunks(batch.column(0), CHUNK):
                count_bits(counts, code, bits, buf, bounds)
        for k, own in enumerate(counts):
            for at in range(0, len(own), BLOCK):
                part = own[at : at + BLOCK]
                if part.any():
                    yield from _blocks([(k, at // BLOCK, len(part), _packed(part))])

    return run


def _estimate(batches):
    """Estimates of equal blocks' sums, which come one after another; one block is held."""
    at, total = None, None
    for batch in batches:
        for context, block, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (context, block) != at:
                if at is not None:
                    yield from _blocks([(*at, len(total), estimates(total).tobytes())])
                at, total = (context, block), np.zeros(size, np.uint64)
            total += _unpacked(data, size)
    if at is not None:
        yield from _blocks([(*at, len(total), estimates(total).tobytes())])


def fit(training: DataFrame) -> Model:
    """training: text. The driver gets a byte for each slot."""
    counts = np.zeros(NODES * NODES, np.int64)
    for pair, n in training.mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n")).collect():
        counts[pair] = n
    code, most = code_of(counts), max(14, int(counts.sum()).bit_length())
    bits = tuple(min(b, most) for b in MOST_BITS)
    # A task gives its counts once, however many texts it reads, so there are no more than run at a time or have TASK bytes each.
    few = training.coalesce(max(training.sparkSession.sparkContext.defaultParallelism, int(counts.sum()) // TASK))
    tables = [np.zeros(n, np.int8) for n in slots_in(bits)]
    summed = few.mapInArrow(_count(code, bits), _BLOCKS).repartition("context", "block").sortWithinPartitions("context", "block").mapInArrow(_estimate, _BLOCKS)
    for context, block, size, data in summed.collect():
        tables[context][block * (BLOCK // 2) : block * (BLOCK // 2) + size // 2] = np.frombuffer(data, np.int8)
    return Model(code, bits, tables)


# ---------------------------------------------------------------- documents


def _score(model, hot) -> Callable:
    """Per document: its own columns, and its words that aren't hot, with how often each occurs."""

    def run(batches):
        import pyarrow as pa

        words, values = hot.value
        for batch in batches:
            bits = [read_texts(model.value, buf, bounds) for _, buf, bounds in text_chunks(batch.column(1), READ)]
            kept: list[list] = [[], [], []]
            out: list[list] = [[], [], [], []]
            for _, buf, bounds in text_chunks(batch.column(1), 1 << 19):
                h, starts, ends, first = word_spans(buf, bounds)
                signed = h.view(np.int64)
                at = np.minimum(np.searchsorted(words, signed), max(len(words) - 1, 0))
                known = words[at] == signed if len(words) else np.zeros(len(h), bool)
                value = np.where(known, values[at], 0.0) if len(words) else np.zeros(len(h))
                acc, seen = np.concatenate([[0.0], np.cumsum(value)]), np.concatenate([[0], np.cumsum(known)])
                out[0].append(first[1:] - first[:-1] + 1)
                out[1].append(seen[first[1:]] - seen[first[:-1]])
                out[2].append(acc[first[1:]] - acc[first[:-1]])
                out[3].append(np.diff(bounds) + 1)
                # Rare words: by document, then by hash.
                rare = np.flatnonzero(~known)
                doc = np.searchsorted(first, rare, side="right") - 1
                order = np.lexsort((h[rare], doc))
                rare, doc = rare[order], doc[order]
                new = np.concatenate([[True], (h[rare][1:] != h[rare][:-1]) | (doc[1:] != doc[:-1])])[: len(rare)]
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(rare)))
                rare, doc = rare[heads], doc[heads]
                kept[0].append(_strings(*_gathered(_LOWER[buf], starts[rare], ends[rare])))
                kept[1].append(times)
                kept[2].append(np.bincount(doc, minlength=len(bounds) - 1))
            if not bits:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(kept[2]))]).astype(np.int32))
            lists = [pa.concat_arrays(kept[0]), pa.array(np.concatenate(kept[1]).astype(np.int32))]
            n, seen, base, size = (np.concatenate(x) for x in out)
            columns = [pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(np.concatenate(bits)), pa.array(size.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, *(pa.ListArray.from_arrays(offsets, x) for x in lists)], SCORED_NAMES)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, hot_known long, base double, bits double, bytes long, words array<string>, times array<int>"
SCORED_NAMES = [x.split()[0] for x in SCORED.split(", ")]


def score_online(docs: DataFrame, is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the text's bytes and its end). Learns from the rows
    that is_held_out leaves."""
    context = docs.sparkSession.sparkContext
    training = docs.where(~is_held_out).select(F.col(text_col))
    n_docs = training.count()
    met = staged(training.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    known = met.where(~F.col("word").isin(list(WHITE)))
    got = known.agg(F.count("*"), F.sum("n")).first()
    distinct, total = got[0] + (n_docs > 0), (got[1] or 0) + n_docs
    denominator = np.log10(total + distinct + 1) if total + distinct else 0.0
    model = context.broadcast(fit(training))
    frequent = known.where(F.col("n") >= _hot_threshold(known, HOT_WORDS)).toArrow()
    hashes = _hashes(frequent.column("word"))
    order = np.argsort(hashes)
    hot = context.broadcast((hashes[order], np.log10(frequent.column("n").to_numpy()[order] + 1.0)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), is_held_out.alias("held_out"))
    scored = staged(rows.mapInArrow(_score(model, hot), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    model.destroy()
    hot.destroy()
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(known, "word").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_base"))
    end_known, end_score = int(n_docs > 0), float(np.log10(n_docs + 1))
    return scored.drop("words", "times").join(found, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_score - F.col("n_tokens") * float(denominator)).alias("base_score"),
        (F.col("bits") * float(np.log10(2))).alias("score"),
        (-F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_online(docs, held_out())
