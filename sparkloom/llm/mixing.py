"""Scoring texts by a fitted mixing of bit predictors and whole words, and a smoothed unigram score beside it. op9_mixing is in online_mixing.py.

A text is words (in lower case, A-Z only) and single white space bytes, after each of which a word may come; its end closes the last. Its
score has three parts.

1. Whether a word comes, and which white space or end follows: shares of all training texts.
2. A word by its spelling, bit by bit, with an END. Contexts are the last byte, two, three, five bytes of the word so far, and all of it. A hash
   of a context and of the bits of the byte so far names a slot with counts of zeros and ones. The slots' estimates, in the logistic domain,
   are combined by weights that a gate selects (the bit, and how much was met in the longer contexts); the sum is refined by a map from
   (bits so far, sum) to what was met there.
3. A word as a whole: its share of all training words, exact, from a table with a row for each distinct word, which grows with the corpus and
   never leaves the cluster. Whole and spelling are mixed at each word; the models of MIXES mix them by other weights, and are themselves
   weighted, online, by how well each has predicted the text so far, which makes the text's probability the mean of theirs.

Fitting reads the texts once, for the table of words; the rest is fitted on the table, each word with its count. One pass counts the slots, whose
number is fixed: they serve words that the table lacks. In the next, every run (a byte and the word before it) is predicted from counts
without itself, as a coder that has not yet met it would; slopes and curvatures of the cost are summed for each gate, and the gate's
weights take one Newton step from START_WEIGHTS, while the refinement counts what came at each level of the first sum. Sums don't depend on
how rows are dealt, so neither do scores, but for rounding.

Scoring: words above a threshold, at most HOT_WORDS of them, go to every worker; the others are joined with one row for each document and
word. Words without a row in the table are spelled by the worker.

Defined cases: null text counts as empty: one token, the end; rows that repeat are scored each by itself, though the counts hold both; a
table without training rows gives N = V = 0 and unigram scores of 0 by log10(1 / 1); columns besides id and text are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import _BYTE_CODE, _LOWER, _SPACE, U64, _powers, crc32_of_id, discard, mix64, staged, text_chunks, word_hashes, word_spans

CONTEXTS = 5  # one, two and three bytes; five bytes of the word; the whole word so far
SLOT_BITS = (16, 18, 19, 20, 22)
BASES = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
END = 0xFF  # never a byte of UTF-8
PAD = 5  # bytes before a text's first
GATES = 8 * 4**3  # bit in the byte; how much was seen in each of the three longest contexts
NODES = 256
LEVELS = 33  # of the refinement, over [-8, 8] in the logistic domain
LIMIT = 8.0
MIXES = (-2.0, 0.0, 2.0)  # added to the logit of the whole word's weight
RIDGE = 4.0
START_WEIGHTS = (0.0, 0.1, 0.2, 0.3, 0.4)
BATCH = 1 << 14
CHUNK = 1 << 17  # bytes of text at a time: arrays of 8 bytes each that stay in the cache
BLOCK = 4096
HOT_WORDS = 200_000
WHITE = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- runs of bytes


def runs_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of each text and its END: a key of all that its prediction depends on (the three bytes before it and the word so far), the byte in lower case (A-Z only) with the PAD before it, and a hash
    of the word so far (the bytes since the last white space, the text's start at most)."""
    n, sizes = len(bounds) - 1, np.diff(bounds)
    step = PAD + 1
    full = np.full(len(buf) + n * step, END, dtype=U64)
    heads = np.arange(n) * step + PAD + bounds[:-1]  # where each text's bytes start, after its padding
    place = np.arange(len(buf)) + np.repeat(np.arange(n) * step + PAD, sizes)
    full[place] = _LOWER[buf]
    at = np.arange(len(buf) + n) + np.repeat(np.arange(n) * PAD + PAD, sizes + 1)  # the bytes that are predicted
    run = full[at].copy()
    for k in range(1, PAD + 1):
        run |= full[at - k] << U64(8 * k)
    small = full.astype(np.uint8)
    begin = np.zeros(len(full), dtype=np.int64)
    after = np.flatnonzero(_SPACE[small[:-1]]) + 1
    begin[after] = after
    begin[heads] = heads
    np.maximum.accumulate(begin, out=begin)
    p, inv = _powers(len(full) + 1)
    acc = np.empty(len(full) + 1, dtype=U64)
    acc[0] = 0
    np.cumsum(_BYTE_CODE[small] * p[: len(full)], out=acc[1:])
    begin = begin[at]
    word = mix64((acc[at] - acc[begin]) * inv[begin] + (at - begin).astype(U64))
    return word + (run & U64(0xFFFFFFFF)) * U64(0x9E3779B97F4A7C15), run, word


def _in_word(run: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """The last `size` bytes, those before the word's start left out."""
    ctx = (run >> U64(8)) & U64((1 << (8 * size)) - 1)
    keep = np.full(len(ctx), (1 << (8 * size)) - 1, dtype=U64)
    for k in range(size - 1, -1, -1):
        byte = (ctx >> U64(8 * k)) & U64(0xFF)
        keep[(byte == 32) | ((byte >= 9) & (byte <= 13)) | (byte == END)] = (1 << (8 * k)) - 1
    return ctx & keep


def _context_slots(run: np.ndarray, word: np.ndarray) -> list[np.ndarray]:
    """For each context and bit the slot of each run: [context] -> (bits, runs)."""
    nodes = _nodes(run)
    wide = nodes.astype(U64) * U64(0xD6E8FEB86659FD93)
    ctxs = [(run >> U64(8)) & U64((1 << (8 * k)) - 1) for k in (1, 2, 3)] + [_in_word(run, word, PAD) + U64(1 << 40), word]
    out = [((ctxs[0].astype(np.int64)) << 8)[None, :] | nodes]
    for k in range(1, CONTEXTS):
        h = mix64(ctxs[k] * U64(0x9E3779B97F4A7C15) + U64(k))
        out.append(((h[None, :] + wide) * U64(0x9FB21C651E98DF25) >> U64(64 - SLOT_BITS[k])).astype(np.int64) + int(BASES[k]))
    return out


def _bits(run: np.ndarray) -> np.ndarray:
    byte = (run & U64(0xFF)).astype(np.int64)
    return np.stack([(byte >> (7 - k)) & 1 for k in range(8)])


def _nodes(run: np.ndarray) -> np.ndarray:
    """The bits of the byte so far, after a leading one."""
    byte = (run & U64(0xFF)).astype(np.int64)
    return np.stack([(1 << k) | (byte >> (8 - k)) for k in range(8)])


def _distinct(key: np.ndarray, *columns: np.ndarray) -> tuple:
    """(distinct keys, how often each came, columns at one of its places). Sorting keys alone is several times faster than sorting places; a
    place of a key is kept in a table by its leading bits, and keys that lost theirs to another are looked up."""
    ordered = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    own, n = ordered[first], np.diff(np.append(first, len(key)))
    if not columns:
        return own, n
    shift = U64(64 - max(4, len(key).bit_length()))
    table = np.zeros(1 << (64 - int(shift)), dtype=np.int64)
    table[key >> shift] = np.arange(len(key))
    at = table[own >> shift] if len(own) else first
    lost = np.flatnonzero(key[at] != own) if len(own) else first
    if len(lost):
        places = np.flatnonzero(np.isin(key, own[lost]))
        at[lost] = places[np.unique(key[places], return_index=True)[1]]
    return own, n, *(c[at] for c in columns)


class Tally:
    """Counts by key, with other columns that the key determines, merged as chunks come."""

    def __init__(self):
        self.parts, self.size, self.last, self.merging = [], 0, 0, False

    def add(self, key: np.ndarray, *columns: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            self._add(*_distinct(key, *columns))
        else:
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            n = np.add.reduceat(counts[order], first) if len(key) else counts
            self._add(key[first], n, *(c[order[first]] for c in columns))
        if not self.merging and self.size > 2 * self.last + 1_000_000:
            self.merge()

    def _add(self, key: np.ndarray, *rest: np.ndarray) -> None:
        self.parts.append((key, *rest))
        self.size += len(key)

    def merge(self) -> tuple:
        if len(self.parts) > 1:
            key, n, *columns = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.parts, self.merging = [], True
            self.add(key, *columns, counts=n)
            self.merging = False
        if self.parts:
            self.size = self.last = len(self.parts[0][0])
        return self.parts[0] if self.parts else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))


def _partition_runs(batches) -> tuple:
    """(key, count, run, word) of the distinct runs of a partition's (word, count) rows."""
    tally = Tally()
    for batch in batches:
        n = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, buf, bounds in text_chunks(batch.column(0), CHUNK):
            tally.add(*runs_of(buf, bounds), counts=np.repeat(n[lo : lo + len(bounds) - 1], np.diff(bounds) + 1))
    return tally.merge()


def slot_counts(counts: np.ndarray, run: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(events, ones) of every slot."""
    ones, total = np.zeros(int(BASES[-1])), np.zeros(int(BASES[-1]))
    for i in range(0, len(run), 1 << 16):
        at = slice(i, i + (1 << 16))
        w, bits = counts[at].astype(np.float64), _bits(run[at])
        for slots in _context_slots(run[at], word[at]):
            for k in range(8):
                np.add.at(total, slots[k], w)
                np.add.at(ones, slots[k], w * bits[k])
    return total, ones


def _packed(a: np.ndarray) -> bytes:
    """Counts as planes of bytes, nearly all of which are zeros or small, compressed."""
    return zlib.compress(np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _block(number: int, total: np.ndarray, ones: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([_packed(total)], pa.binary()), pa.array([_packed(ones)], pa.binary())], ["block", "n", "ones"])


def _count_slots(batches):
    """A partition's counts, in blocks of BLOCK slots."""
    total, ones = slot_counts(*_partition_runs(batches)[1:])
    for k in range(0, len(total), BLOCK):
        if total[k : k + BLOCK].any():
            yield _block(k // BLOCK, total[k : k + BLOCK], ones[k : k + BLOCK])


def _sum_blocks(batches):
    """Sums of equal blocks that come one after another; one block is held."""
    number, total, ones = None, None, None
    for batch in batches:
        for k, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != number:
                if number is not None:
                    yield _block(number, total, ones)
                number, total, ones = k, np.zeros(BLOCK, np.uint64), np.zeros(BLOCK, np.uint64)
            total += _unpacked(n)
            ones += _unpacked(m)
    if number is not None:
        yield _block(number, total, ones)


# ---------------------------------------------------------------- prediction


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -LIMIT, LIMIT)))


def _inputs(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Estimates in the logistic domain, drawn to nothing where little was seen."""
    return np.clip(_stretch((ones + 0.4) / (n + 0.8)), -LIMIT, LIMIT)


@dataclass
class Tables:
    n: np.ndarray
    ones: np.ndarray


def _gate(bit: int, seen: list[np.ndarray]) -> np.ndarray:
    """seen: how often the three longest contexts were met; 0, 1 or 2, up to 12, or more."""
    gate = np.full(len(seen[0]), bit, dtype=np.int64)
    for n in seen:
        gate = gate * 4 + ((n > 0).astype(np.int64) + (n > 2) + (n > 12))
    return gate


@dataclass
class Mixer:
    """n: what each slot met; inputs: its estimate; weights: gate by context; refine: node by level of the first sum, the probability met there."""

    n: np.ndarray
    inputs: np.ndarray
    weights: np.ndarray
    refine: np.ndarray

    def bits(self, run: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log2 of the probability of each run's last byte, negated."""
        slots, bits, nodes = _context_slots(run, word), _bits(run), _nodes(run)
        cost = np.zeros(len(run))
        for k in range(8):
            gate = _gate(k, [self.n[s[k]] for s in slots[2:]])
            inputs = [self.inputs[s[k]] for s in slots]
            x = sum(self.weights[gate, i] * v for i, v in enumerate(inputs))
            met = self._met(nodes[k], sum(w * v for w, v in zip(START_WEIGHTS, inputs, strict=True)))
            p = np.clip((_squash(x) + met) / 2, 1e-5, 1 - 1e-5)
            cost -= np.log2(np.where(bits[k] == 1, p, 1 - p))
        return cost

    def _met(self, node: np.ndarray, x: np.ndarray) -> np.ndarray:
        at = (np.clip(x, -LIMIT, LIMIT) + LIMIT) * ((LEVELS - 1) / (2 * LIMIT))
        low = np.minimum(at.astype(np.int64), LEVELS - 2)
        part = at - low
        return self.refine[node, low] * (1 - part) + self.refine[node, low + 1] * part


def _start_refine() -> np.ndarray:
    return np.tile(_squash(np.linspace(-LIMIT, LIMIT, LEVELS)), (NODES, 1))


_PAIRS = [(i, j) for i in range(CONTEXTS) for j in range(i, CONTEXTS)]


def moments(tables: Tables, counts: np.ndarray, run: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gate: the cost's slope by each weight, then its curvature by each pair of them; node and level: ones, then events), of some runs."""
    by_gate, by_level = np.zeros((CONTEXTS + len(_PAIRS), GATES)), np.zeros((2, NODES * LEVELS))
    for i in range(0, len(run), BATCH):
        at = slice(i, i + BATCH)
        c = counts[at].astype(np.float64)
        slots, bits, nodes = _context_slots(run[at], word[at]), _bits(run[at]), _nodes(run[at])
        for k in range(8):
            y = bits[k].astype(np.float32)
            seen = [np.maximum(tables.n[s[k]] - 1, 0) for s in slots]
            gate = _gate(k, seen[2:])
            x = [_inputs(np.maximum(tables.ones[s[k]] - y, 0), n) for s, n in zip(slots, seen, strict=True)]
            dot = sum(w * v for w, v in zip(START_WEIGHTS, x, strict=True))
            p = _squash(dot)
            slope, bend = c * (y - p), c * p * (1 - p)
            for j, v in enumerate(x):
                by_gate[j] += np.bincount(gate, weights=slope * v, minlength=GATES)
            for n, (a, b) in enumerate(_PAIRS):
                by_gate[CONTEXTS + n] += np.bincount(gate, weights=bend * x[a] * x[b], minlength=GATES)
            cell = nodes[k] * LEVELS + np.rint((np.clip(dot, -LIMIT, LIMIT) + LIMIT) * ((LEVELS - 1) / (2 * LIMIT))).astype(np.int64)
            by_level[0] += np.bincount(cell, weights=c * y, minlength=NODES * LEVELS)
            by_level[1] += np.bincount(cell, weights=c, minlength=NODES * LEVELS)
    return by_gate, by_level


def _moments(tables: Tables) -> Callable:
    def run(batches):
        import pyarrow as pa

        kept = _partition_runs(batches)
        flat = np.concatenate([x.ravel() for x in moments(tables, *kept[1:])])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(flat[some])], ["place", "value"])

    return run


def newton_weights(by_gate: np.ndarray) -> np.ndarray:
    """One step from START_WEIGHTS for each gate; RIDGE keeps gates that met little near the start, and steps have a length of 1 at most."""
    weights = np.tile(np.array(START_WEIGHTS), (GATES, 1))
    for g in range(GATES):
        bend = np.zeros((CONTEXTS, CONTEXTS))
        for n, (a, b) in enumerate(_PAIRS):
            bend[a, b] = bend[b, a] = by_gate[CONTEXTS + n, g]
        step = np.linalg.solve(bend + RIDGE * np.eye(CONTEXTS), by_gate[:CONTEXTS, g])
        weights[g] += step / max(1.0, float(np.linalg.norm(step)))
    return weights


def fit(words: DataFrame) -> Mixer:
    """words: word, n of all training words. The driver gets BASES[-1] counts, compressed, and a few numbers for each gate and node."""
    spark = words.sparkSession
    kind = "block int, n binary, ones binary"
    counted = words.mapInArrow(_count_slots, kind).repartition("block").sortWithinPartitions("block").mapInArrow(_sum_blocks, kind)
    tables = Tables(np.zeros(int(BASES[-1]), np.float32), np.zeros(int(BASES[-1]), np.float32))
    for number, n, ones in counted.collect():
        at = slice(number * BLOCK, (number + 1) * BLOCK)
        tables.n[at], tables.ones[at] = _unpacked(n), _unpacked(ones)
    shared = spark.sparkContext.broadcast(tables)

    def learn(batches):
        yield from _moments(shared.value)(batches)

    got = words.mapInArrow(learn, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    shared.destroy()
    flat = np.zeros((CONTEXTS + len(_PAIRS)) * GATES + 2 * NODES * LEVELS)
    flat[got["place"]] = got["value"]
    by_gate, (hits, met) = flat[: -2 * NODES * LEVELS].reshape(-1, GATES), flat[-2 * NODES * LEVELS :].reshape(2, NODES, LEVELS)
    refine = (hits + 4 * _start_refine()) / (met + 4)
    return Mixer(np.minimum(tables.n, 255).astype(np.uint8), _inputs(tables.ones, tables.n).astype(np.float32), newton_weights(by_gate), refine)


class Scorer:
    """Costs of runs in a table of fixed size that is overwritten as new runs come."""

    BITS = 19

    def __init__(self, mixer: Mixer):
        self.mixer = mixer
        self.keys = np.full(1 << self.BITS, (1 << 64) - 1, dtype=U64)
        self.costs = np.zeros(1 << self.BITS)

    def costs_of(self, key: np.ndarray, run: np.ndarray, word: np.ndarray) -> np.ndarray:
        slot = (key * U64(0x9E3779B97F4A7C15) >> U64(64 - self.BITS)).astype(np.int64)
        cost = self.costs[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            _, first, back = np.unique(key[miss], return_index=True, return_inverse=True)
            fresh = miss[first]
            own = np.concatenate([self.mixer.bits(run[fresh[i : i + BATCH]], word[fresh[i : i + BATCH]]) for i in range(0, len(fresh), BATCH)])
            cost[miss] = own[back]
            self.keys[slot[fresh]], self.costs[slot[fresh]] = key[fresh], own
        return cost

    def spelled(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each word of buf with its END."""
        if len(bounds) < 2:
            return np.zeros(0)
        cost = self.costs_of(*runs_of(buf, bounds))
        return np.add.reduceat(cost, bounds[:-1] + np.arange(len(bounds) - 1))


_scorers: dict[int, Scorer] = {}


# ---------------------------------------------------------------- documents


def held_out():
    return crc32_of_id() % 7 == 2


def _gathered(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of some words end to end, bounds)."""
    sizes = ends - starts
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    return low[np.repeat(starts - bounds[:-1], sizes) + np.arange(bounds[-1])], bounds


def _strings(buf: np.ndarray, bounds: np.ndarray):
    import pyarrow as pa

    return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)))


def _white(buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each text has each byte of WHITE."""
    at = [np.concatenate([[0], np.cumsum(buf == ord(c))]) for c in WHITE]
    return np.stack([a[bounds[1:]] - a[bounds[:-1]] for a in at], axis=1)


def _word_counts(batches):
    """(word, n) of a partition's words, repeated at times, and of its white space bytes, which no word is."""
    import pyarrow as pa

    white = np.zeros(len(WHITE), np.int64)
    for batch in batches:
        for _, buf, bounds in text_chunks(batch.column(0), 1 << 20):
            h, starts, ends, _ = word_spans(buf, bounds)
            _, n, starts, ends = _distinct(h, starts, ends)
            white += _white(buf, bounds).sum(axis=0)
            yield pa.RecordBatch.from_arrays([_strings(*_gathered(_LOWER[buf], starts, ends)), pa.array(n)], ["word", "n"])
    some = np.flatnonzero(white)
    yield pa.RecordBatch.from_arrays([pa.array([WHITE[k] for k in some], pa.string()), pa.array(white[some])], ["word", "n"])


def _hot_threshold(counts: DataFrame, most: int) -> int:
    """The least count with at most `most` words at or above it, by a histogram over powers of 2 ** (1 / 8)."""
    bucket = F.floor(F.log2("n") * 8)
    held, least = 0, 0
    for b, n in sorted(((r[0], r[1]) for r in counts.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        held += n
        if held > most:
            return int(np.ceil(2 ** ((b + 1) / 8) - 1e-9))
        least = b
    return int(np.floor(2 ** (least / 8)))


def _scorer(mixer) -> Scorer:
    key = id(mixer.value)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(mixer.value)
    return _scorers[key]


def _spell(mixer) -> Callable:
    """word, n, bits of the rows of the table of words."""

    def run(batches):
        import pyarrow as pa

        scorer = _scorer(mixer)
        for batch in batches:
            bits = [scorer.spelled(buf, bounds) for _, buf, bounds in text_chunks(batch.column(0), CHUNK)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(bits) if bits else np.zeros(0))], ["word", "n", "bits"])

    return run


@dataclass
class Shares:
    """log2 of what is the same for all words: a word comes, none does, each byte of WHITE and the end follow; weights: (log2 of the whole word's
    weight by its count's share of one, of the spelling's) of each of MIXES."""

    some: float
    none: float
    after: np.ndarray
    weights: list[tuple[float, float]]


def shares_of(white: np.ndarray, n_docs: int, words: int, once: int) -> Shares:
    """white: counts of WHITE; words: training words; once: those met once, which tell how often a word is new."""
    segments = int(white.sum()) + n_docs
    some = (words + 1) / (segments + 2)
    after = np.log2((np.append(white, n_docs) + 1) / (segments + len(white) + 1))
    known = min(max(1 - once / words, 0.05), 0.999) if words else 0.0
    weights = []
    for m in MIXES:
        w = 1 / (1 + ((1 - known) / known) * np.exp(-m)) if known else 0.0
        weights.append((float(np.log2(w / words)) if w else float("-inf"), float(np.log2(1 - w))))
    return Shares(float(np.log2(some)), float(np.log2(1 - some)), after, weights)


def _score(mixer, hot, shares: Shares) -> Callable:
    """Per document: its own columns, and its words that aren't hot, with how often each occurs and, in held-out texts, their bits."""

    def run(batches):
        import pyarrow as pa

        scorer = _scorer(mixer)
        words, values = hot.value
        for batch in batches:
            held = batch.column(2).to_numpy(zero_copy_only=False)
            kept: list[list] = [[], [], [], []]
            out: list[list] = [[], [], [], [], []]
            for lo, buf, bounds in text_chunks(batch.column(1), 1 << 19):
                h, starts, ends, first = word_spans(buf, bounds)
                signed = h.view(np.int64)
                at = np.minimum(np.searchsorted(words, signed), max(len(words) - 1, 0))
                known = words[at] == signed if len(words) else np.zeros(len(h), bool)
                value = np.where(known[:, None], values[at], 0.0) if len(words) else np.zeros((len(h), values.shape[1]))
                acc, seen = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(value, axis=0)]), np.concatenate([[0], np.cumsum(known)])
                n, white = first[1:] - first[:-1], _white(buf, bounds)
                empty = white.sum(axis=1) + 1 - n
                out[0].append(n + 1)
                out[1].append(seen[first[1:]] - seen[first[:-1]])
                out[2].append(acc[first[1:]] - acc[first[:-1]])
                out[3].append(n * shares.some + empty * shares.none + white @ shares.after[:-1] + shares.after[-1])
                out[4].append(np.diff(bounds) + 1)
                # Rare words: by document, then by hash.
                rare = np.flatnonzero(~known)
                doc = np.searchsorted(first, rare, side="right") - 1
                order = np.lexsort((h[rare], doc))
                rare, doc = rare[order], doc[order]
                new = np.concatenate([[True], (h[rare][1:] != h[rare][:-1]) | (doc[1:] != doc[:-1])])[: len(rare)]
                heads = np.flatnonzero(new)
                times = np.diff(np.append(heads, len(rare)))
                rare, doc = rare[heads], doc[heads]
                spelled = np.zeros(len(rare))
                own = np.flatnonzero(held[lo + doc]) if len(doc) else heads
                if len(own):
                    _, one, back = np.unique(h[rare[own]], return_index=True, return_inverse=True)
                    at = rare[own[one]]
                    spelled[own] = scorer.spelled(*_gathered(_LOWER[buf], starts[at], ends[at]))[back]
                kept[0].append(_strings(*_gathered(_LOWER[buf], starts[rare], ends[rare])))
                kept[1].append(times)
                kept[2].append(spelled)
                kept[3].append(np.bincount(doc, minlength=len(bounds) - 1))
            if not out[0]:
                continue
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(kept[3]))]).astype(np.int32))
            lists = [pa.concat_arrays(kept[0]), pa.array(np.concatenate(kept[1]).astype(np.int32)), pa.array(np.concatenate(kept[2]))]
            n, seen, sums, plain, size = (np.concatenate(x) for x in out)
            columns = [pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in sums.T), pa.array(plain), pa.array(size.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns, *(pa.ListArray.from_arrays(offsets, x) for x in lists)], SCORED_NAMES)

    return run


_MODELS = [f"model{k}" for k in range(len(MIXES))]
SCORED = "doc_id long, held_out boolean, n_tokens long, hot_known long, base double, " + "".join(f"{m} double, " for m in _MODELS) + "plain double, bytes long, words array<string>, times array<int>, bits array<double>"
SCORED_NAMES = [x.split()[0] for x in SCORED.split(", ")]


def _word_bits(n, bits, weights: tuple[float, float]):
    """log2 of a word's probability: its whole and its spelling mixed."""
    whole, spelling = F.lit(weights[0]) + F.log2(n), F.lit(weights[1]) - bits
    most = F.greatest(whole, spelling)
    return F.when(n.isNull() | F.lit(weights[0] == float("-inf")), spelling).otherwise(most + F.log2(F.pow(F.lit(2.0), whole - most) + F.pow(F.lit(2.0), spelling - most)))


def score_documents(docs: DataFrame, is_held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (of the text's bytes and its end). Learns from the rows
    that is_held_out leaves."""
    spark = docs.sparkSession
    training = docs.where(~is_held_out).select(F.col(text_col))
    n_docs = training.count()
    met = staged(training.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    space = {r.word: r.n for r in met.where(F.col("word").isin(list(WHITE))).collect()}
    counts = met.where(~F.col("word").isin(list(WHITE)))
    got = counts.agg(F.count("*"), F.sum("n"), F.count_if(F.col("n") == 1)).first()
    words = got[1] or 0
    distinct, total = got[0] + (n_docs > 0), words + n_docs
    denominator = np.log10(total + distinct + 1) if total + distinct else 0.0
    shares = shares_of(np.array([space.get(c, 0) for c in WHITE], np.int64), n_docs, words, got[2])
    mixer = spark.sparkContext.broadcast(fit(counts))
    known = staged(counts.mapInArrow(_spell(mixer), "word string, n long, bits double"), "spelled")
    discard(met)
    values = known.select("word", F.log10(F.col("n") + 1.0).alias("base"), *[_word_bits(F.col("n"), F.col("bits"), w).alias(m) for m, w in zip(_MODELS, shares.weights, strict=True)], "n")
    frequent = values.where(F.col("n") >= _hot_threshold(known, HOT_WORDS)).toArrow()
    hashes = _hashes(frequent.column("word"))
    order = np.argsort(hashes)
    table_of = np.stack([frequent.column(c).to_numpy()[order] for c in ("base", *_MODELS)], axis=1) if len(order) else np.zeros((0, 1 + len(MIXES)))
    hot = spark.sparkContext.broadcast((hashes[order], table_of))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), is_held_out.alias("held_out"))
    scored = staged(rows.mapInArrow(_score(mixer, hot, shares), SCORED).withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times", "bits")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"), F.col("x.bits").alias("own"))
    joined = rare.join(known, "word", "left")
    bits = F.coalesce("bits", "own")
    sums = [F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_base")]
    sums += [F.sum(F.col("times") * _word_bits(F.col("n"), bits, w)).alias(f"rare_{m}") for m, w in zip(_MODELS, shares.weights, strict=True)]
    found = joined.groupBy("row").agg(*sums)
    end_known, end_score = int(n_docs > 0), float(np.log10(n_docs + 1))
    whole = scored.drop("words", "times", "bits").join(found, "row", "left")
    models = [F.col(m) + F.coalesce(f"rare_{m}", F.lit(0.0)) + F.col("plain") for m in _MODELS]
    whole = whole.withColumn("best", F.greatest(*models))
    mean = F.col("best") + F.log2(sum(F.pow(F.lit(2.0), m - F.col("best")) for m in models) / len(models))
    return whole.withColumn("mean", mean).select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_score - F.col("n_tokens") * float(denominator)).alias("base_score"),
        (F.col("mean") * float(np.log10(2))).alias("score"),
        (-F.col("mean") / F.col("bytes")).alias("bits_per_byte"),
    )


def _hashes(column) -> np.ndarray:
    """The words' hashes as word_spans gives them."""
    parts = [word_hashes(buf, bounds)[0].view(np.int64) for _, buf, bounds in text_chunks(column)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)
