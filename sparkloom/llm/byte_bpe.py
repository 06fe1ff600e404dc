"""Byte-level BPE by rank files: encoding with Spark's higher-order functions over distinct words, and decoding.

1. Each partition's texts are split into matches of the file's pattern. A row carries its text as numbers of space-separated pieces, the
   pieces and matches its partition has not met before, and those matches as arrays of byte ids with the rank of each pair of neighbours (or
   the one id of a match that is itself an entry). Two bytes that are sure to merge, whatever else does, are one id from the start.
2. Spark folds the ranked merges over those arrays. The rank map is a literal: an array with two places for every pair of ids (cuckoo
   hashing), so a look-up is two element accesses. The state keeps the rank of every adjacent pair; a merge looks up two.
3. The rows go on in the same task, which lays the ids of the pieces end to end. Decoding concatenates the entries' bytes, as hexadecimal
   digits in one array_join over the ids.

Nothing is shuffled: words are distinct within a partition. So that partitions don't all fold the same frequent words, those of a sample of
the texts (HOT at most, a cache that changes no result) are folded first and sent to all. Both sides start over after EPOCH new pieces, so
memory is bounded. The fold copies a word's array at each merge; words of more than LONG bytes are merged by a heap instead.

Defined cases: null text counts as empty: no ids; rows that repeat are encoded each by itself; an empty table gives no row; columns besides
id and text are left out; every text decodes to its own UTF-8 bytes; a file with ids of BITS bits or more, or without some byte, is refused.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from array import array
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import _BEFORE_WORD, _TAIL, let, table

EPOCH = 400_000
HOT = 200_000  # words of the cache: some 40 MB in a worker
HOT_DOCS = 16_384  # documents, about, whose words fill it
LONG = 256
ROWS = 256  # rows that a worker holds in all forms at a time
BITS = 20
MASK = (1 << BITS) - 1
NO_PAIR = 1 << 41  # above any rank
_A, _B = 40503, 30011  # odd multipliers of the two places


@functools.lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values()) > MASK or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError(f"{path}: ids need {BITS} bits at most, and every byte must be an entry")
    return ranks


def merge_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """Every pair of entries that together are an entry."""
    return {(ranks[t[:k]], ranks[t[k:]]): r for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}


def _places(a: int, b: int, size: int) -> tuple[int, int]:
    return (a * _A + b) % size, (a + b * _B) % size + size


def cuckoo_table(pairs: dict[tuple[int, int], int]) -> tuple[np.ndarray, int]:
    """(array of (a << 2 * BITS | b << BITS | id) or -1, size): pair (a, b) is at one of its two places, one in each half of the array."""
    size = 1 << max(4, (2 * len(pairs)).bit_length())
    size -= 1  # odd, so that multiples spread
    while True:
        slots = np.full(2 * size, -1, dtype=np.int64)
        if all(_insert(slots, size, (a << 2 * BITS) | (b << BITS) | r) for (a, b), r in pairs.items()):
            return slots, size
        size = size * 5 // 4 | 1


def _insert(slots: np.ndarray, size: int, entry: int) -> bool:
    at = _places(entry >> 2 * BITS, (entry >> BITS) & MASK, size)[0]
    for _ in range(500):
        entry, slots[at] = int(slots[at]), entry
        if entry < 0:
            return True
        one, two = _places(entry >> 2 * BITS, (entry >> BITS) & MASK, size)
        at = two if at == one else one
    return False


def literal_map(path: str) -> tuple[Column, int]:
    slots, size = cuckoo_table(merge_pairs(load_ranks(path)))
    return F.split(F.lit(",".join(map(str, slots.tolist()))), ",").cast("array<bigint>"), size


def _linked(t: Column, size: int, a: Column, b: Column) -> Column:
    """Id a with the rank of the pair (a, b) above it: rank << BITS | a."""
    key = F.shiftleft(a, BITS) + b
    one, two = F.get(t, ((a * _A + b) % size).cast("int")), F.get(t, ((a + b * _B) % size + size).cast("int"))
    above = lambda x: F.shiftleft(x.bitwiseAND(F.lit(MASK).cast("bigint")), BITS) + a
    return F.when(F.shiftright(one, BITS) == key, above(one)).when(F.shiftright(two, BITS) == key, above(two)).otherwise(a + NO_PAIR)


def fold_merges(words: Column, ranks: Column, size: int) -> Column:
    """words: array<array<bigint>>, each id with the rank of its pair to the right above it (NO_PAIR for none); ranks: the literal map. The pair of
    least rank merges first, the leftmost of equals, until none merges. The least element names the next merge: its rank is the merged id."""
    id_of = lambda x: x.bitwiseAND(F.lit(MASK).cast("bigint"))

    def merged(t: Column, start: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            # Values that are used more than once are bound: what a lambda refers to is evaluated at each place.
            def at(m: Column, p: Column) -> Column:
                n = F.size(acc)
                right = F.when(p + 1 < n, let(id_of(F.get(acc, p + 1)), lambda b: _linked(t, size, m, b))).otherwise(m + NO_PAIR)
                left = let(id_of(F.get(acc, p - 2)), lambda a: _linked(t, size, a, m))
                new = F.when(p > 1, F.array(left, right)).otherwise(F.array(right))
                return F.concat(F.slice(acc, F.lit(1), F.greatest(p - 2, F.lit(0))), new, F.slice(acc, p + 2, n))

            # m: the least element, by which array_position finds its place.
            def merge(m: Column) -> Column:
                return F.when(m >= NO_PAIR, acc).otherwise(let(F.array_position(acc, m).cast("int"), lambda p: at(F.shiftright(m, BITS), p)))

            return let(F.array_min(acc), merge)

        return F.transform(F.when(F.size(start) < 2, start).otherwise(F.aggregate(F.sequence(F.lit(2), F.size(start)), start, step)), id_of)

    return let(ranks, lambda t: F.transform(words, lambda w: merged(t, w)))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap of pairs, in time n log n."""
    parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i, word[i : i + 2]) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, whole = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[i] + parts[j] != whole:
            continue
        parts[i], parts[j], after[i] = whole, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < len(parts) and (r := ranks.get(parts[a] + parts[after[a]])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[after[a]]))
    return [ranks[p] for p in parts if p is not None]


def _matcher(pattern: str) -> Callable[[str], list[str]]:
    import regex

    return regex.compile(pattern).findall


def _slices(batches):
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS):
            yield batch.slice(low, ROWS)


class _Starts:
    """Words as the fold takes them: ids of bytes with pairs' ranks above, end to end."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        short = sorted((len(t) << 32 | int.from_bytes(t), r) for t, r in self.ranks.items() if len(t) <= 4)
        self.keys, self.of_key = (np.array(c, dtype=np.int64) for c in zip(*short, strict=True))
        self.begin, self.end, self.sure = (np.full(1 << 16, NO_PAIR, dtype=np.int64) for _ in range(3))
        pairs, longer = np.full(1 << 16, -1, dtype=np.int64), np.full(1 << 16, NO_PAIR, dtype=np.int64)
        for t, r in self.ranks.items():
            if len(t) > 1:
                head, tail = t[0] << 8 | t[1], t[-2] << 8 | t[-1]
                self.begin[head], self.end[tail] = min(self.begin[head], r), min(self.end[tail], r)
                if len(t) == 2:
                    pairs[head] = r
                else:
                    longer[head], longer[tail] = min(longer[head], r), min(longer[tail], r)
        # The rank of a pair of bytes that is below all entries that begin or end with it.
        some = (pairs >= 0) & (pairs < longer)
        self.sure[some] = pairs[some]

    def _paired(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of bytes, or of pairs of bytes that are sure to merge, each with its pair's rank above it; how many each word has).

        A pair xy between bytes a and b merges whatever else does where no entry of a lower rank ends with ax or begins with yb, as only those could take x or y
        before; no other merge comes earlier or later for it where entries that begin or end with xy have higher ranks."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        wide = data.astype(np.int64)
        ends = np.cumsum(sizes)
        pair = np.full(len(wide), -1, dtype=np.int64)  # of a byte and the next one of its word
        pair[:-1] = wide[:-1] << 8 | wide[1:]
        pair[ends[sizes > 0] - 1] = -1
        inner = pair >= 0
        rank, begin, end = (np.where(inner, t[pair], NO_PAIR) for t in (self.sure, self.begin, self.end))
        left, right = np.full(len(wide), NO_PAIR), np.full(len(wide), NO_PAIR)
        left[1:], right[:-1] = end[:-1], begin[1:]
        merged = (rank < NO_PAIR) & (rank < left) & (rank < right)
        first = np.ones(len(wide), dtype=bool)
        first[1:] = ~merged[:-1]
        at = np.flatnonzero(first)
        two = merged[at]
        value, length = np.where(two, pair[at], wide[at]), 1 + two
        ids = self._ranks_of(length << 32 | value)
        linked = np.full(len(at), -1, dtype=np.int64)
        whole = length[:-1] + length[1:]
        linked[:-1] = self._ranks_of(whole << 32 | value[:-1] << 8 * length[1:] | value[1:])
        counts = np.searchsorted(at, ends) - np.searchsorted(at, ends - sizes)
        linked[np.cumsum(counts)[sizes > 0] - 1] = -1
        return np.where(linked >= 0, linked << BITS, NO_PAIR) + ids, counts

    def _ranks_of(self, key: np.ndarray) -> np.ndarray:
        """Ranks of entries of four bytes at most, by length and bytes; -1 for none."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.of_key[at], -1)

    def arrays(self, words: list[bytes]):
        """A ListArray of one array a word."""
        import pyarrow as pa

        ranks = self.ranks
        whole = [ranks.get(w) for w in words]
        for k, w in enumerate(words):
            if len(w) > LONG and whole[k] is None:
                whole[k] = merge_long(w, ranks)
        plain = [w for w, x in zip(words, whole, strict=True) if x is None]
        state, lengths = self._paired(np.frombuffer(b"".join(plain), np.uint8), np.array([len(w) for w in plain], dtype=np.int64))
        folded_words = np.array([x is None for x in whole], dtype=bool)
        sizes = np.array([1 if x is None or isinstance(x, int) else len(x) for x in whole], dtype=np.int64)
        sizes[folded_words] = lengths
        ends = np.cumsum(sizes)
        folded = np.repeat(folded_words, sizes)
        out = np.empty(len(folded), dtype=np.int64)
        out[folded] = state
        given = [i for x in whole if x is not None for i in ((x,) if isinstance(x, int) else x)]
        out[~folded] = np.array(given, dtype=np.int64) | NO_PAIR
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(out))


class _Pieces(dict):
    """Numbers of pieces. New ones are listed with the numbers of their matches, new matches with their text."""

    def __init__(self, matches: Callable, hot: dict[str, int], lead: str):
        super().__init__()
        self.matches, self.hot, self.lead = matches, hot, lead

    def start(self, words: dict[str, int], fresh: list[str], flat: array, ends: array) -> None:
        """words: numbers of matches besides the hot ones; fresh: where new matches are listed; flat, ends: the matches of all pieces, and
        where each piece's end."""
        self.clear()
        self.words, self.fresh, self.flat, self.ends = words, fresh, flat, ends

    def __missing__(self, piece: str) -> int:
        whole = self.lead + piece
        if piece.isalpha():
            matches = (whole,)
        elif piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            matches = (whole[:-1], piece[-1])
        else:
            matches = self.matches(whole)
        for match in matches:
            n = self.hot.get(match)
            if n is None:
                n = self.words.get(match)
                if n is None:
                    n = self.words[match] = len(self.hot) + len(self.words)
                    self.fresh.append(match)
            self.flat.append(n)
        n = self[piece] = len(self.ends)
        self.ends.append(len(self.flat))
        return n


MET = "doc_id long, epoch int, numbers binary, matches binary, ends binary, words array<array<bigint>>"


def _meet(path: str, pattern: str, hot) -> Callable:
    """Rows as numbers of pieces, with what is new to their partition: the matches of pieces, where each piece's end, and the matches."""

    def run(batches):
        import pyarrow as pa

        starts, matches = _Starts(path), _matcher(pattern)
        known = {w: k for k, w in enumerate(hot.value[0])}
        first, rest = _Pieces(matches, known, ""), _Pieces(matches, known, " ")
        epoch, at, done, told = -1, 0, EPOCH, 0
        for batch in _slices(batches):
            out: list[list] = [[], [], [], []]
            word_ends, met, fresh_from = [0], [], 0
            for text in batch.column(1):
                text = text.as_py()
                if epoch < 0 or len(ends) >= EPOCH:
                    epoch, at, done, told = epoch + 1, 0, 0, 0
                    flat, ends, fresh = array("i"), array("i"), []
                    words: dict[str, int] = {}
                    for p in (first, rest):
                        p.start(words, fresh, flat, ends)
                if not text:
                    numbers = b""
                elif _TAIL.search(text):
                    numbers = array("I", map(first.__getitem__, _BEFORE_WORD.split(text))).tobytes()
                else:
                    head, *others = text.split(" ")
                    numbers = array("I", [first[head], *map(rest.__getitem__, others)]).tobytes()
                for column, value in zip(out, (epoch, numbers, flat[at:].tobytes(), ends[done:].tobytes()), strict=True):
                    column.append(value)
                met += fresh[told:]
                at, done, told = len(flat), len(ends), len(fresh)
                word_ends.append(len(met))
            if epoch >= 0:
                fresh.clear()
                told = 0
            new = pa.ListArray.from_arrays(pa.array(np.array(word_ends, dtype=np.int32)), starts.arrays([w.encode() for w in met]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:]), new], ["doc_id", "epoch", "numbers", "matches", "ends", "words"])

    return run


def _lay(hot) -> Callable:
    """The partition's rows in the same order, their new matches encoded: lays every text's ids end to end."""

    def run(batches):
        import pyarrow as pa

        epoch, at, of_match, of_piece = -1, 0, [], []
        for batch in _slices(batches):
            coded = batch.column(5).flatten()
            offsets = (coded.offsets.to_numpy() - coded.offsets[0].as_py()) * 4 if len(coded) else np.zeros(1, np.int64)
            cuts, data = offsets.tolist(), coded.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            fresh = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            word_ends = batch.column(5).offsets.to_numpy()
            word_ends = (word_ends - word_ends[0]).tolist()
            out = []
            for k, (e, numbers, matches, ends) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                if e != epoch:
                    epoch, at, of_match, of_piece = e, 0, list(hot.value[1]), []
                of_match += fresh[word_ends[k] : word_ends[k + 1]]
                own, low = array("i", matches), at
                for end in array("i", ends):
                    of_piece.append(of_match[own[at - low]] if end == at + 1 else b"".join([of_match[m] for m in own[at - low : end - low]]))
                    at = end
                out.append(b"".join(map(of_piece.__getitem__, array("I", numbers))))
            sizes = np.concatenate([[0], np.cumsum([len(c) // 4 for c in out])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(out), "<i4")))
            digests = [hashlib.sha256(c).hexdigest() for c in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(digests, pa.string())], ["doc_id", "ids", "ids_sha256"])

    return run


def _hot_words(texts: DataFrame, path: str, pattern: str, ranks: Column, size: int) -> tuple[list[str], list[bytes]]:
    """Words that a sample of the texts holds more than once, HOT at most, and their ids. What is found here is only saved work."""

    def count(batches):
        import pyarrow as pa

        matches, found = _matcher(pattern), Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(matches(text.as_py() or ""))
        for k in range(0, len(found), 1 << 16):
            part = list(found.items())[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    def begin(batches):
        import pyarrow as pa

        starts = _Starts(path)
        for batch in batches:
            words = starts.arrays([w.encode() for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), words], ["word", "start"])

    rows = texts.count()
    if not rows or not HOT:
        return [], []
    sample = texts if rows <= HOT_DOCS else texts.sample(HOT_DOCS / rows, 7)
    counts = sample.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n > 1 and octet_length(word) <= {LONG}")
    most = counts.orderBy(F.desc("n"), "word").limit(HOT).select("word")
    spread = most.repartition(max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "word")
    got = spread.mapInArrow(begin, "word string, start array<bigint>").select("word", fold_merges(F.array("start"), ranks, size)[0].alias("ids")).toArrow()
    return got.column("word").to_pylist(), [np.array(x, "<u4").tobytes() for x in got.column("ids").to_pylist()]


def _coded(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids, ids_sha256."""
    ranks, size = literal_map(path)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hot = docs.sparkSession.sparkContext.broadcast(_hot_words(rows.select("text"), path, pattern, ranks, size))
    met = rows.mapInArrow(_meet(path, pattern, hot), MET)
    folded = met.select("doc_id", "epoch", "numbers", "matches", "ends", fold_merges(F.col("words"), ranks, size).alias("words"))
    return folded.mapInArrow(_lay(hot), "doc_id long, ids array<int>, ids_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""
    return _coded(docs, path, pattern, id_col, text_col).select("doc_id", "ids")


def decoded(ids: Column, path: str) -> Column:
    """The entries' bytes, concatenated, as binary; null ids give no bytes. An id that the file doesn't have is an error."""
    entries = {r: t.hex() for t, r in load_ranks(path).items()}
    pieces = F.split(F.lit(",".join(entries.get(k, "") for k in range(max(entries) + 1))), ",")
    whole = F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), lambda i: pieces[i]), "")
    return F.unhex(whole)


def decode_ids(coded: DataFrame, path: str) -> DataFrame:
    """doc_id, text (binary) from doc_id, ids."""
    return coded.select("doc_id", decoded(F.col("ids"), path).alias("text"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = _coded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, "doc_id", "text")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2(decoded(F.col("ids"), path), 256).alias("decoded_sha256"))
