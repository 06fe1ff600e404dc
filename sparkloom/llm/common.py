"""What several operators of this subpackage share: tables, the shared folder, word hashes, cached encoders."""

from __future__ import annotations

import re
import string
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's spark.checkpoint.dir. Where that is unset, local mode (tests) gets a temporary one; on a
    cluster, where only the driver would have it, that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None)
    if not base:
        got = sc._jsc.sc().getCheckpointDir()
        if got.isDefined():
            base = got.get()
        elif not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            base = tempfile.mkdtemp(prefix="sparkloom-")
            sc.setCheckpointDir(base)
            base = sc._jsc.sc().getCheckpointDir().get()
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: a lineage cut that survives lost executors."""
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what staged() wrote for these, which nothing reads any more."""
    for df in frames:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def by_merge(df: DataFrame) -> DataFrame:
    """df for a join by shuffle and merge, where Spark's estimate of a side's size may be far too small for a broadcast."""
    return df.hint("merge")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value once; a plain reference inside a lambda may be inlined and evaluated per element."""
    return F.transform(F.array(value), body)[0]


def crc32_of_id(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


# ---------------------------------------------------------------- words as hashes

_POW_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_pow_cache: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow_cache.get("p")
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        inv = pow(_POW_BASE, -1, 1 << 64)
        for key, base in (("p", _POW_BASE), ("i", inv)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _pow_cache[key] = np.multiply.accumulate(a)
    return _pow_cache["p"], _pow_cache["i"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts laid end to end.

    buf: their UTF-8 bytes; bounds: where each text starts, and the end. A-Z count as a-z, words are runs of bytes other than
    space, tab, LF, VT, FF and CR. Returns the hashes, each word's first byte and its end, and for each text the index of its first word
    (with the number of words at the end).
    """
    n = len(buf)
    if n == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    low = _LOWER[buf]
    space = _SPACE[low]
    first = ~space
    first[1:] &= space[:-1]
    inner = bounds[:-1]
    inner = inner[inner < n]
    first[inner] = ~space[inner]
    starts = np.flatnonzero(first)
    last = ~space
    last[:-1] &= space[1:]
    cut = bounds[1:]
    cut = cut[cut > 0] - 1
    last[cut] = ~space[cut]
    ends = np.flatnonzero(last) + 1
    p, inv = _powers(n + 1)
    acc = np.empty(n + 1, dtype=U64)
    acc[0] = 0
    np.cumsum(_BYTE_CODE[low] * p[:n], out=acc[1:])
    h = (acc[ends] - acc[starts]) * inv[starts]
    return mix64(h + (ends - starts).astype(U64)), starts, ends, np.searchsorted(starts, bounds)


def word_hashes(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """word_spans without the ends."""
    h, starts, _, first = word_spans(buf, bounds)
    return h, starts, first


def text_chunks(column, max_bytes: int = 1 << 21):
    """Splits an Arrow string column into (first row, buf, bounds) of about max_bytes; nulls are empty texts."""
    import pyarrow as pa

    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_binary()).fill_null(b"")
    if len(arr) == 0:
        return
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1)
        hi = min(hi, len(arr))
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def row_slices(batches, rows: int):
    """Arrow batches cut to so many rows at most, so that what a worker makes of a batch is bounded."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def text_groups(texts: list[str | None], most: int):
    """Slices of texts with about `most` characters, one text at least."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield slice(low, k + 1)
            low, size = k + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


# ---------------------------------------------------------------- encoders that remember words

_TAIL = re.compile(r" (?:\s|$)")
_BEFORE_WORD = re.compile(r"(?= \S)")
_encoders: dict[tuple[str, bool], PieceEncoder] = {}
# Latin and Cyrillic letters that are tried as simple ones, ASCII marks but for the bar of special tokens, and pieces for the trial.
_LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x400, 0x530)]
_MARKS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~")
_PIECES = ["a", "It", "internationalisation", "q" * 40, "don't", "McX.", "end.\nNext", "wow!!!", "l'\u00e9t\u00e9", "IT'S", "x'Llama", "(a_b)=12.50%", "\u00c9a--\u0416\u0443\u043a\n'tis", "a'", "\"'sure"]
# A byte as byte-level files show it: itself where it prints, else the next free character from U+0100.
_PRINTS = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_SHOWN = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTS)}
_PROBE = "It's a  test, isn't\tit?\n\n  12 345.6 x--y (naïve café) — 東京 タワー 123½ ... <tag> a_b c/d É́ Straße İ ' s end "


class _Pieces(dict):
    """Ids by piece. A piece not met yet is looked up in the older dictionary, then encoded. Of pieces made of several parts only those are kept
    whose first part had been met, as one with a new word will hardly come again."""

    def __init__(self, encode: Callable[[str, str], tuple[bytes, bool | None]], lead: str, older: dict[str, bytes]):
        super().__init__()
        self.encode, self.lead, self.older = encode, lead, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids, met = self.encode(piece, self.lead)
            if met is False:
                return ids
        self[piece] = ids
        return ids

    def part(self, piece: str) -> tuple[bytes, bool]:
        """Its ids, and whether it had been met."""
        met = piece in self or piece in self.older
        return self[piece], met


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U64)


class _ShortPieces:
    """Ids of pieces of SHORT bytes at most. A piece's key is its bytes and their number, as two integers, so a match is exact; its entry
    is named in one of TRIES places from its hash on. What finds no place is encoded whenever it comes."""

    SHORT, BITS, TRIES = 15, 21, 4

    def __init__(self):
        self.places = np.zeros(1 << self.BITS, dtype=np.int32)
        # Entry 0 is no piece's.
        self.low, self.high = np.zeros(1, U64), np.full(1, (1 << 64) - 1, dtype=U64)
        self.starts, self.sizes, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4"), np.zeros(1, bool)

    def __len__(self) -> int:
        return len(self.low)

    @classmethod
    def keys(cls, buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, place) of each piece; buf has 16 bytes more than the pieces. Pieces of over SHORT bytes get the key of no piece."""
        wide = np.ndarray(len(buf) - 7, "<u8", buffer=buf, strides=(1,))
        low = wide[starts] & _LOW_BYTES[np.minimum(sizes, 8)]
        high = wide[starts + np.minimum(sizes, 8)] & _LOW_BYTES[np.clip(sizes - 8, 0, 7)] | np.minimum(sizes, cls.SHORT + 1).astype(U64) << U64(56)
        place = mix64(low ^ high * U64(0x9E3779B97F4A7C15)) >> U64(64 - cls.BITS)
        return low, high, place.astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each piece, which pieces have none)."""
        at = self.places[place]
        miss = np.flatnonzero((self.low[at] != low) | (self.high[at] != high))
        for k in range(1, self.TRIES):
            other = self.places[(place[miss] + k) & ((1 << self.BITS) - 1)]
            same = (self.low[other] == low[miss]) & (self.high[other] == high[miss])
            at[miss[same]] = other[same]
            miss = miss[~same]
        at[miss] = 0
        self.used[at] = True
        return at, miss

    def add(self, low: np.ndarray, high: np.ndarray, place: np.ndarray, short: np.ndarray, coded: list[bytes]) -> None:
        """New entries; those that aren't short get no place."""
        first, sizes = len(self), np.array([len(c) // 4 for c in coded], dtype=np.int64)
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.append(self.sizes, sizes)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(coded), "<u4"))
        self.low, self.high, self.used = np.append(self.low, low), np.append(self.high, high), np.append(self.used, np.zeros(len(low), bool))
        self._put(first + np.flatnonzero(short).astype(np.int32), place[short])

    def _put(self, entry: np.ndarray, place: np.ndarray) -> None:
        for k in range(self.TRIES):
            at = (place + k) & ((1 << self.BITS) - 1)
            free = self.places[at] == 0
            self.places[at[free]] = entry[free]
            left = self.places[at] != entry
            entry, place = entry[left], place[left]

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of entries end to end, their numbers)."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def kept(self) -> _ShortPieces:
        """A new table of the short entries that were found again since this one began."""
        out = _ShortPieces()
        some = np.flatnonzero(self.used & (self.high >> U64(56) <= U64(self.SHORT)))
        if len(some):
            ids, sizes = self.take(some)
            ends, data = np.cumsum(sizes) * 4, ids.tobytes()
            coded = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            low, high = self.low[some], self.high[some]
            place = mix64(low ^ high * U64(0x9E3779B97F4A7C15)) >> U64(64 - self.BITS)
            out.add(low, high, place.astype(np.int64), np.ones(len(some), bool), coded)
        return out


class PieceEncoder:
    """Encodes texts with a tokenizers file, remembering the ids of each space-separated piece.

    A piece of common letters, digits and marks is split as the file's pre-tokenizer would, and its words go to the file's model at once where
    the file allows that; any other piece goes through the library. A split before a space that a non-space
    follows must not fall inside a match of the file's pre-tokenizer; a file that gives a probe text other ids in pieces is refused.
    keeps_space: the piece keeps the space before it (byte-level files). Special tokens that a text spells out get their ids, as by the
    library's defaults. Values are ids as little-endian unsigned 32-bit integers. Between groups of GROUP bytes of text, a dictionary of over
    MOST pieces (a size just before its table would double) becomes the older one, which look-ups bring back and the next change drops.
    Where no piece keeps its space, a group's pieces are looked up together, by their bytes, and of over MOST_SHORT pieces those stay that came
    again since the last change.
    """

    MOST, GROUP = 330_000, 1 << 20
    MOST_SHORT = 400_000
    BLOCK = 1 << 18  # pieces that are looked up together

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.keeps_space = keeps_space
        self.id_bytes = [k.to_bytes(4, "little") for k in range(self.tok.get_vocab_size())]
        self.simple = False
        self.short = _ShortPieces()
        self._renew({}, {})
        self._find_simple()
        # Pieces as they are, and pieces by what follows their space.
        self._renew({}, {})
        if self.encode([_PROBE]) != [self._by_library(_PROBE)]:
            raise ValueError(f"{path}: a split before a word changes its ids, keeps_space={keeps_space}")

    @classmethod
    def shared(cls, path: str, keeps_space: bool) -> PieceEncoder:
        """One per Python worker, kept from task to task."""
        if (path, keeps_space) not in _encoders:
            _encoders[path, keeps_space] = cls(path, keeps_space)
        return _encoders[path, keeps_space]

    @staticmethod
    def release() -> None:
        """Forgets a worker's encoders: Spark gives its workers to other steps, which need the memory."""
        _encoders.clear()

    def _renew(self, plain: dict[str, bytes], spaced: dict[str, bytes]) -> None:
        self.plain = _Pieces(self._piece, "", plain)
        self.spaced = _Pieces(self._piece, " ", spaced) if self.keeps_space else self.plain

    def _by_library(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str, lead: str) -> bytes:
        if not self.keeps_space:
            word = word.lower()
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(_SHOWN)
        return b"".join([self.id_bytes[t.id] for t in self.tok.model.tokenize("\u0120" + shown if lead else shown)])

    def _find_simple(self) -> None:
        """Whether words go straight to the file's model, by which letters, and whether pieces split as _parts says: held against the library."""
        leads = ("", " ") if self.keeps_space else ("",)
        letters = [c for c in map(chr, _LETTERS) if c.isalpha() and all(self._by_library(f"{lead}a{c}b") == self._word(f"a{c}b", lead) for lead in leads)]
        # Pieces may be lowered before they are split, so a letter's small form must be simple too.
        self.letters = frozenset(c for c in letters if c.lower() in letters)
        some = re.escape("".join(sorted(self.letters)))
        self.whole = re.compile(f"[{some}{_MARKS}0-9]++(?:\n[{some}{_MARKS}0-9]++)*+")
        self.parts = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{some}]+|[0-9]+|[{_MARKS}]+|\n")
        self.ends = {m: self._by_library(m) for m in ".,;:!?"}
        self.simple = {*string.ascii_letters} <= self.letters
        self.simple = self.simple and all(self._piece(p, lead)[0] == self._by_library(lead + p) for p in _PIECES for lead in leads)

    def _piece(self, piece: str, lead: str) -> tuple[bytes, bool | None]:
        """Its ids, and whether the first of several parts had been met (null: there is one part)."""
        if self.simple:
            # The usual cases first, which need no patterns: an ASCII word, and one with a mark after it.
            if piece.isascii():
                if piece.isalpha():
                    return self._word(piece, lead), None
                if piece[-1:] in self.ends and (word := piece[:-1]).isalpha():
                    ids, met = (self.spaced if lead else self.plain).part(word)
                    return ids + self.ends[piece[-1]], met
            if self.keeps_space and not lead and piece[:1] == " ":
                if self.whole.fullmatch(piece, 1):
                    return self.spaced.part(piece[1:])
            elif self.whole.fullmatch(piece) and not (lead and piece[0] == "'"):
                first, *rest = self.parts.findall(piece if self.keeps_space else piece.lower())
                if rest:
                    if not self.keeps_space:
                        rest = [p for p in rest if p != "\n"]
                    ids, met = (self.spaced if lead else self.plain).part(first)
                    return ids + b"".join([self.plain[p] for p in rest]), met
                if first[0] in self.letters:
                    return self._word(first, lead), None
        return self._by_library(lead + piece), None

    def _group(self, texts: list[str]) -> list[bytes]:
        if max(len(self.plain), len(self.spaced)) > self.MOST:
            # Plain dictionaries, so that the ones before them go.
            self.plain.older = self.spaced.older = {}
            self._renew(self.plain, self.spaced)
        if not self.keeps_space:
            return self._by_bytes(texts)
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        out = []
        for t in texts:
            if _TAIL.search(t):
                out.append(b"".join(map(plain, _BEFORE_WORD.split(t))))
            else:
                head, *rest = t.split(" ")
                out.append(plain(head) + b"".join(map(spaced, rest)))
        return out

    def _by_bytes(self, texts: list[str]) -> list[bytes]:
        """The ids of texts whose pieces don't keep their space."""
        whole = [t.encode() for t in texts]
        data = b" ".join([*whole, b" " * 16])
        buf = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(buf[:-16] == 32)
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = np.cumsum([len(t) + 1 for t in whole]) - 1  # where each text's last piece ends
        flat, sizes = [], []
        for k in range(0, len(ends), self.BLOCK):
            ids, n = self._block(data, buf, starts[k : k + self.BLOCK], ends[k : k + self.BLOCK])
            flat.append(ids.tobytes())
            sizes.append(n)
        joined = b"".join(flat)
        stops = (np.cumsum(np.concatenate(sizes))[np.searchsorted(ends, last)] * 4).tolist()
        return [joined[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _block(self, data: bytes, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many each piece has)."""
        if len(self.short) > self.MOST_SHORT:
            self.short = self.short.kept()
            if len(self.short) > self.MOST_SHORT // 2:
                self.short = _ShortPieces()
        short, sizes = self.short, ends - starts
        low, high, place = short.keys(buf, starts, sizes)
        at, miss = short.find(low, high, place)
        if len(miss):
            new: dict[bytes, int] = {}
            first, coded, entries, where = len(short), [], [], []
            for i, a, b in zip(miss.tolist(), starts[miss].tolist(), ends[miss].tolist(), strict=True):
                piece = data[a:b]
                n = new.get(piece)
                if n is None:
                    n = new[piece] = first + len(coded)
                    # The usual case first: an ASCII word.
                    if self.simple and piece.isalpha():
                        coded.append(b"".join([self.id_bytes[t.id] for t in self.tok.model.tokenize(piece.lower().decode())]))
                    else:
                        coded.append(self._piece(piece.decode(), "")[0])
                    where.append(i)
                entries.append(n)
            at[miss] = entries
            short.add(low[where], high[where], place[where], sizes[where] <= short.SHORT, coded)
        return short.take(at)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; none for null."""
        return [ids for rows in text_groups(texts, self.GROUP) for ids in self._group([t or "" for t in texts[rows]])]
