"""Language of texts and of their parts: script ranges, word scores, and a Viterbi path with a price for switching.

A word's score in a language is the sum over its byte trigrams (with marks at both ends) of their log share in that language. The
script of a word, by ranges of code points, leaves only languages that use it. The path that maximises scores less the price of each
switch labels every word, so a text of several languages falls into spans; the text gets the language with most bytes of words.

Fitting: trigram counts of at most SAMPLE_PER_LANGUAGE whole texts a language, those with the smallest hash of their id. That is
the one bound; scoring takes whole texts, all of them. The model is one table of TABLE entries a language.

Defined cases: null text or no letter: `und` with score 0; an empty table, or no labelled text: `und` for all; ties go to the language
first by name; rows that repeat are labelled each by itself; columns besides those named are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import _LOWER, PieceEncoder, crc32_of_id, row_slices, table, text_chunks

SAMPLE_PER_LANGUAGE = 3000
SALTS = 61
ROWS = 2048  # rows that a worker takes at a time
TABLE = 1 << 16
SWITCH = 12.0
MIN_SCRIPT_SHARE = 0.01
UNKNOWN = "und"

# Code point ranges of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
SCRIPT_NAMES = list(SCRIPTS)


def _script_ranges() -> tuple[np.ndarray, np.ndarray]:
    """Sorted range starts with the script from there on (0: none)."""
    marks = sorted(x for k, name in enumerate(SCRIPT_NAMES) for a, b in SCRIPTS[name] for x in ((a, k + 1), (b + 1, 0)))
    at: dict[int, int] = {0: 0}
    for place, k in marks:
        if k or place not in at:
            at[place] = k
    return np.array(sorted(at), dtype=np.int64), np.array([at[p] for p in sorted(at)], dtype=np.int8)


_STARTS, _KINDS = _script_ranges()


def words_of(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text). A word is a run of letters, marks and bytes above ASCII."""
    low = _LOWER[buf]
    inside = ((low >= 97) & (low <= 122)) | (low >= 128)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    b = bounds[:-1][bounds[:-1] < len(buf)]
    first[b] = inside[b]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    c = bounds[1:][bounds[1:] > 0] - 1
    last[c] = inside[c]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, bounds)


def trigram_slots(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the trigrams centred on each byte of words (a space outside the word), and where each word's slots start."""
    n = len(low)
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[starts] += 1
    np.add.at(inside, ends, -1)
    places = np.flatnonzero(np.cumsum(inside[:-1]))
    left = np.empty(n, dtype=np.uint32)
    left[1:] = low[:-1]
    right = np.empty(n, dtype=np.uint32)
    right[:-1] = low[1:]
    left[starts], right[ends - 1] = 32, 32
    key = (left[places] << np.uint32(16)) | (low[places].astype(np.uint32) << np.uint32(8)) | right[places]
    slots = (key * np.uint32(0x9E3779B1)) >> np.uint32(16)
    sizes = ends - starts
    return slots, np.concatenate([[0], np.cumsum(sizes)])


def word_scripts(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Script of each word's first letter: 0 none, else 1 + its place in SCRIPT_NAMES."""
    if not len(starts):
        return np.zeros(0, np.int8)
    lead = low[starts].astype(np.int64)
    out = np.where(lead < 128, SCRIPT_NAMES.index("latin") + 1, 0).astype(np.int8)
    odd = np.flatnonzero(lead >= 0xC0)
    if len(odd):
        at, n = starts[odd], len(low)
        b = [low[np.minimum(at + k, n - 1)].astype(np.int64) & 0x3F for k in range(4)]
        first = low[at].astype(np.int64)
        point = np.where(first < 0xE0, (first & 0x1F) << 6 | b[1], np.where(first < 0xF0, (first & 0x0F) << 12 | b[1] << 6 | b[2], (first & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3]))
        out[odd] = _KINDS[np.searchsorted(_STARTS, point, side="right") - 1]
    return out


@dataclass
class Model:
    """languages by name; weights: log shares, one row a slot; uses: which scripts (column) a language (row) uses."""

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray


def _count(batches):
    import pyarrow as pa

    PieceEncoder.release()
    for batch in batches:
        langs = batch.column(1).to_pylist()
        tallies: dict[str, np.ndarray] = {}
        for lo, buf, bounds in text_chunks(batch.column(0), 1 << 19):
            low, starts, ends, first = words_of(buf, bounds)
            slots, offsets = trigram_slots(low, starts, ends)
            kinds = word_scripts(low, starts, ends)
            for i in range(len(bounds) - 1):
                tally = tallies.setdefault(langs[lo + i], np.zeros(TABLE + 32, np.int64))
                a, b = first[i], first[i + 1]
                tally[:TABLE] += np.bincount(slots[offsets[a] : offsets[b]], minlength=TABLE)
                tally[TABLE:] += np.bincount(kinds[a:b], minlength=32)
        for lang, tally in tallies.items():
            there = np.flatnonzero(tally)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there.astype(np.int32)), pa.array(tally[there])], ["lang", "slot", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Counts are summed by Spark; what reaches the driver has at most TABLE + 32 rows a language."""
    by = [F.xxhash64(order_col), F.col(order_col)]
    # A language may hold a third of all rows: first by language and salt, then among what is left of each salt.
    keys = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(order_col, lang_col).withColumn("_salt", F.pmod(F.xxhash64(order_col, F.lit(1)), F.lit(SALTS)))
    for group in ([lang_col, "_salt"], [lang_col]):
        keys = keys.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*by))).where(F.col("_rank") <= per_language).drop("_rank")
    keys = keys.select(order_col).distinct()
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).join(keys, order_col, "left_semi").select(F.col(text_col), F.col(lang_col))
    sums = rows.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(sums["lang"]))
    counts = np.zeros((len(languages), TABLE + 32))
    for k, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        counts[k, own["slot"].to_numpy()] = own["n"].to_numpy()
    grams, scripts = counts[:, :TABLE] + 0.5, counts[:, TABLE:]
    weights = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    uses = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1) >= MIN_SCRIPT_SHARE
    return Model(languages, np.ascontiguousarray(weights), uses)


def word_scores(model: Model, low, starts, ends) -> np.ndarray:
    """One row a word, one column a language; languages that don't use the word's script are put far below the rest."""
    slots, offsets = trigram_slots(low, starts, ends)
    acc = np.zeros((len(slots) + 1, len(model.languages)), dtype=np.float64)
    np.cumsum(model.weights[slots], axis=0, out=acc[1:])
    scores = acc[offsets[1:]] - acc[offsets[:-1]]
    able = model.uses.T[word_scripts(low, starts, ends)]
    return np.where(able | ~able.any(axis=1, keepdims=True), scores, scores - 1e3)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every word; first: index of each text's first word, and the end. All texts advance a word at a time together,
    longest first, so a step is a few vector operations."""
    n, languages = scores.shape
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    labels = np.zeros(n, dtype=np.int16)
    if not len(order):
        return labels
    heads, lengths = first[:-1][order], sizes[order]
    best_before = np.zeros(n, dtype=np.int16)
    kept = np.zeros((n, languages), dtype=bool)
    state = scores[heads].copy()
    longest = int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    for t in range(1, longest):
        m = live[t]
        now = state[:m]
        top = now.argmax(axis=1)
        high = now[np.arange(m), top][:, None] - switch
        words = heads[:m] + t
        best_before[words] = top
        kept[words] = now >= high
        state[:m] = np.maximum(now, high) + scores[words]
    label = state.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        m = live[t]
        words = heads[:m] + t
        labels[words] = label[:m]
        if t:
            own = label[:m]
            label[:m] = np.where(kept[words, own], own, best_before[words])
    return labels


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def label_batch(model: Model, column) -> tuple[list[str], list[float], list[list[tuple[int, int, int]]]]:
    """For each text of an Arrow column: language, score, and its labelled runs (first byte, end, language)."""
    n_lang = len(model.languages)
    langs, scores = [UNKNOWN] * len(column), [0.0] * len(column)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    if not n_lang:
        return langs, scores, runs
    for lo, buf, bounds in text_chunks(column, 1 << 19):
        low, starts, ends, first = words_of(buf, bounds)
        if not len(starts):
            continue
        labels = viterbi(word_scores(model, low, starts, ends), first)
        sizes = ends - starts
        turn = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
        for i in range(len(bounds) - 1):
            a, b = first[i], first[i + 1]
            if a == b or not _has_letter(bytes(buf[bounds[i] : bounds[i + 1]]).decode("utf-8", "replace")):
                continue
            share = np.bincount(labels[a:b], weights=sizes[a:b], minlength=n_lang)
            best = int(share.argmax())
            langs[lo + i], scores[lo + i] = model.languages[best], float(share[best] / share.sum())
            cuts = [a, *turn[np.searchsorted(turn, a, side="right") : np.searchsorted(turn, b)], b]
            runs[lo + i] = [(int(starts[x] - bounds[i]), int(ends[y - 1] - bounds[i]), int(labels[x])) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
    return langs, scores, runs


def _label(model: Model) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            langs, scores, runs = label_batch(model, batch.column(1))
            spans = [",".join(f"{model.languages[k]}:{a}:{b}" for a, b, k in r) if len(r) > 1 else "" for r in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, pa.string())], ["doc_id", "lang_pred", "score", "mixed_spans"])

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (share of word bytes in that language), mixed_spans (lang:first byte:end where several are found)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(_label(model), "doc_id long, lang_pred string, score double, mixed_spans string")


def held_out() -> Column:
    return crc32_of_id() % 4 == 2


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a language; whole rows pass, rejected ones (no letter, null) go."""
    at, schema = docs.columns.index(text_col), docs.schema

    def run(batches):
        import pyarrow as pa

        PieceEncoder.release()
        for batch in row_slices(batches, ROWS):
            langs, _, _ = label_batch(model, batch.column(at))
            yield batch.filter(pa.array([x != UNKNOWN for x in langs]))

    return docs.mapInArrow(run, schema)


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out()).select("doc_id", "text", "lang"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixed_spans")
