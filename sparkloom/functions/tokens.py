"""Token ids: markers, the character-level tokenizer, overflow ids, shifts."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from sparkloom.functions.text import digits_together, stripped

# The vocabulary and its markers, which have the top ids in this order.
VOCABULARY = 32768
MARKERS = ("<NUM>", "<DECIMAL>", "<NEG>", "<REASON>", "</REASON>", "<ANSWER>", "</ANSWER>", "<PAD>", "<BOS>", "<EOS>")
FIRST_MARKER = VOCABULARY - len(MARKERS)
OVERFLOW_BUCKETS = 64
OVERFLOW_BASE = FIRST_MARKER - OVERFLOW_BUCKETS
MARKER_IDS = {m: FIRST_MARKER + k for k, m in enumerate(MARKERS)}
PAD, BOS, EOS = (MARKER_IDS[m] for m in ("<PAD>", "<BOS>", "<EOS>"))
IGNORED = -100  # label of positions without loss

_ALTERNATIVES = "|".join(MARKERS)
_MARKER = re.compile(_ALTERNATIVES.encode())


def split_on_markers(x: Column) -> Column:
    """Markers and what lies between them, in order, without empty pieces."""
    return F.regexp_extract_all(x, F.lit(f"(?s)(?:{_ALTERNATIVES})|(?:(?!{_ALTERNATIVES}).)+"), F.lit(0))


def encode_chars(x: Column, bos: bool = False) -> Column:
    """array<int>: a marker's id, or the code of each ASCII character; 63 for others. Null stays null."""
    out = _encoded(x)
    return F.concat(F.array(F.lit(BOS)), out) if bos else out


@F.arrow_udf(ArrayType(IntegerType()))
def _encoded(x: pa.Array) -> pa.Array:
    """A batch's bytes at once: a character is its first byte. Markers, which few texts have, are put in the place of their first characters."""
    x = x.cast(pa.large_binary())
    offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1] if len(x) else np.zeros(1, np.int64)
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    ids, keep = np.where(data < 128, data, 63).astype(np.int32), (data & 0xC0) != 0x80
    raw = data.tobytes()
    for m in _MARKER.finditer(raw) if b"<" in raw else ():
        # Not one that the end of a text and the start of the next make.
        if np.searchsorted(offsets, m.start() + offsets[0], "right") == np.searchsorted(offsets, m.end() + offsets[0], "left"):
            ids[m.start()], keep[m.start() + 1 : m.end()] = MARKER_IDS[m[0].decode()], False
    until = np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(until), pa.array(ids[keep]), mask=x.is_null())


def decode_chars(ids: Column) -> Column:
    """Ids to text; unknown ids are dropped; digits come together."""
    return digits_together(_decoded(ids.cast("array<bigint>")))


@F.arrow_udf(StringType())
def _decoded(x: pa.Array) -> pa.Array:
    """A batch's ids at once, a byte each; texts with markers one by one."""
    if not len(x):
        return pa.array([], pa.string())
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)
    ids = x.values.slice(offsets[0], offsets[-1] - offsets[0]).fill_null(-1).to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    keep = (ids >= 0) & (ids < 128)
    raw, until = ids[keep].astype(np.uint8), np.concatenate([[0], np.cumsum(keep)])[offsets]
    marked = np.unique(np.searchsorted(offsets, np.flatnonzero((ids >= FIRST_MARKER) & (ids < VOCABULARY)), "right") - 1)
    if not len(marked):
        plain = pa.LargeStringArray.from_buffers(len(x), pa.py_buffer(until), pa.py_buffer(raw))
        return pc.if_else(x.is_valid(), plain, None).cast(pa.string())
    some = {int(k): "".join(chr(i) if i < 128 else MARKERS[i - FIRST_MARKER] for i in ids[offsets[k] : offsets[k + 1]].tolist() if 0 <= i < 128 or FIRST_MARKER <= i < VOCABULARY) for k in marked}
    texts = [some[k] if k in some else raw[until[k] : until[k + 1]].tobytes().decode() for k in range(len(x))]
    return pc.if_else(x.is_valid(), pa.array(texts, pa.string()), None)


def remap_overflow(ids: Column) -> Column:
    """Ids beyond the base vocabulary to one of the buckets below the markers."""
    return F.transform(ids, lambda i: F.when(i < OVERFLOW_BASE, i).otherwise(OVERFLOW_BASE + i % OVERFLOW_BUCKETS))


def next_token_pair(ids: Column) -> Column:
    """struct(inputs, labels): each input's label is the id after it."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.struct(F.slice(ids, F.lit(1), n).alias("inputs"), F.slice(ids, F.lit(2), n).alias("labels"))


def round_trips(ids: Column, n_tokens: Column) -> Column:
    return (stripped(decode_chars(ids)) != "") & (F.size(ids) == n_tokens)


def estimated_row_bytes(n_tokens: Column, source: Column) -> Column:
    return F.floor((2 * n_tokens + F.length(source) + 24) * F.lit(1.3)).cast("bigint")
