"""Marker-aware encoding with a rank file: an Arrow UDF that builds one encoder for each Python worker. The file's path is a parameter; without a
file, use the character-level columns in `tokens`."""

from __future__ import annotations

import base64
import functools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from sparkloom.functions.text import digits_apart
from sparkloom.functions.tokens import BOS, FIRST_MARKER, MARKER_IDS, MARKERS, OVERFLOW_BASE, OVERFLOW_BUCKETS

_SPLIT = re.compile("(" + "|".join(map(re.escape, MARKERS)) + ")")


@functools.lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_marked(text: str, path: str, pattern: str) -> list[int]:
    """Markers have their own ids; what lies between is encoded, and ids beyond the base vocabulary go to the overflow buckets."""
    encoder, out = _encoder(path, pattern), []
    for piece in _SPLIT.split(text):
        if piece in MARKER_IDS:
            out.append(MARKER_IDS[piece])
        elif piece:
            out += [i if i < OVERFLOW_BASE else OVERFLOW_BASE + i % OVERFLOW_BUCKETS for i in encoder.encode_ordinary(piece)]
    return out


def decode_marked(ids: list[int], path: str, pattern: str) -> str:
    """Lossy, as overflow ids stand for several."""
    encoder, names = _encoder(path, pattern), {v: k for k, v in MARKER_IDS.items()}
    out, held = [], []
    for i in [*ids, FIRST_MARKER]:
        if i >= FIRST_MARKER:
            out.append(encoder.decode(held))
            held = []
            out.append(names[i])
        else:
            held.append(i if i < OVERFLOW_BASE else i % OVERFLOW_BUCKETS)
    return "".join(out[:-1])


def encode_bpe(text: Column, path: str, pattern: str, digit_split: bool = False, bos: bool = False) -> Column:
    """array<int>; null stays null."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        # Four bytes an id, as a batch's lists of Python numbers take ten times as much.
        ids, sizes = array("i"), [0]
        for t in texts:
            if t.is_valid:
                ids.extend(encode_marked(t.as_py(), path, pattern))
            sizes.append(len(ids))
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(ids, np.int32)), mask=texts.is_null())

    ids = encoded(digits_apart(text) if digit_split else text)
    return F.concat(F.array(F.lit(BOS)), ids) if bos else ids
