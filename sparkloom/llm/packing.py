"""Sum-of-squares packing of token ids into windows of a fixed length.

Every partition packs its own documents as they come. A document longer than a window first fills whole windows; what is left goes
to the fill level that keeps the sum of squared counts of partially filled windows least. The counts lie in one array by level, so
a placement is one vector operation whatever the number of open windows. When a partition ends, or its open windows hold more than
FLUSH_TOKENS, the pieces in open windows are laid end to end and cut into full windows, and the rest into windows whose lengths are
powers of two, which need no padding.

Defined cases: null text counts as empty and is one piece, the end id; repeated rows are packed each by itself; an empty table gives
no row; columns besides id and text are left out. sequence_id is the partition's number in the upper bits and a counter in the lower.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import PieceEncoder, table, text_groups

WINDOW = 1024
ROWS = 512  # rows that a worker holds as Python strings
FLUSH_TOKENS = 2 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Open windows by fill level. A piece is (document, start, ids as bytes, tokens of the document)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.held = 0

    def level_for(self, size: int) -> int:
        """Moving a window from level h to h + size changes the sum by 2 (N[h + size] - N[h]) + 2; opening one by 2 N[size] + 1;
        filling one by 1 - 2 N[h]. Ties go to the fullest level."""
        n, w = self.counts, self.window
        change = 2 * (n[size:w] - n[: w - size]) + 2
        if size < w:
            change[0] = 2 * n[size] + 1
        change = np.append(change, 1 - 2 * n[w - size] if size < w else 0)
        able = n[: w - size + 1] > 0
        able[0] = True
        change = np.where(able, change, np.iinfo(np.int64).max)
        return int(w - size - np.argmin(change[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Puts the piece into a window; returns the window's pieces if it's full now."""
        size = len(piece[2]) // 4
        h = self.level_for(size)
        pieces = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
            self.held -= h
        pieces.append(piece)
        if h + size == self.window:
            return pieces
        self.open[h + size].append(pieces)
        self.counts[h + size] += 1
        self.held += h + size
        return None

    def settle(self) -> Iterator[list]:
        """Cuts what open windows hold into full windows and a rest of lengths that are powers of two."""
        stream = [p for level in reversed(self.open) for pieces in level for p in pieces]
        left = sum(len(p[2]) // 4 for p in stream)
        self.__init__(self.window)
        stream.reverse()
        while left:
            room = want = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            pieces = []
            while room:
                doc, start, ids, total = stream.pop()
                n = min(room, len(ids) // 4)
                if 4 * n < len(ids):
                    stream.append((doc, start + n, ids[4 * n :], total))
                pieces.append((doc, start, ids[: 4 * n], total))
                room -= n
            left -= want
            yield pieces


def _pack(tokenizer_path: str, end_id: int, window: int, keeps_space: bool) -> Callable:
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = PieceEncoder.shared(tokenizer_path, keeps_space)
        end = np.array([end_id], "<u4").tobytes()
        packer, sequence = SumOfSquares(window), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def close(pieces):
            nonlocal sequence
            at = 0
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, sequence, at))
                at += n
            sequence += 1

        def drained():
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
            rows.clear()
            return out

        for batch in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in text_groups(texts, encoder.GROUP):
                for doc, ids in zip(docs[part], encoder.encode(texts[part]), strict=True):
                    ids += end
                    total, step = len(ids) // 4, 4 * window
                    whole = len(ids) // step * step
                    for a in range(0, whole, step):
                        close([(doc, a // 4, ids[a : a + step], total)])
                    if whole < len(ids) and (full := packer.place((doc, whole // 4, ids[whole:], total))):
                        close(full)
                    if packer.held > FLUSH_TOKENS:
                        for pieces in packer.settle():
                            close(pieces)
                    if len(rows) >= 20_000:
                        yield drained()
        for pieces in packer.settle():
            close(pieces)
        if rows:
            yield drained()

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, keeps_space: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: which ids of which document lie where in which sequence. No shuffle: a partition packs what it reads."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_pack(tokenizer_path, end_id, window, keeps_space), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def pack_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
