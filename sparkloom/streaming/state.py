"""Streaming forms of the budget cut, of turn pairing and of packing: processors with state by key, on the RocksDB state store.

A trigger's rows of one key come in chunks, in any order, and are taken in the order of a key column: results equal the batch operators' where triggers
take rows in that order (one file a trigger, files in order); where they don't, rows that come late are judged by what was kept before them. The budget holds
no more rows than it can still keep and one chunk; the others hold a key's only chunk, or, where there are several, put rows into the state store, hold
their order keys, and read rows back one by one. Null order keys come first; a query that is started again from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparkloom.operators.dialogue import speaker

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NONE = -(1 << 63)  # stands for a null number: pandas would turn a column with one into doubles. Names don't begin with _, which its rows don't keep
AT_ONCE = 1024


def on_rocksdb(spark: SparkSession) -> None:
    """Streams that are started from now on keep their state in RocksDB, which these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _whole(name: str, to: str) -> Column:
    return F.coalesce(F.col(name).cast("bigint"), F.lit(NONE)).alias(to)


def _given(places: list[int] | np.ndarray) -> pd.Series:
    """Numbers as they were given."""
    s = pd.Series(places, dtype="Int64")
    return s.mask(s == NONE)


class _InOrder(StatefulProcessor):
    """Gives a key's rows of a trigger in order. fields: the state's columns for a row that has to wait."""

    fields = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting_rows = handle.getMapState("rows", "at bigint, n bigint", self.fields)

    def in_order(self, chunks: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        """(order key, row's fields), by key and then as they came."""
        first, second = next(chunks, None), next(chunks, None)
        names = [f.split()[0] for f in self.fields.split(", ")]
        if second is None:
            if first is not None:
                rows = first.sort_values("place", kind="stable")
                yield from zip(rows["place"].tolist(), *(rows[n].tolist() for n in names), strict=True)
            return
        places, n = [], 0
        for chunk in self._all(first, second, chunks):
            for at, *row in zip(chunk["place"].tolist(), *(chunk[c].tolist() for c in names), strict=True):
                self.waiting_rows.updateValue((at, n), tuple(row))
                places.append((at, n))
                n += 1
        for key in sorted(places):
            yield (key[0], *self.waiting_rows.getValue(key))
            self.waiting_rows.removeKey(key)

    @staticmethod
    def _all(first: pd.DataFrame, second: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield first
        yield second
        yield from rest

    def close(self) -> None:
        pass


class _Budget(StatefulProcessor):
    def __init__(self, plan: dict[str, tuple[int, int]], order: str, tokens: str):
        self.plan, self.order, self.tokens = plan, order, tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getValueState("used", "spent bigint, kept bigint")

    def handleInitialState(self, key, initial, timerValues) -> None:
        self.used.update((int(initial["spent"].iloc[0]), int(initial["kept"].iloc[0])))

    def _told(self, rows: pd.DataFrame) -> pd.DataFrame:
        sources = rows["named"].map(lambda s: s[1:] if s else None)
        return pd.DataFrame({self.order: _given(rows["place"].to_numpy()), "source": sources.to_numpy(), self.tokens: _given(rows["size"].to_numpy())})

    def handleInputRows(self, key, rows, timerValues):
        target, cap = self.plan.get(key[0][1:] if key[0] else None, (None, None))
        if target is None:
            for chunk in rows:
                yield self._told(chunk)
            return
        spent, kept = self.used.get() if self.used.exists() else (0, 0)
        held, sizes = None, None
        for chunk in rows:
            held = chunk if held is None else pd.concat([held, chunk])
            held = held.sort_values(["place", "size"], kind="stable")
            sizes = held["size"].to_numpy().clip(0)
            before = spent + np.cumsum(sizes) - sizes
            # What is beyond the budget now stays beyond it, whatever else comes.
            fits = (before < target) & (kept + np.arange(len(held)) < cap)
            held, sizes = held[fits], sizes[fits]
        if held is not None and len(held):
            self.used.update((spent + int(sizes.sum()), kept + len(held)))
            yield self._told(held)

    def close(self) -> None:
        pass


def budget_stream(df: DataFrame, plan: dict[str, tuple[int, int]], order: str = "doc_id", tokens: str = "n_tokens", initial: DataFrame | None = None) -> DataFrame:
    """order, source, tokens of the rows kept: per source (target, cap); sources without a plan pass. State is two numbers a source. initial: source, spent,
    kept of what was kept before the stream, as a batch's totals give them."""
    on_rocksdb(df.sparkSession)
    named = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("named")
    narrow = df.select(_whole(order, "place"), named, _whole(tokens, "size"))
    before = initial.select(named, F.col("spent").cast("bigint").alias("spent"), F.col("kept").cast("bigint").alias("kept")).groupBy("named") if initial is not None else None
    return narrow.groupBy("named").transformWithStateInPandas(_Budget(plan, order, tokens), f"{order} bigint, source string, {tokens} bigint", "Append", "None", before)


class _Turns(_InOrder):
    fields = "speaker string, said string"

    def __init__(self, conversation: str, turn: str, expire_ms: int | None):
        self.conversation, self.turn, self.expire_ms = conversation, turn, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.question = handle.getValueState("question", "said string")

    def _pairs(self, key, rows: list[tuple]) -> pd.DataFrame:
        at, questions, answers = zip(*rows, strict=True)
        return pd.DataFrame({self.conversation: _given([key[0]] * len(rows)), self.turn: _given(list(at)), "question": questions, "answer": answers})

    def handleInputRows(self, key, rows, timerValues):
        asked = self.question.get()[0] if self.question.exists() else None
        found = []
        for at, who, said in self.in_order(rows):
            if who == "ASSISTANT" and asked is not None:
                found.append((at, asked, said))
            asked = said if who == "USER" else None
            if len(found) == AT_ONCE:
                yield self._pairs(key, found)
                found = []
        if found:
            yield self._pairs(key, found)
        if self.expire_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if asked is None:
            self.question.clear()
        else:
            self.question.update((asked,))
            if self.expire_ms is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.expire_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.question.clear()
        yield from ()


def turn_stream(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", expire_ms: int | None = None) -> DataFrame:
    """conversation, turn, question, answer as turns come. State is the user's turn that waits for its answer; with expire_ms it is forgotten
    when it has waited so long, so that conversations which have ended leave nothing. Timers make Spark run empty batches, without end under the trigger
    availableNow unless spark.sql.streaming.noDataMicroBatches.enabled is off."""
    on_rocksdb(df.sparkSession)
    said = df.withColumn("speaker", speaker(F.col(role))).where(f"speaker is not null and coalesce({text}, '') <> ''")
    narrow = said.select(_whole(conversation, "key"), _whole(turn, "place"), "speaker", F.col(text).alias("said"))
    mode = "None" if expire_ms is None else "ProcessingTime"
    return narrow.groupBy("key").transformWithStateInPandas(_Turns(conversation, turn, expire_ms), f"{conversation} bigint, {turn} bigint, question string, answer string", "Append", mode)


class _Packing(_InOrder):
    fields = "ids binary"

    def __init__(self, length: int, end_id: int, shard: str):
        self.length, self.end_id, self.shard = length, end_id, shard

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.left = handle.getValueState("left", "number bigint, ids binary")

    def _chunks(self, key, number: int, ids: np.ndarray) -> pd.DataFrame:
        full = len(ids) // self.length
        rows = ids[: full * self.length].reshape(full, self.length)
        return pd.DataFrame({self.shard: _given([key[0]] * full), "chunk_id": np.arange(number, number + full), "input_ids": list(rows)})

    def handleInputRows(self, key, rows, timerValues):
        number, rest = self.left.get() if self.left.exists() else (0, b"")
        held, size = [bytes(rest)], len(rest) // 4
        end = np.array([self.end_id], "<i4").tobytes()
        for _, ids in self.in_order(self._as_bytes(rows)):
            held += [ids, end]
            size += len(ids) // 4 + 1
            if size >= AT_ONCE * self.length:
                number, held, size = yield from self._given_out(key, number, held)
        number, held, size = yield from self._given_out(key, number, held)
        self.left.update((number, b"".join(held)))

    @staticmethod
    def _as_bytes(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            yield chunk.assign(ids=[np.array([i for i in ids if not pd.isna(i)] if ids.dtype.kind != "i" else ids, "<i8").astype("<i4").tobytes() for ids in chunk["ids"]])

    def _given_out(self, key, number: int, held: list[bytes]):
        """Gives the full sequences out; returns the next one's number and the ids that are left, fewer than `length`."""
        ids = np.frombuffer(b"".join(held), "<i4")
        full = len(ids) // self.length
        if full:
            yield self._chunks(key, number, ids)
        rest = ids[full * self.length :].tobytes()
        return number + full, [rest], len(rest) // 4


def packed_stream(df: DataFrame, length: int, end_id: int, shard: str = "shard", order: str = "doc_id", ids: str = "tokens") -> DataFrame:
    """shard, chunk_id, input_ids: each shard's documents end to end with an end id each, cut into full sequences. State is the next sequence's
    number and what is left over, fewer than `length` ids, as bytes."""
    on_rocksdb(df.sparkSession)
    narrow = df.where(f"{ids} is not null").select(_whole(shard, "key"), _whole(order, "place"), F.col(ids).alias("ids"))
    return narrow.groupBy("key").transformWithStateInPandas(_Packing(length, end_id, shard), f"{shard} bigint, chunk_id bigint, input_ids array<int>", "Append", "None")


def source_stats_stream(df: DataFrame, tokens: str = "n_tokens") -> DataFrame:
    """Running docs and tokens per source, for the update or complete output mode."""
    return df.groupBy("source").agg(F.count("*").alias("docs"), F.sum(tokens).alias("tokens"))
