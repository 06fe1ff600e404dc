"""Near-duplicate vectors by an epsilon grid order join on cosine.

1. Equal vectors are collapsed into classes with a weight. A link at cosine c is a distance of sqrt(2 - 2c) between unit vectors, and
   a projection onto orthonormal axes never lengthens a distance.
2. Classes are sorted by the grid cells (as wide as that distance) of their leading principal coordinates, and cut into blocks of
   consecutive vectors with their bounding boxes. Pairs of blocks whose boxes are farther apart are skipped.
3. A pair of blocks is one row of work. It is halved recursively, skipping halves whose boxes are too far apart; the remaining leaves
   are compared by one matrix product in double precision. A pair gives link counts and a spanning forest of its links, so its output is
   as long as its blocks, however dense a group is.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, or have a null id, link with nothing and are
their own component; vectors of different lengths don't link; rows that repeat are vectors of their own, with
the same id or not, and an id at several vectors joins nothing; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import staged, table
from sparkloom.llm.components import connected_components

COSINE = 0.95
AXES = 8
CELL_AXES = 6
BLOCK = 4096
LEAF = 512
MAX_BLOCKS = 1 << 17  # boxes that the driver and every executor hold: 17 MB; blocks grow beyond it
SLACK = 1e-9


def _usable(kind: str) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, dims, digests, raw = [], [], [], []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if vec_id is None or not v.is_valid or not len(v) or v.values.null_count:
                    continue
                a = v.values.to_numpy(zero_copy_only=False)
                if not np.isfinite(a).all() or not a.any():
                    continue
                data = a.astype(kind).tobytes()
                ids.append(vec_id)
                dims.append(len(a))
                digests.append(hashlib.blake2b(data, digest_size=16).digest())
                raw.append(data)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "dim", "digest", "raw"])

    return run


def _units(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), dim).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _moments(kind: str) -> Callable:
    """Per task: sums of the products of coordinates, one row for each pair of axes."""

    def run(batches):
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            raw = batch.column(1).to_pylist()
            for dim in np.unique(dims):
                u = _units([raw[i] for i in np.flatnonzero(dims == dim)], kind, int(dim))
                u = np.hstack([u, np.ones((len(u), 1))])
                sums[int(dim)] = sums.get(int(dim), 0) + u.T @ u
        for dim, s in sums.items():
            i, j = np.triu_indices(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), dim, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(s[i, j])], ["dim", "i", "j", "s"])

    return run


def principal_axes(classes: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """For each vector length the leading principal axes, as columns. The driver gets length ** 2 / 2 numbers for each length."""
    sums = classes.select("dim", "raw").mapInArrow(_moments(kind), "dim int, i int, j int, s double").groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    axes = {}
    for dim, part in sums.groupby("dim"):
        m = np.zeros((dim + 1, dim + 1))
        m[part["i"], part["j"]] = part["s"]
        m = np.triu(m) + np.triu(m, 1).T
        mean = m[:dim, dim] / m[dim, dim]
        _, vectors = np.linalg.eigh(m[:dim, :dim] / m[dim, dim] - np.outer(mean, mean))
        axes[int(dim)] = np.ascontiguousarray(vectors[:, ::-1][:, :AXES])
    return axes


def _cells(kind: str, axes: dict[int, np.ndarray], eps: float) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            raw = batch.column(2).to_pylist()
            cells: list = [None] * len(raw)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                c = np.floor(_units([raw[i] for i in at], kind, int(dim)) @ axes[int(dim)][:, :CELL_AXES] / eps).astype(np.int64)
                for i, row in zip(at, c, strict=True):
                    cells[i] = "".join(f"{int(x) + (1 << 32):09x}" for x in row)  # texts that sort as the cells do
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.string())], ["id", "dim", "raw", "weight", "cell"])

    return run


def _blocks(kind: str, axes: dict[int, np.ndarray], rows: int) -> Callable:
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def cut():
            nonlocal made
            ids, dims, raw, weights = zip(*held, strict=True)
            p = _units(list(raw), kind, dims[0]) @ axes[dims[0]]
            number = (part << 20) + made
            made += 1
            held.clear()
            values = [number, dims[0], np.array(ids, "<i8").tobytes(), np.array(weights, "<i8").tobytes(), b"".join(raw), p.min(axis=0).tolist(), p.max(axis=0).tolist()]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "dim", "ids", "weights", "raw", "low", "high"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if held and (len(held) >= rows or held[0][1] != row[1]):
                    yield cut()
                held.append(row)
        if held:
            yield cut()

    return run


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    d = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return np.sqrt((d * d).sum(axis=-1))


def _near_blocks(numbers: np.ndarray, dims: np.ndarray, low: np.ndarray, high: np.ndarray, eps: float) -> Callable:
    """For a block, the later or same ones within eps, by recursion over intervals of the sequence."""

    def found(i: int, a: int, b: int):
        inside = dims[a:b] == dims[i]
        if not inside.any():
            return
        if b - a <= 64:
            near = inside & (_gap(low[i], high[i], low[a:b], high[a:b]) <= eps)
            yield from (a + np.flatnonzero(near)).tolist()
        elif _gap(low[i], high[i], low[a:b][inside].min(axis=0), high[a:b][inside].max(axis=0)) <= eps:
            mid = (a + b) // 2
            yield from found(i, a, mid)
            yield from found(i, mid, b)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                near = list(found(i, i, len(numbers)))
                for k in range(0, len(near), 10_000):
                    js = near[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(js), numbers[i])), pa.array(numbers[js])], ["i", "j"])

    return run


class _Forest(dict):
    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = up = self.get(up, up)
            x = up
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self[max(x, y)] = min(x, y)


def join_blocks(x: np.ndarray, y: np.ndarray, ids_x, ids_y, w_x, w_y, axes: np.ndarray, cosine: float, same: bool) -> tuple[dict[int, int], _Forest]:
    """Link weights by id, and a forest over linked ids. same: x and y are one block, whose pairs count once."""
    eps = math.sqrt(2 - 2 * cosine) + SLACK
    px, py = x @ axes, y @ axes
    links_x, links_y, forest = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), _Forest()

    def visit(a: int, b: int, c: int, d: int) -> None:
        if _gap(px[a:b].min(axis=0), px[a:b].max(axis=0), py[c:d].min(axis=0), py[c:d].max(axis=0)) > eps:
            return
        if b - a > LEAF or d - c > LEAF:
            m, n = ((a + b) // 2 if b - a > LEAF else b), ((c + d) // 2 if d - c > LEAF else d)
            for p, q in ((a, m), (m, b)):
                for r, s in ((c, n), (n, d)):
                    if p < q and r < s and not (same and s <= p):
                        visit(p, q, r, s)
            return
        close = x[a:b] @ y[c:d].T >= cosine
        if same and c < b:
            close &= np.arange(c, d)[None, :] > np.arange(a, b)[:, None]
        if not close.any():
            return
        links_x[a:b] += close @ w_y[c:d]
        links_y[c:d] += w_x[a:b] @ close
        # Each distinct set of columns is one tree: its first column is linked to the others, and to one of the rows that have it.
        rows = np.flatnonzero(close.any(axis=1))
        packed, group = np.unique(np.packbits(close[rows], axis=1), axis=0, return_inverse=True)
        sets = np.unpackbits(packed, axis=1, count=d - c).astype(bool)
        heads = sets.argmax(axis=1)
        for r, g in zip(rows, group.ravel(), strict=True):
            forest.link(int(ids_x[a + r]), int(ids_y[c + heads[g]]))
        for k, columns in enumerate(sets):
            for col in np.flatnonzero(columns)[1:]:
                forest.link(int(ids_y[c + heads[k]]), int(ids_y[c + col]))

    visit(0, len(x), 0, len(y))
    totals: dict[int, int] = {}
    for ids, links in ((ids_x, links_x), (ids_y, links_y)):
        for i in np.flatnonzero(links):
            totals[int(ids[i])] = totals.get(int(ids[i]), 0) + int(links[i])
    return totals, forest


def _join(kind: str, axes: dict[int, np.ndarray], cosine: float) -> Callable:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                dim, same = r["dim"], r["i"] == r["j"]
                x = _matrix(r["raw_i"], kind, dim)
                y = x if same else _matrix(r["raw_j"], kind, dim)
                ids = [np.frombuffer(r[k], "<i8") for k in ("ids_i", "ids_j", "weights_i", "weights_j")]
                totals, forest = join_blocks(x, y, *ids, axes[dim], cosine, same)
                nodes = list(totals)
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([totals[n] for n in nodes], pa.int64()), pa.array([forest.root(n) for n in nodes], pa.int64())], ["id", "links", "root"])

    return run


def _matrix(raw: bytes, kind: str, dim: int) -> np.ndarray:
    size = dim * np.dtype(kind).itemsize
    return _units([raw[k : k + size] for k in range(0, len(raw), size)], kind, dim)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """vec_id, n_links (other vectors at cosine or above), component_id (smallest vec_id reachable), kept (vec_id is the component's)."""
    spark, eps = vectors.sparkSession, math.sqrt(2 - 2 * cosine) + SLACK
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    element = rows.schema["v"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    if not isinstance(element, (T.FloatType, T.DoubleType)):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    usable = staged(rows.mapInArrow(_usable(kind), "vec_id long, dim int, digest binary, raw binary"), "vectors")
    grouped = usable.groupBy("dim", "digest").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    distinct = usable.select(F.col("vec_id").alias("id"), "raw", F.col("digest").alias("of")).dropDuplicates(["id", "of"])
    classes = staged(grouped.join(distinct, (F.col("digest") == F.col("of")) & grouped["id"].eqNullSafe(distinct["id"])).select(grouped["id"], "dim", "digest", "raw", "weight", F.monotonically_increasing_id().alias("node")), "classes")
    n = classes.count()
    axes = principal_axes(classes, kind)
    size = max(block, -(-n // MAX_BLOCKS))
    sequence = (
        classes.select(F.col("node").alias("id"), "dim", "raw", "weight")
        .mapInArrow(_cells(kind, axes, eps), "id long, dim int, raw binary, weight long, cell string")
        .repartitionByRange(max(1, n // (4 * size)), "dim", "cell", "id")
        .sortWithinPartitions("dim", "cell", "id")
    )
    blocks = staged(sequence.mapInArrow(_blocks(kind, axes, size), "block long, dim int, ids binary, weights binary, raw binary, low array<double>, high array<double>"), "blocks")
    boxes = blocks.select("block", "dim", "low", "high").orderBy("block").toPandas()
    if len(boxes):
        find = _near_blocks(boxes["block"].to_numpy(), boxes["dim"].to_numpy(), _padded(boxes["low"]), _padded(boxes["high"]), eps)
    else:
        find = _near_blocks(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 1)), eps)
    tasks = max(1, min(len(boxes), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pairs = staged(spark.range(0, len(boxes), 1, tasks).mapInArrow(find, "i long, j long").withColumn("pair", F.xxhash64("i", "j")), "pairs")

    def side(s: str) -> DataFrame:
        cols = [F.col(c).alias(f"{c}_{s}") for c in ("ids", "weights", "raw")]
        return pairs.join(blocks.withColumnRenamed("block", s), s).select("pair", "i", "j", *([F.col("dim")] if s == "i" else []), *cols)

    work = side("i").join(side("j"), ["pair", "i", "j"]).select("i", "j", "dim", "ids_i", "ids_j", "weights_i", "weights_j", "raw_i", "raw_j")
    found = staged(work.mapInArrow(_join(kind, axes, cosine), "id long, links long, root long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # Classes go by numbers of their own up to here, as an id may stand at several vectors; a component is named by the smallest id of its classes at last.
    members = classes.select("id", "node", "dim", "digest", "weight").join(links.withColumnRenamed("id", "node"), "node", "left").join(parts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    members = members.select("dim", "digest", "id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    named = members.groupBy("component").agg(F.min("id").alias("component_id"))
    of_class = members.join(named, "component").select("dim", "digest", "n_links", "component_id")
    placed = usable.select("vec_id", "dim", "digest").join(of_class, ["dim", "digest"]).select("vec_id", "n_links", "component_id")
    bad = _unusable(rows).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(bad).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _unusable(rows: DataFrame) -> DataFrame:
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(v, lambda x: x == 0)
    return rows.where(F.col("vec_id").isNull() | v.isNull() | F.coalesce(odd, F.lit(True)) | F.coalesce(zero, F.lit(True)))


def _padded(column) -> np.ndarray:
    """Boxes of vectors with fewer axes get zeros, which add no distance."""
    return np.array([list(x) + [0.0] * (AXES - len(x)) for x in column], dtype=np.float64)


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
