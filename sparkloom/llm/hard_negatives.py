"""Hard negatives by branch and bound over ball trees.

1. Rows are staged with a place of their own and dealt into blocks by it, so a block is bounded in bytes, whatever rows repeat. A task holds one
   block as ball trees, one for each label that has enough rows there and one for the rest.
2. Anchors stream through every block, some hundred at a time. A node's centre c and radius r bound the inner product with an anchor a on both sides: a.c - |a| r
   and a.c + |a| r. A node is left out where its scores all lie above or below every window that the anchor still asks for, or strictly
   beneath the k-th score it has found in it; scores equal to the k-th go on, as the smaller id wins. Leaves are scored by a matrix product.
3. The first search has one window without ends over rows of the anchor's own label; its first scores are the positives. Each of them opens a window for
   the second search, over rows of other labels. What blocks find, k rows an anchor and window each, is ranked at last.

Scores are integers and exact: a leaf whose products could exceed 2 ** 53 is multiplied in whole numbers, and a score beyond a long counts as
the greatest or smallest long.

Defined cases: rows with a null label, a null vector, or any component that is null or, as it comes or scaled, not finite take no part; rows whose vectors differ
in length don't meet; rows that repeat are candidates each by itself, but anchors that agree in id, label and vector are one; a row with the anchor's
id is never its positive; null ids are never anchors and come last among equal scores; a positive with a negative score has no negatives
(its window is empty); an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import staged, table

POSITIVES, NEGATIVES = 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
BLOCK_BYTES = 64 << 20  # of a block's vectors in double precision
LEAF = 128
ANCHORS_AT_ONCE = 256
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


# ---------------------------------------------------------------- one block


class BallTree:
    """Points (rows of float64 whole numbers) under nested balls. Rows are permuted so that a node's points follow each other."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, labels: np.ndarray, label: int | None):
        """label: what all points share, else None."""
        self.label = label
        order = np.arange(len(points))
        self.first, self.last, self.children, centres, radii = [], [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            a, b, parent = todo.pop()
            at = len(self.first)
            if parent >= 0:
                self.children[parent].append(at)
            x = points[order[a:b]]
            c = x.mean(axis=0)
            far = x - c
            d2 = np.einsum("ij,ij->i", far, far)
            self.first.append(a), self.last.append(b), self.children.append([])
            centres.append(c), radii.append(np.sqrt(d2.max()))
            if b - a > LEAF:
                # Halved at the median along the line through two far points; equal points are halved too, so leaves stay small.
                one = x[d2.argmax()]
                gap = x - one
                other = x[np.einsum("ij,ij->i", gap, gap).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(x @ (one - other), half)]
                todo += [(a, a + half, at), (a + half, b, at)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.leaves = np.array([n for n, c in enumerate(self.children) if not c])
        self.centre_norms = np.sqrt((self.centres**2).sum(axis=1))
        self.points, self.ids, self.unnamed, self.labels = points[order], ids[order], unnamed[order], labels[order]
        self.norm = float(np.sqrt((points**2).sum(axis=1)).max())


def dot(anchors: np.ndarray, points: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products as longs; most: a bound on the product of their norms, and so on every partial sum."""
    if most < EXACT / 2:
        return np.rint(anchors @ points.T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object)
    return np.array([[min(max(v, LONG_MIN), LONG_MAX) for v in row] for row in whole(anchors) @ whole(points).T], dtype=np.int64).reshape(len(anchors), len(points))


class Best:
    """For some anchors and each of their windows, the k first (score, id) so far. Windows that an anchor lacks are empty (low > high)."""

    def __init__(self, lows: np.ndarray, highs: np.ndarray, k: int):
        n, w = lows.shape
        self.lows, self.highs, self.k = lows, highs, k
        self.found = [[(np.zeros(0, np.int64),) * 4] for _ in range(w)]  # anchor, score, unnamed, id
        self.kth = np.full((n, w), LONG_MIN, np.int64)

    def wanted(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which of the anchors a node matters to whose scores are within low and high."""
        least = np.maximum(self.lows[rows], self.kth[rows]).astype(np.float64)
        most = self.highs[rows].astype(np.float64)
        return ((high[:, None] >= least) & (low[:, None] <= most) & (self.lows[rows] <= self.highs[rows])).any(axis=1)

    def add(self, rows: np.ndarray, scores: np.ndarray, allowed: np.ndarray, unnamed: np.ndarray, ids: np.ndarray) -> None:
        for w, found in enumerate(self.found):
            least = np.maximum(self.lows[rows, w], self.kth[rows, w])
            fits = allowed & (scores >= least[:, None]) & (scores <= self.highs[rows, w][:, None])
            a, p = np.nonzero(fits)
            if len(a):
                found.append((rows[a], scores[a, p], unnamed[p].astype(np.int64), ids[p]))
                self._keep(w)

    def _keep(self, w: int) -> None:
        anchor, score, unnamed, ids = (np.concatenate(x) for x in zip(*self.found[w], strict=True))
        # Complemented, since the smallest long has no negative.
        order = np.lexsort((ids, unnamed, ~score, anchor))
        anchor, score, unnamed, ids = anchor[order], score[order], unnamed[order], ids[order]
        rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
        kept = rank < self.k
        self.found[w] = [(anchor[kept], score[kept], unnamed[kept], ids[kept])]
        full = rank == self.k - 1
        self.kth[anchor[full], w] = score[full]


def search(tree: BallTree, anchors: np.ndarray, labels: np.ndarray, ids: np.ndarray, same: bool, best: Best) -> int:
    """Adds to best what a tree has for anchors; returns how many scores were computed."""
    if tree.label is not None:
        rows = np.flatnonzero((labels == tree.label) == same)
    else:
        rows = np.arange(len(anchors))
    if not len(rows):
        return 0
    norms = np.sqrt((anchors**2).sum(axis=1))

    def score(leaf: int, rows: np.ndarray) -> int:
        part = slice(tree.first[leaf], tree.last[leaf])
        scores = dot(anchors[rows], tree.points[part], float(norms[rows].max()) * tree.norm)
        allowed = (tree.labels[part][None, :] == labels[rows][:, None]) == same
        if same:
            allowed &= tree.unnamed[part][None, :] | (tree.ids[part][None, :] != ids[rows][:, None])
        best.add(rows, scores, allowed, tree.unnamed[part], tree.ids[part])
        return scores.size

    # Each anchor begins with the leaf whose centre scores highest without leaving its windows, so that there is a k-th score to prune by.
    central = anchors[rows] @ tree.centres[tree.leaves].T
    central[central > best.highs[rows].max(axis=1).astype(np.float64)[:, None]] = -np.inf
    begun = np.full(len(anchors), -1)
    begun[rows] = tree.leaves[central.argmax(axis=1)]
    computed = sum(score(int(leaf), rows[begun[rows] == leaf]) for leaf in np.unique(begun[rows]))
    todo = [(0, rows)]
    while todo:
        node, rows = todo.pop()
        middle = anchors[rows] @ tree.centres[node]
        # A little wider than the ball, for rounding.
        reach = norms[rows] * (tree.radii[node] * (1 + 1e-9) + tree.centre_norms[node] * 1e-9) + 1e-6
        rows = rows[best.wanted(rows, middle - reach, middle + reach) & (begun[rows] != node)]
        if not len(rows):
            continue
        if tree.children[node]:
            # The child with the greater scores is looked at first, as it raises the k-th soonest.
            todo += [(c, rows) for c in sorted(tree.children[node], key=lambda c: float((anchors[rows] @ tree.centres[c]).sum()))]
        else:
            computed += score(node, rows)
    return computed


def vectors_by_length(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length that an Arrow list column has."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, column.take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), int(d))


def forest(batches: list) -> dict[int, list[BallTree]]:
    """Ball trees of a block's rows by length of vector."""
    import pyarrow as pa

    rows = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: rows.column(name).chunk(0)
    ids, unnamed, labels = column("id").fill_null(LONG_MAX).to_numpy(), column("id").is_null().to_numpy(zero_copy_only=False), column("label").to_numpy()
    out: dict[int, list[BallTree]] = {}
    for at, points in vectors_by_length(column("q")):
        own, counts = np.unique(labels[at], return_counts=True)
        large = own[counts >= LEAF]
        parts = [(int(v), labels[at] == v) for v in large] + [(None, ~np.isin(labels[at], large))]
        out[points.shape[1]] = [BallTree(points[m], ids[at][m], unnamed[at][m], labels[at][m], v) for v, m in parts if m.any()]
    return out


def _answers(trees: dict[int, list[BallTree]], asked, percents: tuple[int, int] | None, k: int):
    import pyarrow as pa

    same = percents is None
    about = asked.column("about").to_pylist()
    lows = [[LONG_MIN] if same else [-(-percents[0] * s // 100) for s in scores] for scores in about]
    highs = [[LONG_MAX] if same else [percents[1] * s // 100 for s in scores] for scores in about]
    qid, ids, labels = (asked.column(c).to_numpy() for c in ("qid", "id", "label"))
    for at, anchors in vectors_by_length(asked.column("q")):
        for part in range(0, len(at), ANCHORS_AT_ONCE):
            rows, own = at[part : part + ANCHORS_AT_ONCE], anchors[part : part + ANCHORS_AT_ONCE]
            w = max(len(lows[i]) for i in rows)
            low, high = np.full((len(rows), w), LONG_MAX, np.int64), np.full((len(rows), w), LONG_MIN, np.int64)
            for j, i in enumerate(rows):
                low[j, : len(lows[i])], high[j, : len(highs[i])] = lows[i], highs[i]
            best = Best(low, high, k)
            for tree in trees.get(anchors.shape[1], []):
                search(tree, own, labels[rows], ids[rows], same, best)
            for window, found in enumerate(best.found):
                anchor, score, unnamed, found_ids = found[0]
                if len(anchor):
                    yield pa.RecordBatch.from_arrays([pa.array(qid[rows][anchor]), pa.array(np.full(len(anchor), window, np.int32)), pa.array(found_ids, mask=unnamed.astype(bool)), pa.array(score)], ["qid", "window", "found", "score"])


def _searching(percents: tuple[int, int] | None, k: int):
    def run(batches):
        held, trees = [], None
        for batch in batches:
            cut = int((batch.column("kind").to_numpy() == 0).sum())  # a block's rows come before the anchors
            if cut:
                held.append(batch.slice(0, cut))
            if cut < batch.num_rows and held:
                trees = trees if trees is not None else forest(held)
                yield from _answers(trees, batch.slice(cut), percents, k)

    return run


# ---------------------------------------------------------------- the table


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """id, label, q: the rows that take part, each component scaled and rounded down to a whole number, held as a double."""
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * scale)
    whole = lambda y: F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  beyond 2 ** 53 every double is whole
    finite = lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))
    rows = vectors.where(F.col(vec_col).isNotNull() & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled.alias("y"))
    return rows.where(F.forall("y", finite)).select("id", "label", F.transform("y", whole).alias("q"))


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, blocks: int, k: int, percents: tuple[int, int] | None = None) -> DataFrame:
    """qid, window, found, score, rank: for each query the k first rows of its label (window 0), or, with percents, the k first rows of other labels
    whose scores are within these of the query's n-th score in `about` (window n)."""
    none = lambda kind: F.lit(None).cast(kind)
    held = rows.select((F.col("slot") % blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "label", "q", none("long").alias("qid"), none("array<long>").alias("about"))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "label", "q", "qid", "about")
    dealt = held.unionByName(asked).repartitionById(blocks, "block").sortWithinPartitions("kind")
    found = dealt.mapInArrow(_searching(percents, k), "qid long, window int, found long, score long")
    return _first(found, ["qid", "window"], k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: id, label, q as usable() gives them; is_anchor: which of them ask."""
    spark = vectors.sparkSession
    rows = staged(vectors.withColumn("slot", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.coalesce(F.sum(F.size("q") + 8), F.lit(0))).first()[0] * 8
    # As many blocks as keep the cluster busy, and more where a block would outgrow its bytes.
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    anchors = staged(rows.where(is_anchor).groupBy("id", "label", "q").agg(F.min("slot").alias("qid")), "anchors")
    best = nearest(rows, anchors.withColumn("about", F.array().cast("array<long>")), blocks, positives)
    found = staged(best.select("qid", (F.col("rank") - 1).alias("window"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    about = found.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("window", "positive_score"))).alias("p")).select("qid", F.col("p.positive_score").alias("about"))
    hard = nearest(rows, anchors.join(about, "qid"), blocks, negatives, (low, high))
    named = hard.join(found, ["qid", "window"]).join(anchors.select("qid", F.col("id").alias("anchor_id")), "qid")
    return named.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 100. Where an id is divisible by 7, the label is the next one."""
    rows = usable(table(spark, sf_dir, "embeddings"))
    relabelled = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(relabelled, F.col("id") % 100 == 0)
