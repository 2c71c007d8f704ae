"""Hard negatives by vantage-point trees over norm-augmented vectors.

A row's score for an anchor is the inner product of their integer vectors, floor(scale * x) in each component. Give each row the
further component sqrt(M^2 - |v|^2), where M is the largest norm, and the anchor a zero: then the squared distance is
|a|^2 + M^2 - 2 * score, so larger scores are nearer, and a window of scores is an annulus about the anchor.

Rows are dealt by digest of id into parts of about PART_ROWS, each with a vantage-point tree of its own: a node splits its rows
at the median distance from one of them, and keeps the least and greatest distance on both sides. For an anchor, the
distances to the vantage points on the way to a leaf bound, by the triangle inequality, how near and how far its rows
can be; leaves that can't reach the annulus are left out, the others visited nearest first, until the k-th row found is
nearer than any leaf left. Anchors of a block go on in step, so a leaf is compared with all that want it at once. Bounds
are widened by what rounding may be off, and scores are exact integers, so the result is exact.

Anchors are dealt into blocks of about ANCHOR_BLOCK; each part meets each block in one group of a shuffle, of bounded size. The
best of all parts are chosen after a shuffle of k rows a part. Positives, rows of the anchor's label, come first; their
scores make the windows of the second pass.

Defined cases: rows whose id, label or vector is null, or whose vector holds a null or non-finite component, take no part.
An id counts once, with its smallest vector and then smallest label; rows of an anchor's id are neither its positives nor negatives. Vectors
meet those of their own dimension; an empty vector scores 0 with others. Ties go to the smaller id. Anchors without a row of their label, positives whose
window holds no row, and empty tables give no rows. Integers whose products don't fit in 53 bits raise OverflowError. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.storage import saved
from parlance.llm.vector_codes import finite

#: Rows of a group: of anchors and of vectors, on average.
ANCHOR_BLOCK, PART_ROWS = 8_192, 16_384
#: Rows of a leaf at most.
LEAF = 256
#: Anchors that search at once.
AT_ONCE = 512
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is within these hundredths of the positive's.
WINDOW = (50, 95)


@dataclass
class Tree:
    """Rows in the order of leaves; leaf i has order[starts[i]:starts[i + 1]]. paths[i]: (vantage, nearest, farthest) for each node on the way to it."""

    order: np.ndarray
    starts: np.ndarray
    vantages: np.ndarray
    paths: list[list[tuple[int, float, float]]]


def planted(rows: np.ndarray, squares: np.ndarray, extra: np.ndarray) -> Tree:
    """The tree of rows (n, d) with their squared norms and further components."""

    def away(v: int, some: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[some] + squares[v] - 2 * (rows[some] @ rows[v]) + (extra[some] - extra[v]) ** 2, 0))

    order, starts, vantages, paths = [], [0], [], []
    stack: list[tuple[np.ndarray, list]] = [(np.arange(len(rows)), [])]
    while stack:
        mine, path = stack.pop()
        if len(mine) <= LEAF:
            order.append(np.sort(mine))
            starts.append(starts[-1] + len(mine))
            paths.append(path)
            continue
        v = mine[np.argmax(away(mine[0], mine))]  # a far row sees the others at varied distances
        distance = away(v, mine)
        half = len(mine) // 2
        split = np.argpartition(distance, half)
        for side in (split[:half], split[half:]):
            stack.append((mine[side], [*path, (len(vantages), distance[side].min(), distance[side].max())]))
        vantages.append(v)
    return Tree(np.concatenate(order), np.array(starts), np.array(vantages, int), paths)


class Part:
    """Rows of one part, sorted by id, with their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.ids, self.vectors, self.labels = ids, vectors, labels
        self.squares = (vectors * vectors).sum(1)
        self.most = float(self.squares.max())
        self.tree = planted(vectors, self.squares, np.sqrt(self.most - self.squares))
        self.slack = 1e-6 * (1 + np.sqrt(self.most))
        n = int(labels.max()) + 1
        self.counts = np.zeros((len(self.tree.paths), n), np.int64)  # rows of a leaf by label
        for i in range(len(self.tree.paths)):
            np.add.at(self.counts[i], labels[self.leaf(i)], 1)

    def leaf(self, i: int) -> np.ndarray:
        return self.tree.order[self.tree.starts[i] : self.tree.starts[i + 1]]

    def bounds(self, anchors: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance of each anchor from the rows of each leaf."""
        seen = np.sqrt(np.maximum((squares + self.most)[:, None] - 2 * (anchors @ self.vectors[self.tree.vantages].T), 0))
        least = np.zeros((len(anchors), len(self.tree.paths)))
        most = np.full_like(least, np.inf)
        for i, path in enumerate(self.tree.paths):
            for v, near, far in path:
                np.maximum(least[:, i], np.maximum(seen[:, v] - far, near - seen[:, v]), out=least[:, i])
                np.minimum(most[:, i], seen[:, v] + far, out=most[:, i])
        return least - self.slack, most + self.slack

    def search(self, ids: np.ndarray, anchors: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, row id, score) of the k best rows of scores from low to high, of the anchor's label or (same = False) of others."""
        squares = (anchors * anchors).sum(1)
        whole = squares + self.most
        least, most = self.bounds(anchors, squares)
        near, far = np.sqrt(np.maximum(whole - 2 * high, 0)), np.sqrt(np.maximum(whole - 2 * low, 0))  # the annulus
        known = labels >= 0
        of_label = np.where(known[:, None], self.counts[:, np.where(known, labels, 0)].T, 0)
        wanted = of_label if same else self.counts.sum(1)[None, :] - of_label
        least[(least > far[:, None]) | (most < near[:, None]) | (wanted == 0)] = np.inf
        turn = np.argsort(least, axis=1, kind="stable")
        best = Best(len(ids), k)
        going = np.arange(len(ids))
        for r in range(turn.shape[1]):
            leaf = turn[going, r]
            bound = least[going, leaf]
            reach = np.sqrt(np.maximum(whole[going] - 2 * best.last(going), 0)) + self.slack
            going, leaf = going[on := np.isfinite(bound) & (bound <= reach)], leaf[on]
            if not len(going):
                break
            floor = best.last(going)
            found = []
            by_leaf = np.argsort(leaf, kind="stable")
            for mine in np.split(by_leaf, np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                a, rows = going[mine], self.leaf(leaf[mine[0]])
                score = anchors[a] @ self.vectors[rows].T
                fits = (score >= np.maximum(low[a], floor[mine])[:, None]) & (score <= high[a, None]) & ((labels[a, None] == self.labels[rows]) == same) & (ids[a, None] != self.ids[rows])
                x, y = np.nonzero(fits)
                found.append((a[x], self.ids[rows[y]], score[x, y]))
            best.add(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return best.rows()


class Best:
    """The k best (score, then smaller id) of each of n anchors."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.score, self.id = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def last(self, some: np.ndarray) -> np.ndarray:
        return self.score[some, -1]

    def add(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(anchor):
            return
        touched = np.unique(anchor)
        old = np.repeat(touched, self.k)
        a, i, s = np.concatenate([old, anchor]), np.concatenate([self.id[touched].ravel(), ids]), np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((i, -s, a))
        a, i, s = a[order], i[order], s[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        top = place < self.k
        self.id[a[top], place[top]], self.score[a[top], place[top]] = i[top], s[top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, j = np.nonzero(np.isfinite(self.score))
        return a, self.id[a, j], self.score[a, j].astype(np.int64)


def exact(column: pa.ChunkedArray, d: int, n: int, scale: int) -> np.ndarray:
    """(n, d) of floor(scale * x), as doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, d) * float(scale))
    if out.size and not d * float(np.abs(out).max()) ** 2 < 2.0**51:
        raise OverflowError(f"inner products of vectors times {scale} don't fit in 53 bits; scale the vectors")
    return out


def once(rows: pa.Table) -> pa.Table:
    """Rows sorted by id, an id once: its smallest vector, and of these the smallest label."""
    rows = rows.sort_by("id").combine_chunks()
    ids = rows.column("id").to_numpy()
    if len(ids) < 2 or (np.diff(ids) > 0).all():
        return rows
    vectors, labels = rows.column("vector"), rows.column("label")
    starts = np.flatnonzero(np.append(True, np.diff(ids) > 0))
    keep = [min(range(a, b), key=lambda i: (vectors[i].as_py(), labels[i].as_py())) if b - a > 1 else a for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True)]
    return rows.take(pa.array(keep))


def searched(scale: int, k: int, same: bool):
    """The function of a group: rows of a part and anchors of a block, each with windows (key, low, high), to (anchor_id, key, id, score)."""

    def run(key: tuple, found: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if found.num_rows and asked.num_rows:
            d, found, asked = key[0].as_py(), once(found), asked.sort_by("id").combine_chunks()
            names = {x: i for i, x in enumerate(found.column("label").unique().to_pylist())}
            codes = lambda t: np.array([names.get(x, -1) for x in t.column("label").to_pylist()])
            part = Part(found.column("id").to_numpy(), exact(found.column("vector"), d, found.num_rows, scale), codes(found))
            ids, labels, vectors = asked.column("id").to_numpy(), codes(asked), exact(asked.column("vector"), d, asked.num_rows, scale)
            windows, low, high = (asked.column(c).to_numpy() for c in ("window", "low", "high"))
            for at in range(0, len(ids), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                a, i, s = part.search(ids[some], vectors[some], labels[some], low[some].astype(float), high[some].astype(float), k, same)
                out.append((ids[some][a], windows[some][a], i, s))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("anchor_id", "window", "id", "score"), columns, strict=True)))

    return run


def dealt(n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")


def met(rows: DataFrame, asked: DataFrame, parts: int, blocks: int, scale: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, window, id, score): the k best of all parts for each window of asked (id, label, vector, window, low, high)."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("part", dealt(parts, 1)).withColumn("block", each(blocks))
    right = asked.withColumn("block", dealt(blocks, 2)).withColumn("part", each(parts))
    keys = ("dim", "part", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(searched(scale, k, same), "anchor_id long, window long, id long, score long")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); is_anchor is a condition on the columns of vectors.

    A negative's score times 100 is from window[0] to window[1] times the positive's.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).alias("vector"), is_anchor.alias("anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vector")).withColumn("dim", F.size("vector"))
    anchors = saved(rows.where("anchor").groupBy("dim", "id").agg(F.min(F.struct("vector", "label")).alias("v")).select("dim", "id", "v.label", "v.vector"), "anchors")
    rows = rows.drop("anchor")
    parts, blocks = (max(-(-df.count() // n), 1) for df, n in ((rows, PART_ROWS), (anchors, ANCHOR_BLOCK)))
    whole = anchors.select("*", F.lit(0).cast("long").alias("window"), F.lit(-(2**52)).cast("long").alias("low"), F.lit(2**52).cast("long").alias("high"))
    near = saved(met(rows, whole, parts, blocks, scale, positives, True).select(F.col("anchor_id").alias("id"), F.col("id").alias("window"), F.col("score").alias("positive_score")), "positives")
    # sum of s * w / 100, rounded inwards; integers all the way
    low, high = F.expr(f"-((-positive_score * {window[0]} - pmod(-positive_score * {window[0]}, 100)) div 100)"), F.expr(f"(positive_score * {window[1]} - pmod(positive_score * {window[1]}, 100)) div 100")
    asked = anchors.join(near, "id").withColumn("low", low).withColumn("high", high).where("low <= high")
    found = met(rows, asked.drop("positive_score"), parts, blocks, scale, negatives, False)
    found = found.select(F.col("anchor_id").alias("id"), "window", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["id", "window"]).select(F.col("id").alias("anchor_id"), F.col("window").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")
