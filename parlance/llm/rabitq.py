"""Nearest neighbours by RaBitQ codes (Gao and Long, 2024).

Vectors are scaled to unit length, less a centre, scaled again and turned by a random rotation; a vector's code is the
signs of its coordinates, one bit each, packed. With the scalar <code, vector> kept beside it, the inner product of a
query with the vector is estimated without bias from the query and the bits, and lies within EPSILON deviations of the
estimate with near certainty. Vectors whose upper bound reaches the k-th best lower bound are ranked by the exact cosine.

Queries are turned too and rounded to QUERY_BITS bits a coordinate, kept as bit planes, so that an estimate is a few counts of
common bits of 64-bit words; what rounding may add is part of the bound.

Every row is coded, once; the centre is the mean of a bounded sample. Codes and vectors are dealt by digest of id into parts of
about PART_ROWS, queries into blocks of about QUERY_BLOCK; each part meets each block in one group of a shuffle, so neither
table goes through the driver and a group is bounded. A group hands on its k best a query, and the best of all parts are
chosen after a shuffle of those. The bounds leave out only what can't be among the k best (but for EPSILON), so the search is
over all rows; there is no coarse partition that would skip some.

Defined cases: vectors that are null, of length zero, or that hold a null or non-finite component take no part, nor do
rows with a null id. Vectors are compared with queries of their own dimension. A repeated id among the queries counts
once, with its smallest vector; among the candidates its nearest row counts. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.arrow import mapped

#: Rows of a group: queries and vectors, on average.
QUERY_BLOCK, PART_ROWS = 2_048, 16_384
#: Bits of a query's coordinate.
QUERY_BITS = 5
#: The centre is fitted on at most so many vectors, those of the smallest hashes of id.
SAMPLE = 4_096
#: Deviations of the error bound: the chance to miss a neighbour is under 1e-4 for each vector.
EPSILON = 4.0
SEED = 7
#: Rows coded at once.
SLICE = 1_024
RANKED_AT_ONCE = 50_000


def usable(vector: str = "vector"):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def rotation(dimension: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dimension]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


@dataclass
class Code:
    """bits: signs as 64-bit words; length: of the unit vector less the centre; agreement: <code, turned vector>; offset: <unit vector, centre>."""

    bits: np.ndarray
    length: np.ndarray
    agreement: np.ndarray
    offset: np.ndarray

    def __getitem__(self, some: slice) -> Code:
        return Code(self.bits[some], self.length[some], self.agreement[some], self.offset[some])


def unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    whole = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    whole[:, : bits.shape[1]] = bits
    return np.packbits(whole, axis=1).view(np.uint64)


def code(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Code:
    u = unit(vectors)
    rest = u - centre
    length = np.sqrt((rest * rest).sum(1))
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ turn.T
    return Code(packed(turned > 0), length, np.abs(turned).sum(1) / np.sqrt(len(centre)), u @ centre)


@dataclass
class Turned:
    """Turned queries less the centre: planes[j] holds bit j of the rounded coordinates, low + step * rounded; off: what rounding adds at most."""

    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    length: np.ndarray
    off: np.ndarray
    base: np.ndarray


def turned(queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, bits: int = QUERY_BITS) -> Turned:
    """Queries of unit length."""
    q = (queries - centre) @ turn.T
    low = q.min(1, keepdims=True)
    step = np.maximum((q.max(1, keepdims=True) - low) / (2**bits - 1), 1e-300)
    rounded = np.rint((q - low) / step).astype(np.int64)
    planes = np.stack([packed((rounded >> j) & 1 > 0) for j in range(bits)])
    near = low + step * rounded
    return Turned(planes, low, step, near.sum(1, keepdims=True), np.sqrt((q * q).sum(1, keepdims=True)), np.abs(q - near).sum(1, keepdims=True), (queries @ centre)[:, None] - centre @ centre)


def bounds(codes: Code, queries: Turned, d: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the cosines, one row for each query."""
    common = np.zeros((queries.planes.shape[1], len(codes.bits)), np.uint32)
    for j, plane in enumerate(queries.planes):
        for w in range(plane.shape[1]):
            common += np.bitwise_count(plane[:, w, None] & codes.bits[None, :, w]).astype(np.uint32) << np.uint32(j)
    ones = np.bitwise_count(codes.bits).sum(1)
    raw = (2 * (queries.low * ones + queries.step * common) - queries.total) / np.sqrt(d)
    agreement = np.where(codes.agreement > 0, codes.agreement, 1.0)
    inner = raw / agreement
    spread = np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement * epsilon / np.sqrt(max(d - 1, 1)) * queries.length + queries.off / np.sqrt(d) / agreement + 1e-9
    # <u, q> = <u - c, q - c> + <u, c> + <q, c> - <c, c>
    base = codes.offset[None, :] + queries.base
    return base + codes.length * (inner - spread), base + codes.length * (inner + spread)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a and b, added up in order, as a loop would."""
    added = lambda x: np.add.accumulate(x, axis=1)[:, -1]
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = added(a * b) / np.sqrt(added(a * a) * added(b * b))
    bad = ~np.isfinite(out)
    if bad.any():  # squares out of a double's range
        x, y = unit(a[bad]), unit(b[bad])
        out[bad] = added(x * y)
    return out


def nearest_in(ids: np.ndarray, vectors: np.ndarray, codes: Code, query_ids: np.ndarray, queries: np.ndarray, asked: Turned, k: int, floor: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k nearest of these vectors for each query, itself left out.

    The vectors of the best estimates are ranked first; with floor, the k-th best of what was seen before, their cosines
    tell what upper bound a vector must reach to be ranked as well.
    """
    u, q = unit(vectors), unit(queries)
    lower, upper = bounds(codes, asked, vectors.shape[1], epsilon)
    own = query_ids[:, None] == ids[None, :]
    need = k * int(np.unique(ids, return_counts=True)[1].max())
    if len(ids) > need + 1:
        estimate = np.where(own, -np.inf, lower + upper)
        best = np.argpartition(estimate, len(ids) - need, axis=1)[:, len(ids) - need :]
        exact = np.einsum("qd,qkd->qk", q, u[best])
        exact[np.take_along_axis(own, best, 1)] = -np.inf
        floor = np.maximum(floor, exact.min(1))
    rows, columns = np.nonzero((upper >= floor[:, None] - 1e-9) & ~own)
    score = np.concatenate([np.einsum("nd,nd->n", u[columns[i : i + RANKED_AT_ONCE]], q[rows[i : i + RANKED_AT_ONCE]]) for i in range(0, len(rows), RANKED_AT_ONCE)] or [np.zeros(0)])
    near = score >= floor[rows] - 1e-9
    rows, columns = rows[near], columns[near]
    return topped(rows, query_ids, ids[columns], cosines(vectors[columns], queries[rows]), k)


def topped(rows: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, each id once, ties to the smaller id."""
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    _, first = np.unique(np.stack([rows, ids], 1), axis=0, return_index=True)
    first.sort()
    rows, ids, score = rows[first], ids[first], score[first]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return query_ids[rows[best]], ids[best], score[best]


def centres_of(every: DataFrame) -> dict[int, np.ndarray]:
    """The centre for each dimension in the sample."""
    sample = every.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    drawn: dict[int, list] = {}
    for v in sample["vector"]:
        drawn.setdefault(len(v), []).append(v)
    return {d: unit(np.array(v, float)).mean(0) for d, v in drawn.items()}


CODED = "dim int, id long, vector array<double>, bits binary, length double, agreement double, offset double"


def coded(every: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """CODED of the rows (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column("vector")
            sizes = rows.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes).tolist():
                mine = batch.filter(pa.array(sizes == d))
                if d not in turns:
                    turns[d] = rotation(d)
                found = code(matrix(mine.column("vector"), d), centres.get(d, np.zeros(d)), turns[d])
                bits = pa.array([x.tobytes() for x in found.bits], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(mine.num_rows, d, np.int32)), mine.column("id"), mine.column("vector"), bits, *map(pa.array, (found.length, found.agreement, found.offset))], names=["dim", "id", "vector", "bits", "length", "agreement", "offset"])

    return mapped(every, run, CODED)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def search(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest cosine for each row of queries, which has the same columns."""
    kept = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable())
    every, asked = kept(vectors), kept(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    centres = centres_of(every)
    groups = lambda df, rows: max(-(-df.count() // rows), 1)
    parts, blocks = groups(every, PART_ROWS), groups(asked, QUERY_BLOCK)
    dealt = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded(every, centres).withColumn("part", dealt(parts, 1)).withColumn("block", each(blocks))
    right = asked.select(F.size("vector").alias("dim"), "id", "vector").withColumn("block", dealt(blocks, 2)).withColumn("part", each(parts))
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(key: tuple, found: pa.Table, wanted: pa.Table) -> pa.Table:
        best, d = None, key[0].as_py()
        if found.num_rows and wanted.num_rows:
            wanted = wanted.sort_by("id").combine_chunks()
            query_ids, queries = wanted.column("id").to_numpy(), matrix(wanted.column("vector").combine_chunks(), d)
            ids, v = found.column("id").to_numpy(), matrix(found.column("vector").combine_chunks(), d)
            bits = np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
            codes = Code(bits, *(found.column(c).to_numpy() for c in ("length", "agreement", "offset")))
            rounded = turned(unit(queries), centres.get(d, np.zeros(d)), rotation(d))
            for at in range(0, len(ids), SLICE):
                part = slice(at, at + SLICE)
                near = nearest_in(ids[part], v[part], codes[part], query_ids, queries, rounded, k, kth(best, query_ids, k), epsilon)
                best = merged(best, near, query_ids, k)
        return pa.table(dict(zip(schema.names, best or ([], [], []), strict=True)), pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

    keys = ("dim", "part", "block")
    out = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)
    found = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged(a: tuple | None, b: tuple, query_ids: np.ndarray, k: int) -> tuple:
    """The k best of both for each query; query_ids are sorted."""
    if a is None:
        return b
    asked, ids, score = (np.concatenate(x) for x in zip(a, b, strict=True))
    return topped(np.searchsorted(query_ids, asked), query_ids, ids, score, k)


def kth(found: tuple | None, query_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score found so far for each query, or minus infinity."""
    out = np.full(len(query_ids), -np.inf)
    if found is not None:
        rows = np.searchsorted(query_ids, found[0])
        full = np.bincount(rows, minlength=len(query_ids)) >= k
        least = np.full(len(query_ids), np.inf)
        np.minimum.at(least, rows, found[2])
        out[full] = least[full]
    return out
