"""Vector codes: parts of integer vectors by their nearest entries, found by pruning on norms (product quantisation).

Each component x becomes floor(scale * x), vectors are cut into equal consecutive parts, and each part is coded by the nearest
of its position's entries: squared Euclidean distance, ties to the lower index. Codebooks start as the parts of the rows of
smallest id; each round assigns all rows and replaces an entry by floor(sum / count) of its parts.

The nearest entry is found by annular pruning: entries are sorted by norm, and since | |x| - |c| | is at most the distance, only
entries of norms within the best distance so far can be as near. The first candidate is the entry of nearest norm; the interval
of norms is found by binary search, its ends included, and narrowed whenever a nearer entry is found. Distances inside are exact
integers.

A round is one pass over the rows: every task hands on one row for each part and entry with the count and sum of what it
assigned, which is added up by Spark, so the driver gets the codebooks alone (parts x entries x width numbers, whatever the rows).

Defined cases: rows whose vector is null or holds a null or non-finite component are dropped. Each dimension among the rows has
codebooks of its own, so there are as many as distinct dimensions; a dimension that the number of parts doesn't divide is filled
up with zeros, and an empty vector has parts of width 0 at distance 0. With fewer rows than entries the codebook is that short. Among equal ids the smaller vector
comes first, null ids come last. Repeated rows are coded each. An empty table gives no rows. Integers of which distances or sums
don't fit in 64 bits raise OverflowError. Other columns of the input don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.arrow import mapped
from parlance.llm.components import SALTS
from parlance.llm.storage import saved

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Largest distance: sums of it over 2^15 rows of a batch and of components over 2^31 rows stay within 64 bits.
MOST = 2**62


def finite(vector: str):
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def integers(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(flat * float(scale))
    if len(out) and not (np.abs(out).max() < 2.0**31):
        raise OverflowError(f"a component times {scale} doesn't fit in 32 bits; scale the vectors")
    return out.astype(np.int64)


@dataclass
class Annuli:
    """Entries of one part position, sorted by norm."""

    entries: np.ndarray
    order: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Annuli:
        if entries.size and 4.0 * entries.shape[1] * float(np.abs(entries).max()) ** 2 >= MOST:
            raise OverflowError("squared distances don't fit in 64 bits; scale the vectors")
        norms = np.sqrt((entries.astype(float) ** 2).sum(1))
        order = np.argsort(norms, kind="stable")
        return cls(entries, order, norms[order])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row, and how many distances were computed."""
        n, last = len(parts), len(self.norms) - 1
        if parts.size and 4.0 * parts.shape[1] * float(np.abs(parts).max()) ** 2 >= MOST:
            raise OverflowError("squared distances don't fit in 64 bits; scale the vectors")
        norm = np.sqrt((parts.astype(float) ** 2).sum(1))
        right = np.searchsorted(self.norms, norm).clip(0, last)
        left = (right - 1).clip(0)
        place = np.where(np.abs(self.norms[left] - norm) <= np.abs(self.norms[right] - norm), left, right)
        index = self.order[place]
        gap = parts - self.entries[index]
        best, done = (gap * gap).sum(1), n
        low, high = self.interval(norm, best)
        # outward from the entry of nearest norm, so that intervals narrow early
        for step in range(1, last + 1):
            for at in (place - step, place + step):
                some = np.flatnonzero((at >= low) & (at < high))
                if not len(some):
                    continue
                entry = self.order[at[some]]
                gap = parts[some] - self.entries[entry]
                distance = (gap * gap).sum(1)
                done += len(some)
                nearer = (distance < best[some]) | ((distance == best[some]) & (entry < index[some]))
                moved = some[nearer]
                index[moved], best[moved] = entry[nearer], distance[nearer]
                low[moved], high[moved] = self.interval(norm[moved], best[moved])
        return index, best, done

    def interval(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places [low, high) of norms within the best distance, widened by what rounding may be off."""
        reach = np.sqrt(best.astype(float))
        slack = 1e-9 * (1 + norm + reach)
        return np.searchsorted(self.norms, norm - reach - slack, "left"), np.searchsorted(self.norms, norm + reach + slack, "right")


#: By dimension: one array (entries, width) for each part position.
Codebooks = dict[int, list[np.ndarray]]


def cut(flat: np.ndarray, d: int, n: int, parts: int, scale: int) -> np.ndarray:
    """(parts, n, width) of n vectors of dimension d."""
    width = -(-d // parts)
    whole = np.zeros((n, parts * width), np.int64)
    whole[:, :d] = integers(flat, scale).reshape(n, d)
    return whole.reshape(n, parts, width).transpose(1, 0, 2)


def by_dimension(batch: pa.RecordBatch, parts: int, scale: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    sizes = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        mine = batch.filter(pa.array(sizes == d))
        yield d, mine, cut(mine.column("vector").flatten().to_numpy(zero_copy_only=False), d, mine.num_rows, parts, scale)


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """From the rows of smallest id of each dimension; a task hands on that many a dimension at most."""
    dims = rows.select(F.size("vector").alias("d"), "id", "vector")
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.col("id").asc_nulls_last(), "vector"))
    held: dict[int, list] = {}
    for r in dims.withColumn("place", place).where(F.col("place") <= entries).orderBy("d", "place").collect():
        held.setdefault(r["d"], []).append(r["vector"])
    return {d: list(cut(np.array([x for v in found for x in v], float), d, len(found), parts, scale)) for d, found in held.items()}


def assigned(books: dict[int, list[Annuli]], d: int, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, parts) of indexes and of squared distances."""
    found = [book.nearest(np.ascontiguousarray(cuts[p]))[:2] for p, book in enumerate(books[d])]
    return np.stack([i for i, _ in found], 1), np.stack([b for _, b in found], 1)


def sums_of(books: dict[int, list[Annuli]], parts: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for d, _, cuts in by_dimension(batch, parts, scale):
                index, _ = assigned(books, d, cuts)
                for p in range(parts):
                    for e in np.unique(index[:, p]).tolist():
                        mine = cuts[p][index[:, p] == e]
                        sums[d, p, e] = sums.get((d, p, e), 0) + np.concatenate([[len(mine)], mine.sum(0)])
        at = [(*k, j, int(x)) for k, v in sums.items() for j, x in enumerate(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in at], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["d", "p", "e", "j", "x"])

    return run


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of rows (id long, vector array<double>), all of them usable."""
    books = first_codebooks(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):
        found = mapped(rows.select("vector"), sums_of(annuli(books), parts, scale), "d int, p int, e int, j int, x long")
        added: dict[tuple, dict[int, int]] = {}
        for r in found.groupBy("d", "p", "e", "j").agg(F.sum("x").alias("x")).collect():  # counts and sums of the entries
            added.setdefault((r["d"], r["p"], r["e"]), {})[r["j"]] = r["x"]
        for (d, p, e), x in added.items():
            books[d][p][e] = [x[j] // x[0] for j in range(1, len(x))]
    return books


def annuli(books: Codebooks) -> dict[int, list[Annuli]]:
    return {d: [Annuli.of(e) for e in parts] for d, parts in books.items()}


def digest(parts: list[np.ndarray]) -> str:
    """Of all components by part, entry and place."""
    return hashlib.sha256(",".join(str(x) for entries in parts for x in entries.ravel().tolist()).encode()).hexdigest()


def encoded(rows: DataFrame, books: Codebooks, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error, codebooks_sha256) of rows (id, label, vector); a code has two hex digits a part."""
    sorted_books, digests = annuli(books), {d: digest(p) for d, p in books.items()}
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, mine, cuts in by_dimension(batch, parts, scale):
                index, distance = assigned(sorted_books, d, cuts)
                codes = [x.tobytes().hex() for x in index.astype(np.uint8)]
                made = [pa.array(codes), pa.array(distance.sum(1)), pa.array([digests[d]] * mine.num_rows)]
                yield pa.RecordBatch.from_arrays([mine.column("id"), mine.column("label"), *made], names=["id", "label", "code", "error", "codebooks_sha256"])

    return mapped(rows.select("id", "label", "vector"), run, f"id long, label {label}, code string, error long, codebooks_sha256 string")


def with_label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the error summed over rows of an equal label. Rows of a label are dealt over several tasks."""
    coded = coded.withColumn("unlabelled", F.col("label").isNull()).withColumn("label", F.coalesce("label", F.lit(0).cast(coded.schema["label"].dataType)))
    sums = coded.groupBy("unlabelled", "label").agg(F.sum("error").alias("label_error"))
    salt = F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int")
    each = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return coded.withColumn("salt", salt).join(each, ["unlabelled", "label", "salt"]).drop("salt", "unlabelled", "label")


def codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("vector")).where(finite("vector"))
    books = fit(rows.select("id", "vector"), parts, entries, rounds, scale)
    coded = saved(encoded(rows, books, parts, scale), "codes")
    return with_label_errors(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")
