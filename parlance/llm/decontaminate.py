"""Benchmark decontamination: passages of documents that repeat a benchmark item.

A document's windows have as many words as the item; the start and the end of a text clip windows, down to 0.8 of the
item's shingles, so that an item cut short by them, or that is more than the whole text, is found. Each window and item gets a 64-bit SimHash of its weighted shingles
(weight: how often a shingle occurs). Fingerprints are cut into BLOCKS blocks; two of Hamming distance up to RADIUS agree
in some block up to RADIUS // BLOCKS bits, so probing each block's neighbourhood finds every item within the radius. The
pairs found are then verified by the exact weighted Jaccard similarity of their shingles.

A window is fingerprinted only if enough of its shingles occur in items of its (unclipped) size: similarity t needs t
times the size of the item in common, so no window left out could be verified.

Shingles have five words (lower-cased runs of letters, digits and underscores), the similarity is 0.8 or more. An item of
fewer words has one shingle of them all. Defined cases: null and empty items and texts match nothing; repeated items
report once, repeated documents each by itself; of equally similar windows the first is
reported, of those the longest. Texts and items are
read whole. A benchmark beyond the bounds of one index is handled in several, each over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.arrow import free, with_columns
from parlance.llm.words import SHINGLE, WordHashes, shingles

SIMILARITY = 0.8
#: A pair of similarity 0.8 is 10 bits apart on average, with a deviation of 3.
RADIUS, BLOCKS = 19, 6
#: One index holds at most so many items and, unless one item alone is longer, so many characters.
INDEX_ITEMS, INDEX_CHARS = 20_000, 20_000_000
FOUND = "__leaks"


def signs(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 values 1 or -1 for each hash."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def cuts() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    edges = np.linspace(0, 64, BLOCKS + 1).astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:], strict=False)]


def neighbourhood(bits: int) -> np.ndarray:
    """Masks of all changes of up to RADIUS // BLOCKS of so many bits."""
    return np.array([sum(1 << i for i in c) for k in range(RADIUS // BLOCKS + 1) for c in combinations(range(bits), k)], np.uint64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets as (sorted distinct hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both) / float(a[1].sum() + b[1].sum() - both)


def windows(n: int, size: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle, end) of the windows of a text of n shingles for items of so many: the first ones first, longer ones before shorter.

    Besides those of full size, windows clipped by the start or end of the text, down to the similarity's share of the size.
    """
    least = max(int(np.ceil(similarity * size - 1e-9)), 1)
    clipped = np.arange(min(n, size - 1), least - 1, -1)
    full = np.arange(max(n - size + 1, 0))
    after = clipped[clipped < n]  # a window of the whole text is clipped at both ends and is one
    starts = np.concatenate([full[:1], np.zeros(len(clipped), np.int64), full[1:], n - after])
    return starts, np.concatenate([full[:1] + size, clipped, full[1:] + size, np.full(len(after), n)])


@dataclass
class Index:
    """Items that have words, with their fingerprints sorted by block; sizes: items and shingles for each word count."""

    ids: list
    sets: list[tuple[np.ndarray, np.ndarray]]
    words: np.ndarray
    prints: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    by_size: dict[int, np.ndarray] = field(default_factory=dict)
    every: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(items: list[tuple], width: int = SHINGLE) -> Index:
        """items: (id, text)."""
        flat, bounds = WordHashes().of([t for _, t in items])
        index = Index([], [], np.zeros(0, np.int64), np.zeros(0, np.uint64))
        words, prints = [], []
        for i, (name, _) in enumerate(items):
            n = int(bounds[i + 1] - bounds[i])
            if not n:
                continue
            found = shingles(flat[bounds[i] : bounds[i + 1]], min(width, n))
            index.ids.append(name)
            index.sets.append(np.unique(found, return_counts=True))
            words.append(n)
            prints.append(packed(signs(found).sum(0, keepdims=True))[0])
        index.words, index.prints = np.array(words, np.int64), np.array(prints, np.uint64)
        for first, bits in cuts():
            part = (index.prints >> np.uint64(first)) & np.uint64((1 << bits) - 1)
            order = np.argsort(part, kind="stable")
            index.tables.append((part[order], order))
        for n in set(words):
            index.by_size[n] = np.unique(np.concatenate([index.sets[i][0] for i in np.flatnonzero(index.words == n)]))
        for w in {min(width, n) for n in words}:
            index.every[w] = np.unique(np.concatenate([x for n, x in index.by_size.items() if min(width, n) == w]))
        return index

    def within(self, fingerprint: np.uint64) -> np.ndarray:
        """Places of all items within RADIUS of a fingerprint."""
        found = []
        for (first, bits), (sorted_part, order) in zip(cuts(), self.tables, strict=True):
            probes = ((fingerprint >> np.uint64(first)) & np.uint64((1 << bits) - 1)) ^ neighbourhoods()[bits]
            lo, hi = np.searchsorted(sorted_part, probes, "left"), np.searchsorted(sorted_part, probes, "right")
            found += [order[a:b] for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)]
        if not found:
            return np.zeros(0, np.int64)
        near = np.unique(np.concatenate(found))
        return near[np.bitwise_count(self.prints[near] ^ fingerprint) <= RADIUS]

    def leaks(self, hashes: np.ndarray, similarity: float, width: int) -> list[tuple[int, float, int, int]]:
        """(item's place, similarity, first word, words): the best window of each item that a text repeats."""
        best: dict[int, tuple[float, int, int]] = {}
        for w, every in self.every.items():
            own = shingles(hashes, w)
            hit = own[every[np.minimum(np.searchsorted(every, own), len(every) - 1)] == own]
            if not len(hit):
                continue
            total = None
            for n in [n for n, x in self.by_size.items() if min(width, n) == w and np.isin(hit, x).any()]:
                size = n - w + 1
                common = np.concatenate([[0], np.cumsum(np.isin(own, self.by_size[n]))])
                starts, ends = windows(len(own), size, similarity)
                enough = common[ends] - common[starts] >= similarity * size - 1e-9
                if not enough.any():
                    continue
                starts, ends = starts[enough], ends[enough]
                if total is None:
                    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(own), axis=0, dtype=np.int32)])
                for at, end, fingerprint in zip(starts.tolist(), ends.tolist(), packed(total[ends] - total[starts]), strict=True):
                    near = self.within(fingerprint)
                    near = near[self.words[near] == n]
                    mine = np.unique(own[at:end], return_counts=True) if len(near) else None
                    for i in near.tolist():
                        same = weighted_jaccard(mine, self.sets[i])
                        if same >= similarity and same > best.get(i, (0.0,))[0]:
                            best[i] = (same, at, end - at + w - 1)
        return [(i, *best[i]) for i in sorted(best)]


_MASKS: dict[int, np.ndarray] = {}


def neighbourhoods() -> dict[int, np.ndarray]:
    if not _MASKS:
        _MASKS.update({bits: neighbourhood(bits) for _, bits in cuts()})
    return _MASKS


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", width: int = SHINGLE) -> Iterator[Index]:
    """Indexes of bounded size over all items."""
    held, n = [], 0
    for row in benchmark.select(F.col(item_id), F.col(text)).where(F.col(text).isNotNull()).distinct().toLocalIterator():
        if held and (len(held) == INDEX_ITEMS or n + len(row[1]) > INDEX_CHARS):
            yield Index.of(held, width)
            held, n = [], 0
        held.append((row[0], row[1]))
        n += len(row[1])
    if held:
        yield Index.of(held, width)


def marked(docs: DataFrame, index: Index, id_type: T.DataType, text: str, similarity: float, width: int, name: str = FOUND) -> DataFrame:
    """docs with the list of leaks under this name."""
    leak = T.StructType([T.StructField("item_id", id_type), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def start():
        hashes, own = WordHashes(), shared.value

        def work(texts: list) -> list:
            flat, bounds = hashes.of(texts)
            touched = np.zeros(len(texts), bool)
            for w, every in own.every.items():
                runs = shingles(flat, w)
                if len(every) and len(runs):
                    at = np.flatnonzero(every[np.minimum(np.searchsorted(every, runs), len(every) - 1)] == runs)
                    touched[np.searchsorted(bounds, at, "right") - 1] = True
            out: list[list[dict]] = [[] for _ in texts]
            for i in np.flatnonzero(touched):
                out[i] = [{"item_id": own.ids[k], "similarity": s, "start_word": a, "n_words": n} for k, s, a, n in own.leaks(flat[bounds[i] : bounds[i + 1]], similarity, width)]
            return [out]

        return work

    return with_columns(docs, text, [(name, T.ArrayType(leak))], start)


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each item that a document repeats, and its best window there."""
    kind, out = benchmark.schema[item_id].dataType, None
    for index in indexes(benchmark, item_id, item_text, width):
        found = marked(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), index, kind, "text", similarity, width)
        found = found.select("doc_id", F.explode(FOUND).alias("leak")).select("doc_id", "leak.*")
        out = found if out is None else out.unionByName(found)
    if out is None:
        none = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", kind), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())])
        return docs.sparkSession.createDataFrame([], none)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that repeat no item. Nothing is shuffled."""
    columns = docs.columns
    name = free(FOUND, columns)
    for index in indexes(benchmark, item_id, item_text, width):
        docs = marked(docs, index, benchmark.schema[item_id].dataType, text, similarity, width, name).where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in columns])
    return docs
