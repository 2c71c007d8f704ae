"""Language-model scores by class-based n-grams (Brown et al., 1992), classes by the exchange algorithm.

Tokens are the runs of characters other than blanks (A to Z in lower case), and one end after each text. A token's class
follows the class of the token before, the first one that of an end:

    P(w | v) = P(C(w) | C(v)) * P(w | C(w))
    P(D | C) = (n(C, D) + 0.5) / (n(C) + 0.5 * classes)
    P(w | C) = (n(w) + 0.5) / (n(C) + 0.5 * (types(C) + 1))

so each class has room for one unknown word. Every word of the training corpus gets its class by its own contexts, which
are the bigrams that it is in, over the whole training corpus; the end is class 0, alone. Words go in two groups, the
frequent ones first, as is usual since the others' contexts are mostly frequent words:

1. The dictionary: the most frequent words, as many as a task may hold (DICTIONARY). Their bigrams are added up by Spark
   and kept as one row of neighbours a word. The SEEDS first of them are exchanged one by one in the driver, from at most
   SEEDS squared bigrams; then all words of the dictionary are, in passes: tasks know all words' classes and the table of
   class bigrams, give each word the class that raises the likelihood most, and see the moves that they made themselves.
   Other tasks' moves show in the next pass. A pass that doesn't raise the likelihood is taken back and is the last.
2. All other words, however many. Their contexts are counted by class of the neighbour where that is a dictionary word;
   pairs of two others are joined to the neighbour's class. They are moved in passes in the same way.

A word that isn't in the training corpus has the class that most of the words seen once with its ending (UNKNOWNS
digests of the last two bytes) have: the mass of each class for unknown words is the same, only the class is guessed.

Words that are longer than LONGEST bytes stand in all tables as a 128-bit digest. Texts are cut into words twice: to count
them, and, when the dictionary is known, to write them as codes, from which pairs, contexts and scores are taken. Dictionary
words are scored where the text is; all others, however few or many, are joined by word, and a row number that was written
with them brings them back.

Defined cases: a null or empty text is one end. Repeated rows count and are scored each by itself. A null id counts as
the empty text when folds are drawn. Without any training text all counts are 0. Texts are read whole. Words of equal
count are ordered by their bytes. Columns of docs with the names of results are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.arrow import free, gathered, mapped, slices, with_columns
from parlance.llm.storage import dropped, saved

END = b""
CLASSES = 64
#: Words that the driver exchanges first, to start the classes with.
SEEDS = 512
#: Passes over the dictionary and over all other words, at most.
PASSES, MORE_PASSES = 4, 2
#: Bound of what every task holds: words. Longer words stand as digests.
DICTIONARY, LONGEST = 250_000, 64
#: Kinds of endings by which the class of an unknown word is guessed.
UNKNOWNS = 512
#: A task hands on its counts when it holds so many words, and its pairs when it holds so many.
HELD_WORDS, HELD_PAIRS = 1_000_000, 2_000_000
#: Pairs of words meet in GRID x GRID buckets, by which no frequent word's pairs come to one task.
GRID = 64
#: Counts whose rises are taken for all words at once.
SMALL = (1, 2, 3, 4)
#: Words that are moved at once, when a task has moved four times as many.
AT_ONCE = 512
COUNT = (1 << 56) - 1


def kept(word: bytes) -> bytes:
    """The word, or its digest after a blank, which no word has."""
    return word if len(word) <= LONGEST else b" " + xxhash.xxh3_128_digest(word)


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words as tables have them, the end first; the place in these of each token; tokens of each text, its end included)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    found = lists.flatten().dictionary_encode()
    words, at = pa.concat_arrays([pa.array([END]), found.dictionary.cast(pa.binary())]), found.indices.to_numpy() + 1
    row = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy())
    blank = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)[1:]  # what stands before a leading blank and after a trailing one
    if len(blank):
        row, at = row[at != blank[0]], at[at != blank[0]]
    sizes = np.bincount(row, minlength=len(texts)) + 1
    places = np.zeros(len(at) + len(texts), np.int64)
    places[np.arange(len(at)) + row] = at
    long = pc.greater(pc.binary_length(words), LONGEST)
    if pc.any(long).as_py():
        words = pc.replace_with_mask(words, long, pa.array(map(kept, words.filter(long).to_pylist()), pa.binary()))
    return words, places, sizes


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def added() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for part in gathered(slices(batches, text), text):
            words, places, _ = tokens(part.column(text))
            n = pa.array(np.bincount(places, minlength=len(words)))
            there = pc.greater(n, 0)
            held.append(pa.table({"word": words.filter(there), "n": n.filter(there)}))
            n_held += len(held[-1])
            if n_held > HELD_WORDS:
                held = [added()]
                n_held = len(held[0])
                if n_held > HELD_WORDS // 2:
                    yield from held.pop().to_batches()
                    n_held = 0
        if held:
            yield from added().to_batches()

    return mapped(docs.select(text), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def often(counts: DataFrame, most: int | None = None) -> dict[bytes, int]:
    """The end, then the words of the largest counts by count and bytes: as many whole steps of an eighth of a power of two as fit."""
    most = DICTIONARY if most is None else most
    step = F.floor(F.log2("n") * 8)
    held, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["step"]):
        held += r["n"]
        if held > most:
            break
        least = r["step"]
    found = counts.where((step >= least if least is not None else F.lit(False)) | (F.octet_length("word") == 0)).toArrow()
    n = dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist(), strict=True))
    return {END: n.pop(END, 0)} | dict(sorted(n.items(), key=lambda x: (-x[1], x[0])))


CODED = [("__codes", T.BinaryType()), ("__lengths", T.BinaryType()), ("__others", T.BinaryType())]


def coded(docs: DataFrame, places: dict[bytes, int], text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with the codes of each text's tokens: 32-bit places in the dictionary, or -1; of the words that aren't in it, the lengths (a byte each) and bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(pa.array(places, pa.binary()))

    def start():
        def work(texts: pa.Array) -> list[pa.Array]:
            words, at, sizes = tokens(texts)
            codes = pc.fill_null(pc.index_in(words, shared.value), -1).to_numpy().astype("<i4")[at]
            ends = np.append(0, np.cumsum(sizes))
            missed = np.flatnonzero(codes < 0)
            others = words.take(pa.array(at[missed]))
            lengths = pc.binary_length(others).to_numpy().astype(np.uint8)
            cuts = np.searchsorted(missed, ends)
            starts = np.append(0, np.cumsum(lengths, dtype=np.int64))
            return [binaries(ends * 4, codes), binaries(cuts, lengths), binaries(starts[cuts], np.frombuffer(joined_bytes(others), np.uint8))]

        return work

    return with_columns(docs, text, CODED, start, drop, arrow=True)


def joined_bytes(column: pa.Array) -> memoryview:
    """The bytes of all values in a row, of which none is null."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else [0, 0]
    return memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]


def codes_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes of all texts' tokens in a row, tokens of each text, those words in a row that aren't in the dictionary)."""
    codes = np.frombuffer(joined_bytes(part.column("__codes")), "<i4")
    lengths = np.frombuffer(joined_bytes(part.column("__lengths")), np.uint8)
    others = binaries(np.append(0, np.cumsum(lengths, dtype=np.int64)), np.frombuffer(joined_bytes(part.column("__others")), np.uint8))
    return codes, pc.binary_length(part.column("__codes")).to_numpy() // 4, others


def packed(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending pairs and their counts."""
    return pa.compress(np.concatenate([[len(pairs)], np.diff(pairs, prepend=0), n]).astype("<i8").tobytes(), "lz4_raw", asbytes=True)


def unpacked(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(pa.decompress(blob, (1 + 2 * size) * 8, "lz4_raw", asbytes=True), "<i8")
    return np.cumsum(x[1 : 1 + size]), x[1 + size :]


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


PACKED = "bucket int, size int, pairs binary"


def dealt(bucket: np.ndarray, pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of PACKED, one for each bucket."""
    order = np.lexsort((pairs, bucket))
    bucket, pairs, n = bucket[order], pairs[order], n[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    blobs = [packed(pairs[a:b], n[a:b]) for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), pa.array((ends - starts).astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "size", "pairs"])


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Each bucket's pairs and their counts, added up; rows of a bucket come one after another."""
    at, held, n_held = None, [], 0
    for batch in batches:
        for bucket, size, blob in zip(batch.column("bucket").to_pylist(), batch.column("size").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
            if bucket != at:
                if held:
                    yield at, summed(held)
                at, held, n_held = bucket, [], 0
            held.append(unpacked(blob, size))
            n_held += size
            if n_held > HELD_PAIRS and len(held) > 1:
                held = [summed(held)]
                n_held = 0
    if held:
        yield at, summed(held)


def neighbours(docs: DataFrame, places: dict[bytes, int], text: str = "text") -> DataFrame:
    """(code, keys, n): for each word of the dictionary the ones after it (their codes) and before it (their codes + the dictionary's size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(x)) for x, sizes in (numbers(batch, "keys"), numbers(batch, "n"))]
            yield pa.RecordBatch.from_arrays([batch.column("code"), *lists], names=["code", "keys", "n"])

    return mapped(packed_neighbours(coded(docs.select(text), places, text, (text,)), len(places)), run, "code int, keys array<int>, n array<long>")


def numbers(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all rows, how many a row has) of keys or n, which are arrays or their bytes."""
    column, kind = batch.column(name), np.dtype("<i4" if name == "keys" else "<i8")
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(), column.value_lengths().to_numpy(zero_copy_only=False)
    return np.frombuffer(joined_bytes(column), kind), pc.binary_length(column).to_numpy() // kind.itemsize


def packed_neighbours(found: DataFrame, size: int) -> DataFrame:
    """The rows of neighbours() from codes; keys and n are bytes of 32-bit and 64-bit integers."""

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def out() -> pa.RecordBatch:
            pairs, n = summed(held)
            held.clear()
            return dealt((pairs // size % GRID) * GRID + pairs % size % GRID, pairs, n)

        for part in gathered(slices(batches, "__codes"), "__codes"):
            second = codes_of(part)[0].astype(np.int64)
            first = np.append(0, second[:-1])  # each text ends with an end, which is where the next one starts
            both = (first >= 0) & (second >= 0)
            held.append(np.unique(first[both] * size + second[both], return_counts=True))
            n_held += len(held[-1][0])
            if n_held > HELD_PAIRS:
                yield out()
                n_held = 0
        if n_held:
            yield out()

    def sides_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def out() -> pa.RecordBatch:
            pairs, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            first, second = pairs // size, pairs % size
            code = np.concatenate([first, second])
            return dealt(code % (GRID * GRID), code * (2 * size) + np.concatenate([second, first + size]), np.concatenate([n, n]))

        for _, found in by_bucket(batches):
            held.append(found)
            n_held += len(found[0])
            if n_held > HELD_PAIRS:
                yield out()
                n_held = 0
        if held:
            yield out()

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (pairs, n) in by_bucket(batches):
            code = pairs // (2 * size)
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            offsets = np.append(starts, len(code))
            lists = [binaries(offsets * 4, (pairs % (2 * size)).astype("<i4")), binaries(offsets * 8, n.astype("<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array(code[starts].astype(np.int32)), *lists], names=["code", "keys", "n"])

    found = mapped(found.select("__codes", "__lengths", "__others"), pairs_of, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    found = mapped(found, sides_of, PACKED).repartition("bucket").sortWithinPartitions("bucket")
    return mapped(found, rows_of, "code int, keys binary, n binary")


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def nonzero(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a table, which is slower."""
    return np.divmod(np.flatnonzero(table), table.shape[1])


def rise(base: np.ndarray, x: np.ndarray) -> np.ndarray:
    """xlogx(base + x) - xlogx(base), of numbers of any size without loss of digits."""
    base = np.maximum(base, np.float32(1e-6))
    return base * np.log1p(x / base) + x * np.log(base + x)


def likelihood(both: np.ndarray) -> float:
    return float(xlogx(both).sum() - xlogx(both.sum(0)).sum() - xlogx(both.sum(1)).sum())


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int | None = None) -> np.ndarray:
    """The class of each unit, by moving units to where they raise the class bigrams' likelihood most. The end stays in class 0, alone."""
    n_units = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    order = [u for u in np.argsort(-weight, kind="stable").tolist() if u and weight[u] > 0]
    of = np.zeros(n_units, np.int64)
    of[1:] = 1 + np.arange(n_units - 1) % (classes - 1)
    for i, u in enumerate(order):
        of[u] = 1 + i % (classes - 1)
    member = np.zeros((n_units, classes))
    member[np.arange(n_units), of] = 1
    b = bigrams.astype(np.float64)
    to, back = b @ member, b.T @ member
    both = member.T @ to
    for _ in range(PASSES if passes is None else passes):
        moved = 0
        for u in order:
            a, own, right, left = of[u], b[u, u], to[u].copy(), back[u].copy()
            # what u has with itself counts apart: it isn't in right or left from here on
            right[a] -= own
            left[a] -= own
            both[a] -= right
            both[:, a] -= left
            both[a, a] -= own
            rows, columns = both.sum(1) + left, both.sum(0) + right  # tokens of each class, u's left out
            gain = (xlogx(both + right) - xlogx(both)).sum(1) + (xlogx(both + left[:, None]) - xlogx(both)).sum(0)
            diagonal = np.diag(both)
            gain += xlogx(diagonal + right + left + own) - xlogx(diagonal + right) - xlogx(diagonal + left) + xlogx(diagonal)
            r, c = right.sum() + own, left.sum() + own
            gain -= xlogx(rows + r) - xlogx(rows) + xlogx(columns + c) - xlogx(columns)
            gain[0] = -np.inf
            best = int(gain.argmax())
            if gain[best] <= gain[a] + 1e-9:
                best = a
            both[best] += right
            both[:, best] += left
            both[best, best] += own
            if best != a:
                moved += 1
                of[u] = best
                to[:, a] -= b[:, u]
                to[:, best] += b[:, u]
                back[:, a] -= b[u]
                back[:, best] += b[u]
        if not moved:
            break
    return of


def best_classes(of: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, both: np.ndarray) -> np.ndarray:
    """The class of each word that the likelihood of the class bigrams is highest with, all other words staying where they are.

    right and left: (words, classes) counts of the classes after and before; own: of the word after itself, not in them.
    A word of class -1 is in none yet, and its bigrams aren't in both.
    """
    m, every, there = len(of), np.arange(len(of)), of >= 0
    placed, at = every[there], of[there]
    both = both.astype(np.float32)
    right, left, own = (x.astype(np.float32) for x in (right, left, own))
    gain = np.zeros(right.shape, np.float32)
    for mine, theirs, table in ((right, left, both), (left, right, both.T)):
        # most counts are small, and so have the same rises for all words
        for x in SMALL:
            gain += (mine == x).astype(np.float32) @ rise(table.T, np.float32(x))
        word, d = nonzero(mine > SMALL[-1])
        if len(word):
            x = mine[word, d]
            sizes, size = np.unique(x, return_inverse=True)
            kinds, kind = np.unique(d * len(sizes) + size, return_inverse=True)
            starts = np.flatnonzero(np.diff(word, prepend=-1))
            gain[word[starts]] += np.add.reduceat(rise(table.T[kinds // len(sizes)], sizes[kinds % len(sizes)][:, None])[kind], starts)
        # a word that is in a class is left out of the table
        word, d = nonzero((mine > 0) & there[:, None])
        x, at_home = mine[word, d], d == of[word]
        same, rest = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        base = table[of[word[rest]], d[rest]]
        np.add.at(gain, (word[rest], of[word[rest]]), rise(base - x[rest], x[rest]) - rise(base, x[rest]))
        base, w, c, x = table.T[d[same]], word[same], d[same], x[same]
        apart = base - theirs[w]
        apart[np.arange(len(w)), c] -= x + own[w]
        gain[w] += rise(apart, x[:, None]) - rise(base, x[:, None])
        tokens_of, new = table.sum(1), mine.sum(1) + own
        sizes, size = np.unique(new, return_inverse=True)
        less = rise(tokens_of[None], sizes[:, None])[size]
        less[placed, at] = rise(tokens_of[at] - new[there], new[there])
        word, d = nonzero((theirs > 0) & ~there[:, None])
        less[word, d] = rise(tokens_of[d] + theirs[word, d], new[word])
        gain -= less
    diagonal = np.repeat(np.diag(both)[None], m, axis=0)
    diagonal[placed, at] -= right[placed, at] + left[placed, at] + own[there]
    word, d = nonzero((right > 0) & (left > 0) | (own > 0)[:, None])
    here, r, back = diagonal[word, d], right[word, d], left[word, d]
    gain[word, d] += rise(here, r + back + own[word]) - rise(here, r) - rise(here, back)
    gain[:, 0] = -np.inf
    best = gain.argmax(1)
    return np.where(~there | (gain[every, best] > gain[every, of] + 1e-4), best, of)


def moves(of: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray, both: np.ndarray, done: int) -> np.ndarray:
    """The classes of words moved one group after another; both follows the moves. done: how many were moved before."""
    of, at = of.copy(), 0
    while at < len(of):
        some = slice(at, at + min(max(done // 4, 1), AT_ONCE))
        best = best_classes(of[some], right[some], left[some], own[some], both)
        moved = np.flatnonzero(best != of[some])
        was, now = of[some][moved], best[moved]
        member = (now[:, None] == np.arange(len(both))).astype(float) - (was[:, None] == np.arange(len(both)))
        both += member.T @ right[some][moved] + left[some][moved].T @ member
        for c, sign in ((was, -1), (now, 1)):
            np.add.at(both, (c[c >= 0], c[c >= 0]), sign * own[some][moved][c >= 0])
        of[some] = best
        at, done = at + len(best), done + len(best)
    return of


def beside(batch: pa.RecordBatch, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(right, left, own) of the rows of neighbours: counts of the classes after and before, and of the word after itself."""
    m, size = batch.num_rows, len(of)
    (key, sizes), (n, _) = numbers(batch, "keys"), numbers(batch, "n")
    row = np.repeat(np.arange(m), sizes)
    other = key % size
    mine = other == batch.column("code").to_numpy()[row]
    own = np.bincount(row, np.where(mine & (key < size), n, 0), m)
    there = ~mine & (of[other] >= 0)
    at = row * (2 * classes) + (key >= size) * classes + of[other]
    counts = np.bincount(at[there], n[there], m * 2 * classes).reshape(m, 2 * classes)
    return counts[:, :classes], counts[:, classes:], own


def exchange_dictionary(seen: DataFrame, size: int, classes: int = CLASSES, passes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(class of each word of the dictionary, their class bigrams), from the rows of neighbours."""
    context, passes = seen.sparkSession.sparkContext, PASSES if passes is None else passes
    seeds = min(SEEDS + 1, size)

    def among_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (key, sizes), (n, _) = numbers(batch, "keys"), numbers(batch, "n")
            code = np.repeat(batch.column("code").to_numpy(), sizes)
            ok = (code < seeds) & (key < seeds)
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (code, key, n)], names=["first", "second", "n"])

    def table_of(of: np.ndarray) -> np.ndarray:
        shared = context.broadcast(of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both = np.zeros((classes, classes))
            for batch in batches:
                mine = shared.value[batch.column("code").to_numpy()]
                right, _, own = beside(batch, shared.value, classes)
                there = mine >= 0
                np.add.at(both, mine[there], right[there])
                np.add.at(both, (mine[there], mine[there]), own[there])
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(both)), pa.array(both[both > 0])], names=["cell", "n"])

        return cells(mapped(seen, run, "cell long, n double"), classes)

    def moved(of: np.ndarray, both: np.ndarray) -> np.ndarray:
        shared = context.broadcast((of, both))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, table, done = shared.value[0].copy(), shared.value[1].copy(), 0
            for batch in batches:
                rest = batch.filter(pa.array(batch.column("code").to_numpy() > 0))  # the end stays
                if rest.num_rows:
                    code = rest.column("code").to_numpy()
                    now[code] = moves(now[code], *beside(rest, now, classes), table, done)
                    done += len(code)
                    yield pa.RecordBatch.from_arrays([rest.column("code"), pa.array(now[code].astype(np.int32))], names=["code", "class"])

        found = mapped(seen, run, "code int, class int").toArrow()
        out = of.copy()
        out[found.column("code").to_numpy()] = found.column("class").to_numpy()
        return out

    few = mapped(seen.where(F.col("code") < seeds), among_seeds, "first int, second int, n long").toArrow()
    bigrams = np.zeros((seeds, seeds))
    bigrams[few.column("first").to_numpy(), few.column("second").to_numpy()] = few.column("n").to_numpy()
    of = np.full(size, -1)
    of[:seeds] = exchange(bigrams, classes)
    both = table_of(of)
    for k in range(passes if size > seeds else 0):
        new = moved(of, both)
        table = table_of(new)
        if k and likelihood(table) <= likelihood(both):  # the first pass brings words in
            break
        of, both = new, table
    return of, both


def count_contexts(found: DataFrame, of: np.ndarray, classes: int) -> DataFrame:
    """(word, other, seen), from codes, of the words that aren't in the dictionary; seen lists slots and counts, as slot << 56 | n in one binary.

    Where other is null, a slot is the class of a dictionary word after it, or classes + that of one before. Each word has
    such a row, be it an empty one. Else other is such a word too, which stands after it (slot 0) or before it (slot classes).
    """
    shared, size = found.sparkSession.sparkContext.broadcast(of), len(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of, own = shared.value, {}
        held, pairs, n_held = [], [], 0

        def out() -> pa.RecordBatch:
            names = pa.array(own, pa.binary())
            found, n = summed(held) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            word, slot = found // (2 * classes), found % (2 * classes)
            offsets = np.searchsorted(word, np.arange(len(names) + 1)) * 8
            rows = [(names, pa.nulls(len(names), pa.binary()), binaries(offsets, ((slot << 56) | n).astype("<i8")))]
            if pairs:
                both, n = summed(pairs)
                first, second = both >> 32, both & 0xFFFFFFFF
                at = np.arange(len(both) + 1) * 8
                rows.append((names.take(pa.array(first)), names.take(pa.array(second)), binaries(at, n.astype("<i8"))))
                rows.append((names.take(pa.array(second)), names.take(pa.array(first)), binaries(at, ((classes << 56) | n).astype("<i8"))))
            made = pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*rows, strict=True)], names=["word", "other", "seen"])
            for x in (own, held, pairs):
                x.clear()
            return made

        for part in gathered(slices(batches, "__codes"), "__codes"):
            code, _, others = codes_of(part)
            names = others.dictionary_encode()
            here = np.array([own.setdefault(w, size + len(own)) for w in names.dictionary.to_numpy(zero_copy_only=False)], np.int64)
            second = code.astype(np.int64)
            second[code < 0] = here[names.indices.to_numpy()]
            first = np.append(0, second[:-1])
            a, b = first >= size, second >= size
            after, before = a & ~b, b & ~a
            slots = np.concatenate([(first[after] - size) * 2 * classes + class_of[second[after]], (second[before] - size) * 2 * classes + classes + class_of[first[before]]])
            for to, found in ((held, slots), (pairs, ((first[a & b] - size) << 32) | (second[a & b] - size))):
                if len(found):
                    to.append(np.unique(found, return_counts=True))
                    n_held += len(to[-1][0])
            if n_held > HELD_PAIRS:
                yield out()
                n_held = 0
        if own:
            yield out()

    seen = mapped(found.select("__codes", "__lengths", "__others"), run, "word binary, other binary, seen binary")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last word's rows, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            starts = [0, *(np.flatnonzero(changes(rest.column("word")) | changes(rest.column("other"))) + 1).tolist()]
            if len(starts) > 1:
                yield listed(rest.slice(0, starts[-1]), starts[:-1])
                rest = rest.slice(starts[-1])
        if rest is not None:
            yield listed(rest, [0])

    # a task has most words once, so nothing is gained by adding up before the shuffle
    return mapped(seen.repartition("word", "other").sortWithinPartitions("word", "other"), lists, "word binary, other binary, seen array<binary>")


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another one than that before it, null being a value."""
    there, value = column.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(column, b"")
    return (there[1:] != there[:-1]) | pc.not_equal(value[1:], value[:-1]).to_numpy(zero_copy_only=False)


def listed(rows: pa.RecordBatch, starts: list[int]) -> pa.RecordBatch:
    """(word, other, seen) of the rows that begin at starts, seen a list."""
    first, offsets = rows.take(pa.array(starts)), pa.array([*starts, rows.num_rows], pa.int32())
    return pa.RecordBatch.from_arrays([first.column("word"), first.column("other"), pa.ListArray.from_arrays(offsets, rows.column("seen"))], names=["word", "other", "seen"])


def nothing() -> Column:
    return F.array().cast("array<binary>")


def binaries(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """The bytes of the values, cut at the offsets."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def slots_of(batch: pa.RecordBatch, name: str, classes: int) -> np.ndarray:
    """(rows, 2 * classes) counts of a column of lists of binaries."""
    lists, m = batch.column(name), batch.num_rows
    parts = lists.flatten()
    row = np.repeat(np.arange(m), lists.value_lengths().to_numpy(zero_copy_only=False))
    size = pc.binary_length(parts).to_numpy(zero_copy_only=False) // 8
    x = np.frombuffer(joined_bytes(parts), "<i8")
    return np.bincount(np.repeat(row, size) * (2 * classes) + (x >> 56), x & COUNT, m * 2 * classes).reshape(m, 2 * classes)


def move(rows: DataFrame, both: np.ndarray) -> DataFrame:
    """(word, class) of rows of (word, class, seen, more) after a pass; class -1: in none yet. A word without neighbours gets one by its digest."""
    shared, classes = rows.sparkSession.sparkContext.broadcast(both), len(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, done = shared.value.copy(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = slots_of(batch, "seen", classes) + slots_of(batch, "more", classes)
            new = moves(batch.column("class").to_numpy().astype(np.int64), counts[:, :classes], counts[:, classes:], np.zeros(batch.num_rows), table, done)
            done += len(new)
            for i in np.flatnonzero(counts.sum(1) == 0):
                new[i] = 1 + zlib.crc32(batch.column("word")[int(i)].as_py()) % (classes - 1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(new.astype(np.int32))], names=["word", "class"])

    return mapped(rows, run, "word binary, class int")


def in_contexts(contexts: DataFrame, of: DataFrame, classes: int) -> DataFrame:
    """(word, class, seen, more): more lists the neighbours that aren't in the dictionary, by their classes in of."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(joined_bytes(batch.column("seen")), "<i8")
            x = x + (batch.column("other_class").to_numpy().astype(np.int64) << 56)
            yield pa.RecordBatch.from_arrays([batch.column("word"), binaries(np.arange(len(x) + 1) * 8, x.astype("<i8"))], names=["word", "seen"])

    pairs = contexts.where("other is not null").select("word", "other", F.explode("seen").alias("seen"))
    joined = pairs.join(of.select(F.col("word").alias("other"), F.col("class").alias("other_class")), "other").select("word", "seen", "other_class")
    more = mapped(joined, slots, "word binary, seen binary").groupBy("word").agg(F.collect_list("seen").alias("more"))
    rows = contexts.where("other is null").select("word", "seen").join(of, "word").join(more, "word", "left")
    return rows.select("word", "class", "seen", F.coalesce("more", nothing()).alias("more"))


def table_with(rows: DataFrame, both: np.ndarray) -> np.ndarray:
    """The class bigrams of all words: those of the dictionary's, and those that the words of rows are in."""
    classes = len(both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, classes))
        for batch in batches:
            of, seen, more = batch.column("class").to_numpy(), slots_of(batch, "seen", classes), slots_of(batch, "more", classes)
            np.add.at(total, of, seen[:, :classes] + more[:, :classes])
            np.add.at(total.T, of, seen[:, classes:])  # pairs of two of these words are counted where the first one is
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["cell", "n"])

    return both + cells(mapped(rows, run, "cell long, n double"), classes)


def cells(found: DataFrame, classes: int) -> np.ndarray:
    """The (classes, classes) table of (cell, n)."""
    out = np.zeros(classes * classes)
    for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(classes, classes)


def occurring(rows: DataFrame, classes: int) -> DataFrame:
    """(word, n, class): a word occurs as often as it has a word or end before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (slots_of(batch, "seen", classes) + slots_of(batch, "more", classes))[:, classes:].sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(n.astype(np.int64)), batch.column("class")], names=["word", "n", "class"])

    return mapped(rows, run, "word binary, n long, class int")


def exchange_others(contexts: DataFrame, both: np.ndarray, passes: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """((word, class, seen, more) of the words that aren't in the dictionary, class bigrams of all words). both: those of the dictionary's."""
    classes, passes, best = len(both), MORE_PASSES if passes is None else passes, None
    of = saved(move(contexts.where("other is null").select("word", F.lit(-1).alias("class"), "seen", nothing().alias("more")), both), "word-classes")
    for k in range(passes):
        rows = saved(in_contexts(contexts, of, classes), "in-contexts")
        dropped(of)
        table = table_with(rows, both)
        if best is not None and likelihood(table) <= likelihood(best[1]):
            dropped(rows)
            break
        if best is not None:
            dropped(best[0])
        best = rows, table
        if k + 1 < passes:
            of = saved(move(rows, table), "word-classes")
    return best


def ending(word: str) -> Column:
    return (F.crc32(F.substring(word, -2, 2)) % UNKNOWNS).cast("int")


@dataclass
class Model:
    """counts: (word, n, class) of all words. dictionary: the words that tasks hold, and their counts; word_class: their classes.

    unknown: the class guessed by ending; by class: transitions and emission norms, as log10.
    """

    counts: DataFrame
    total: int
    types: int
    dictionary: dict[bytes, int]
    word_class: dict[bytes, int]
    unknown: list[int]
    transitions: np.ndarray
    norms: np.ndarray


def vocabulary(docs: DataFrame, text: str) -> tuple[int, int, dict[bytes, int]]:
    """(tokens, distinct ones, dictionary) of all texts."""
    counts = saved(count_words(docs, text), "word-counts")
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    dictionary = often(counts)
    dropped(counts)
    return total, types, dictionary


def places_of(dictionary: dict[bytes, int]) -> dict[bytes, int]:
    return {w: i for i, w in enumerate(dictionary)}


def fit(docs: DataFrame, text: str = "text", classes: int = CLASSES) -> Model:
    """The model of all texts of docs."""
    words = vocabulary(docs, text)
    found = saved(coded(docs.select(text), places_of(words[2]), text, (text,)), "codes")
    model = fit_codes(found, *words, classes)
    dropped(found)
    return model


def fit_codes(codes: DataFrame, total: int, types: int, dictionary: dict[bytes, int], classes: int = CLASSES) -> Model:
    """The model of the texts that codes are of."""
    seen = saved(packed_neighbours(codes, len(dictionary)), "neighbours")
    of, both = exchange_dictionary(seen, len(dictionary), classes)
    dropped(seen)
    found = codes.sparkSession.createDataFrame(pa.table({"word": pa.array(dictionary, pa.binary()), "n": pa.array(dictionary.values(), pa.int64()), "class": pa.array(of.astype(np.int32))}))
    if types > len(dictionary):
        contexts = saved(count_contexts(codes, of, classes), "contexts")
        rows, both = exchange_others(contexts, both)
        found = saved(found.unionByName(occurring(rows, classes)), "word-classes")
        dropped(contexts)
        dropped(rows)
    tokens, kinds = np.zeros(classes), np.zeros(classes)
    for r in found.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect():
        tokens[r["class"]], kinds[r["class"]] = r["n"], r["types"]
    once = np.zeros((UNKNOWNS, classes), np.int64)
    for r in found.where((F.col("n") == 1) & (F.col("class") > 0)).groupBy(ending("word").alias("ending"), "class").agg(F.count(F.lit(1)).alias("n")).collect():
        once[r["ending"], r["class"]] = r["n"]
    unknown = np.where(once.any(1), once.argmax(1), 1 + once[:, 1:].sum(0).argmax())
    transitions = np.log10(both + 0.5) - np.log10(both.sum(1, keepdims=True) + 0.5 * classes)
    word_class = dict(zip(dictionary, of.tolist(), strict=True))
    return Model(found, total, types, dictionary, word_class, unknown.tolist(), transitions, np.log10(tokens + 0.5 * (kinds + 1)))


def of_joined(rows: DataFrame, model: Model) -> DataFrame:
    """(__row, __more, __more_known, __more_transitions, __more_norms) of rows with __placed, the joined words' (place, n, class).

    A place is position << 16 | class before + 2 << 8 | class after + 2: -1 where the neighbour is joined too, -2 where there is none.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.transitions, model.norms))
    names = ["__row", "__more", "__more_known", "__more_transitions", "__more_norms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, norms = shared.value
        for batch in batches:
            placed, m = batch.column("__placed"), batch.num_rows
            if not m:
                continue
            row = np.repeat(np.arange(m), placed.value_lengths().to_numpy(zero_copy_only=False))
            place, n, own = (placed.flatten().field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            order = np.lexsort((place, row))
            row, place, n, own = row[order], place[order], n[order], own[order]
            before, after = ((place >> 8) & 0xFF) - 2, (place & 0xFF) - 2
            before = np.where(before < 0, np.concatenate([[0], own[:-1]]), before)
            x = transitions[before, own] + np.where(after >= 0, transitions[own, np.maximum(after, 0)], 0.0)
            starts = np.flatnonzero(np.diff(row, prepend=-1))  # each row has a joined word; reduceat adds pairwise, which long texts need
            added = [np.add.reduceat(v, starts) for v in (np.log10(n + 0.5), (n > 0).astype(np.int64), x, norms[own])]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), *map(pa.array, added)], names=names)

    return mapped(rows, run, "__row long, __more double, __more_known long, __more_transitions double, __more_norms double")


MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def scored(docs: DataFrame, model: Model, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score; the other columns stay."""
    return scored_codes(coded(docs.drop(*MADE), places_of(model.dictionary), text, drop), model)


def fit_and_scored(docs: DataFrame, learned: Column, text: str = "text", drop: tuple[str, ...] = (), classes: int = CLASSES) -> DataFrame:
    """scored(docs) by the model of the rows that learned is true of; each text is coded once."""
    words = vocabulary(docs.where(learned), text)
    others = docs.drop(*MADE)
    flag = free("__learned", others.columns)
    found = saved(coded(others.withColumn(flag, F.coalesce(learned, F.lit(False))), places_of(words[2]), text, drop), "codes")
    out = scored_codes(found.drop(flag), fit_codes(found.where(flag), *words, classes))
    dropped(found)
    return out


def scored_codes(docs: DataFrame, model: Model) -> DataFrame:
    """scored() of docs with their codes, which go."""
    dictionary = model.dictionary
    counts = np.array(list(dictionary.values()), np.int64)
    class_at = np.array([*(model.word_class[w] for w in dictionary), -1], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast((counts, class_at, model.transitions, model.norms))
    fields = [
        ("__row", T.LongType()), ("__tokens", T.LongType()), ("__known", T.LongType()), ("__logs", T.DoubleType()), ("__transitions", T.DoubleType()), ("__norms", T.DoubleType()),
        ("__words", T.ArrayType(T.BinaryType())), ("__places", T.ArrayType(T.LongType())),
    ]

    keep = [c for c in docs.columns if c not in {name for name, _ in CODED + fields}]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, class_at, transitions, norms = shared.value
        logs, known = np.append(np.log10(counts + 0.5), 0.0), np.append(counts > 0, False)
        row = TaskContext.get().partitionId() << 33
        for part in slices(batches, "__codes"):
            at, sizes, others = codes_of(part)
            sizes = sizes.astype(np.int64)
            joined = np.flatnonzero(at < 0)
            second = class_at[at]
            starts = np.cumsum(sizes) - sizes
            first = np.concatenate([[0], second[:-1]])
            first[starts] = 0
            after = np.append(second[1:], 0)
            after[starts + sizes - 1] = -2
            added = lambda x: np.add.reduceat(x, starts)  # noqa: E731, B023
            both = (first >= 0) & (second >= 0)
            cuts = np.searchsorted(joined, np.append(starts, len(at))).astype(np.int32)
            position = joined - np.repeat(starts, np.diff(cuts))
            place = (position << 16) | ((first[joined] + 2) << 8) | (after[joined] + 2)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (others, pa.array(place))]
            rows = np.arange(row, row + part.num_rows)
            row += part.num_rows
            made = (rows, sizes, added(known[at].astype(np.int64)), added(logs[at]), added(np.where(both, transitions[first, second], 0.0)), added(np.where(second >= 0, norms[second], 0.0)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *map(pa.array, made), *lists], names=schema.names)

    local = saved(mapped(docs, run, schema), "scores")
    joined = local.select("__row", F.explode(F.arrays_zip(F.col("__words").alias("word"), F.col("__places").alias("place"))).alias("w")).select("__row", "w.*").join(model.counts, "word", "left")
    guessed = F.get(F.array(*map(F.lit, model.unknown)), ending("word"))
    one = F.struct("place", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("class", F.when(F.octet_length("word") == 0, 0).otherwise(guessed)).alias("class"))
    back = of_joined(joined.groupBy("__row").agg(F.collect_list(one).alias("__placed")), model)
    more = lambda c: F.coalesce(c, F.lit(0.0))
    logs = F.col("__logs") + more("__more")
    every = float(np.log10(model.total + 0.5 * (model.types + 1)))
    return local.drop("__words", "__places").join(back, "__row", "left").select(
        *keep, F.col("__tokens").alias("n_tokens"), (F.col("__known") + F.coalesce("__more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (logs - F.col("__tokens") * every).alias("base_score"), (logs + F.col("__transitions") + more("__more_transitions") - F.col("__norms") - more("__more_norms")).alias("score"),
    )
