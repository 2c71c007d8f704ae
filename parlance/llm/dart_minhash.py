"""Near-duplicate classes by DartMinHash (Christiani, 2020) signatures and banding.

A text is a weighted set: its five-word shingles, each weighted by how often it occurs. Imagine darts thrown at random,
one for each unit of area, on the plane of weight and rank of every possible shingle. Cells of that plane are generated
from hashes of (shingle, cell): a Poisson number of darts, each with a weight, a rank and a coordinate. A text keeps the
darts below its weights, and for each coordinate its earliest dart; two texts have the same dart at a coordinate with the
probability of their weighted Jaccard similarity. Cells of higher rank are drawn only until all coordinates are taken,
so a signature costs time in proportion to the text plus the coordinates, not their product.

Texts that agree in a band of a signature meet in a bucket. Pairs are verified by exact weighted Jaccard similarity, and
classes are the connected components of verified links:

1. Texts of the same words are one from the start, so copies cost nothing further.
2. In each bucket, every text is compared with one member: the one that meets most others in all its buckets, which is
   likely the text that the others were made from.
3. Where a bucket still holds more than one class, further members are compared with those of other classes, until all
   belong together or all pairs between classes have been compared: all at once where that lists at most ROUND_PAIRS
   candidates, else REGROW times as many members each round. Pairs that can't be similar enough, since the elements
   of too many of BINS ranges differ in number or checksum, are left out. No cap cuts this short, and no pair within a class is listed.

With BANDS of ROWS coordinates, a pair of similarity 0.8 is missed with probability 5e-5, one of 0.9 with 4e-10.

Words are lower-cased runs of letters, digits and underscores; a text of fewer than five has one shingle of them all.
Defined cases: null and empty texts and those without a word are near no other, and are each their own class. Rows that
repeat id and text are in the same class, and count as one when one of each class stays. A null doc_id is never the
name of a class that has another. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.arrow import mapped, with_columns
from parlance.llm.components import components, joined_further, salted_join, shuffled
from parlance.llm.storage import saved
from parlance.llm.words import SHINGLE, WordHashes, mixed, shingles_of_text

SIMILARITY = 0.8
BANDS, ROWS = 25, 5
UNIT = 2.0**-53
SEED = np.uint64(0xA0761D6478BD642F)
STEP = np.uint64(0x9E3779B97F4A7C15)
#: How many times more members are compared each round.
REGROW = 16
#: A round takes in as many members as list so many candidates, if that is more.
ROUND_PAIRS = 1 << 26
#: Pairs of one text that are verified together, and members of a bucket that are joined together, about.
PAIRS = 256
#: Elements of a text are counted and summed by so many ranges of their hashes. A text with so many in one range is not judged by them.
BINS, UNCOUNTED = 128, 255
#: Pairs that are looked at at once.
CHUNK = 1 << 15


def edges_of(cell: int) -> tuple[float, float]:
    """Cells of either axis: [0, 1), [1, 2), [2, 4), [4, 8) and so on."""
    return (0.0, 1.0) if cell == 0 else (2.0 ** (cell - 1), 2.0**cell)


@cache
def poisson_cdf(mean: float) -> np.ndarray:
    k = np.arange(int(mean + 12 * math.sqrt(mean) + 30))
    return np.cumsum(np.exp(k * math.log(mean) - mean - np.array([math.lgamma(i + 1) for i in k])))


def signatures(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """n x size earliest darts of n weighted sets; owner: the set of each element, every set has one at least."""
    out, taken = np.zeros((n, size), np.uint64), np.zeros((n, size), bool)
    rank_cell = 0
    while not taken.all():
        low, high = edges_of(rank_cell)
        open_sets = ~taken.all(1)
        mine = open_sets[owner]
        e, x, o = elements[mine], weights[mine], owner[mine]
        found_key, found_rank, found_dart = [], [], []
        weight_cell = 0
        while len(e):
            w_low, w_high = edges_of(weight_cell)
            above = x > w_low
            e, x, o = e[above], x[above], o[above]
            if not len(e):
                break
            seed = mixed(mixed(e ^ SEED) + np.uint64((1 + 64 * rank_cell + weight_cell) * int(STEP) % 2**64))
            thrown = np.searchsorted(poisson_cdf((high - low) * (w_high - w_low)), (seed >> np.uint64(11)) * UNIT, "right")
            which = np.repeat(np.arange(len(e)), thrown)
            number = np.arange(len(which)) - np.repeat(np.cumsum(thrown) - thrown, thrown)
            dart = mixed(seed[which] + (number + 1).astype(np.uint64) * STEP)
            place = mixed(dart ^ SEED)
            weight = w_low + (w_high - w_low) * ((place >> np.uint64(20)) * 2.0**-44)
            ok = weight < x[which]
            dart, place, which = dart[ok], place[ok], which[ok]
            found_rank.append(low + (high - low) * ((mixed(dart + STEP) >> np.uint64(11)) * UNIT))
            found_key.append(o[which] * size + (((place & np.uint64((1 << 20) - 1)) * np.uint64(size)) >> np.uint64(20)).astype(np.int64))
            found_dart.append(dart)
            weight_cell += 1
        key, rank, dart = np.concatenate(found_key), np.concatenate(found_rank), np.concatenate(found_dart)
        order = np.argsort(-rank, kind="stable")
        order = order[~taken.ravel()[key[order]]]
        out.ravel()[key[order]] = dart[order]  # of several for one place the last stays: the earliest dart
        taken.ravel()[key[order]] = True
        rank_cell += 1
    return out


def bands_of(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """n x bands bucket keys, distinct between bands."""
    n = len(signature)
    parts = signature.reshape(n, bands, rows)
    out = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for r in range(rows):
        out = mixed(out * STEP + parts[:, :, r])
    return out.view(np.int64)


def elements_of(found: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: the k-th occurrence of a hash is an element of its own."""
    distinct, counts = np.unique(found, return_counts=True)
    if len(distinct) == len(found):
        return distinct
    again = np.repeat(np.arange(len(distinct)), counts)
    number = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(np.where(number == 0, distinct[again], mixed(distinct[again] + number.astype(np.uint64) * STEP)))


def digests_of(elements: np.ndarray) -> np.ndarray:
    """How many elements are in each range of hashes, and a checksum of them: 2 x BINS."""
    ranges = (elements >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(ranges, minlength=BINS)
    sums = np.bincount(ranges, (elements & np.uint64(255)).astype(np.float64), minlength=BINS).astype(np.int64) % 256
    return np.stack([np.minimum(counts, UNCOUNTED), sums]).astype(np.uint8)


def most_shared(x: np.ndarray, x_size: np.ndarray, y: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """A bound on the elements that two texts share, by their digests (n x 2 x BINS) and sizes: as many in a range but another sum are not all the same."""
    counts, others = x[:, 0], y[:, 0]
    both = np.minimum(counts, others).sum(1, dtype=np.int64) - ((counts == others) & (x[:, 1] != y[:, 1])).sum(1)
    judged = (counts.max(1) < UNCOUNTED) & (others.max(1) < UNCOUNTED)
    return np.where(judged, both, np.minimum(x_size, y_size))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, words_key, bands): fp is the text's digest, words_key its words' digest; no bands without words."""
    fields = [("words_key", T.BinaryType()), ("bands", T.ArrayType(T.LongType()))]

    def start():
        hashes = WordHashes()

        def work(texts: list) -> list:
            flat, bounds = hashes.of(texts)
            sizes = np.diff(bounds)
            some = np.flatnonzero(sizes)
            keys = np.array([None] * len(texts), object)
            bands = np.array([None] * len(texts), object)
            if len(some):
                e, w = zip(*(np.unique(shingles_of_text(flat[bounds[i] : bounds[i + 1]], width), return_counts=True) for i in some), strict=True)
                owner = np.repeat(np.arange(len(some)), [len(x) for x in e])
                made = bands_of(signatures(np.concatenate(e), np.concatenate(w).astype(np.float64), owner, len(some), BANDS * ROWS))
                for k, i in enumerate(some):
                    keys[i] = xxhash.xxh3_128_digest(flat[bounds[i] : bounds[i + 1]].tobytes())
                    bands[i] = made[k]
            return [keys.tolist(), bands.tolist()]

        return work

    source = docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("fp"), F.col(text).alias("text"))
    return with_columns(source, "text", fields, start, drop=("text",))


def digest(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def sets_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """The wanted (doc_id, fp, further columns), with (elements, size, digests) for doc_id and fp. Texts are shuffled once, repeated rows folded before."""
    marks = wanted.select("doc_id", "fp", F.lit(None).cast("string").alias("text"), F.struct(*[c for c in wanted.columns if c not in ("doc_id", "fp")]).alias("mark"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("fp"), F.col(text).alias("text"), F.lit(None).cast(marks.schema["mark"].dataType).alias("mark"))
    found = texts.unionByName(marks).groupBy("doc_id", "fp").agg(F.first("text", ignorenulls=True).alias("text"), F.first("mark", ignorenulls=True).alias("mark"))

    def start():
        hashes = WordHashes()

        def work(rows: list) -> list:
            flat, bounds = hashes.of(rows)
            made = [elements_of(shingles_of_text(flat[a:b], width)) for a, b in zip(bounds, bounds[1:], strict=False)]
            return [[x.tobytes() for x in made], [len(x) for x in made], [digests_of(x).tobytes() for x in made]]

        return work

    return with_columns(found.where("mark is not null").select("mark.*", "text"), "text", [("elements", T.BinaryType()), ("size", T.LongType()), ("digests", T.BinaryType())], start, drop=("text",))


def groups_of(n: str):
    """Into how many groups n rows of one key are dealt."""
    return F.ceil(F.col(n) / PAIRS).cast("int")


def group_of(text: str, n: str):
    """Which of these groups a row is in, by its text."""
    return F.pmod(F.xxhash64(text), groups_of(n)).cast("int")


def spread(pairs: DataFrame, sets: DataFrame, key: str, salt: str, name: str) -> DataFrame:
    """(key, salt, name): the elements of each text of the pairs' column key. A text of many pairs is repeated for each salt of them, and only for those."""
    wanted = pairs.groupBy(key).agg(F.collect_set(salt).alias(salt))
    return wanted.join(shuffled(sets.select(F.col("tid").alias(key), F.col("elements").alias(name))), key).select(key, name, F.explode(salt).alias(salt))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float, *columns: str) -> DataFrame:
    """These columns (long) of the pairs (a, salt_a, right: the elements of b) that are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            ok = [jaccard(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= similarity for x, y in zip(left, right, strict=True)]
            yield batch.select(list(columns)).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(shuffled(spread(pairs, sets, "a", "salt_a", "left")), ["a", "salt_a"])
    return mapped(both.select(*columns, "left", "right"), run, ", ".join(f"{c} long" for c in columns))


def met():
    return F.collect_list(F.struct("bucket", "n", "band")).alias("met")


def unsettled(members: DataFrame) -> DataFrame:
    """(tid, root, met) of the members (tid, root, bucket, n, band) of buckets with several classes; met: these buckets."""
    several = members.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("bucket")
    return salted_join(shuffled(members), several, "bucket", "tid").groupBy("tid").agg(F.first("root").alias("root"), met())


def next_reach(members: DataFrame, reach: int) -> tuple[int, int]:
    """How many members of each bucket are compared after this round, and the size of the largest bucket."""
    powers = [2**k for k in range(4, 48)]
    most, *candidates = members.select(F.inline("met")).agg(F.max("n"), *[F.sum(F.least("n", F.lit(p))) for p in powers]).first()
    fit = [p for p, found in zip(powers, candidates, strict=True) if found is not None and found <= ROUND_PAIRS]
    return max([REGROW, REGROW * reach, *fit]), most or 0


class Side:
    """Members of one bucket as arrays."""

    def __init__(self, rows: pa.Table, empty: int):
        self.tid, self.root, self.size, self.draw = (rows.column(c).to_numpy() for c in ("tid", "root", "size", "draw"))
        lists = rows.column("bands").combine_chunks()
        found = lists.flatten()
        self.bands = np.full((len(self.tid), BANDS), empty, np.int64)
        self.bands[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), found.field("band").to_numpy()] = found.field("bucket").to_numpy()
        self.digests = np.frombuffer(b"".join(rows.column("digests").to_pylist()), np.uint8).reshape(-1, 2, BINS)


def between(members: DataFrame, before: int, reach: int, similarity: float) -> DataFrame:
    """Pairs (a, b, root_a, root_b, salt_a, salt_b) of different classes in which the first one's draw, times its bucket's size, is from before to under reach.

    A pair is listed when the first of the two is chosen, in the first bucket that both are in.
    """
    draw = F.pmod(F.xxhash64("tid"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = members.select("tid", "root", "size", "digests", "bands", draw.alias("draw"), F.inline("met")).drop("band")
    chosen = rows.where((F.col("draw") * F.col("n") < reach) & (F.col("draw") * F.col("n") >= before))
    # columns of its own, since both sides of a cogroup may not share any
    chosen = chosen.select(*[F.col(c).alias(c) for c in chosen.columns], F.explode(F.sequence(F.lit(0), groups_of("n") - 1)).alias("part"))
    rows = rows.withColumn("part", group_of("tid", "n"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = [np.zeros((5, 0), np.int64)]
        if left.num_rows and right.num_rows:
            bucket, n = left.column("bucket")[0].as_py(), left.column("n")[0].as_py()
            x, y = Side(left, 0), Side(right, 1)
            for at in range(0, len(y.tid), max(1, 32 * CHUNK // len(x.tid))):
                to = slice(at, at + max(1, 32 * CHUNK // len(x.tid)))
                first = (y.draw[to] < x.draw[:, None]) | ((y.draw[to] == x.draw[:, None]) & (y.tid[to] < x.tid[:, None]))
                alike = np.minimum(y.size[to], x.size[:, None]) >= similarity * np.maximum(y.size[to], x.size[:, None]) - 1e-9
                every_i, every_j = np.nonzero(first & alike & (y.root[to] != x.root[:, None]))
                for k in range(0, len(every_i), CHUNK):
                    i, j = every_i[k : k + CHUNK], every_j[k : k + CHUNK] + at
                    same = x.bands[i] == y.bands[j]
                    once = x.bands[i, same.argmax(1)] == bucket
                    i, j = i[once], j[once]
                    both = most_shared(x.digests[i], x.size[i], y.digests[j], y.size[j])
                    can = both >= similarity * (x.size[i] + y.size[j] - both) - 1e-9
                    i, j = i[can], j[can]
                    made.append(np.stack([y.tid[j], x.tid[i], y.root[j], x.root[i], np.full(len(i), n)]))
        return pa.table(dict(zip(("a", "b", "root_a", "root_b", "n"), np.concatenate(made, 1), strict=True)))

    pairs = rows.groupBy("bucket", "part").cogroup(chosen.groupBy("bucket", "part")).applyInArrow(run, "a long, b long, root_a long, root_b long, n long")
    return pairs.select("a", "b", "root_a", "root_b", group_of("b", "n").alias("salt_a"), group_of("a", "n").alias("salt_b"))


def classed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, class_key) for each row; rows without words have a null class_key."""
    rows = saved(signed(docs, doc_id, text, width), "signed")
    some = rows.where(F.col("words_key").isNotNull())
    texts = some.groupBy("words_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "bands")).alias("m"))
    texts = saved(texts.select("words_key", "m.doc_id", "m.fp", "m.bands").withColumn("tid", F.monotonically_increasing_id()), "texts")

    buckets = texts.select("tid", F.posexplode("bands").alias("band", "bucket"))
    heads = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = saved(salted_join(shuffled(buckets), heads, "bucket", "tid").groupBy("tid").agg(met(), F.sum("n").alias("meets")), "buckets")
    each = shared.select("tid", "meets", F.inline("met"))
    hubs = each.groupBy("bucket").agg(F.max(F.struct("meets", "tid")).alias("h")).select("bucket", F.struct(F.col("h.tid").alias("tid"), F.col("h.meets").alias("meets")).alias("hub"))
    wanted = salted_join(shuffled(each.drop("meets")), hubs, "bucket", "tid").groupBy("tid").agg(met(), F.collect_set("hub").alias("hubs"))
    sets = saved(sets_of(docs, texts.select("tid", "doc_id", "fp").join(shuffled(wanted), "tid"), doc_id, text, width), "sets")

    pairs = sets.select(F.col("tid").alias("b"), F.col("elements").alias("right"), F.inline("hubs")).where("tid <> b")
    links = saved(verified(pairs.select(F.col("tid").alias("a"), "b", group_of("b", "meets").alias("salt_a"), "right"), sets, similarity, "a", "b"), "links")
    first = components(links).withColumnRenamed("node", "tid")
    roots = saved(sets.select("tid").join(shuffled(first), "tid", "left").select(F.col("tid").alias("node"), F.coalesce("root", "tid").alias("root")), "labels")

    # members of buckets with several classes, of which not all pairs between classes have been compared
    classes = lambda: shuffled(roots.withColumnRenamed("node", "tid"))
    members = unsettled(sets.select("tid", F.inline("met")).where("n > 2").join(classes(), "tid"))
    members = saved(members.withColumn("bands", F.col("met")).join(shuffled(sets.select("tid", "size", "digests")), "tid"), "unsettled")
    before, (reach, most) = 0, next_reach(members, 0)
    while most > 0:
        fresh = saved(between(members, before, reach, similarity), "pairs")
        if not fresh.isEmpty():
            ends = fresh.join(shuffled(spread(fresh, sets, "b", "salt_b", "right")), ["b", "salt_b"])
            more = saved(verified(ends, sets, similarity, "root_a", "root_b"), "links")
            if not more.isEmpty():
                roots = joined_further(roots, more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        if reach >= most:
            break
        left = unsettled(members.select("tid", F.inline("met")).where(F.col("n") > reach).join(classes(), "tid"))
        members = saved(left.join(shuffled(members.drop("root", "met")), "tid"), "unsettled")
        before, (reach, most) = reach, next_reach(members, reach)
    joined = texts.select("words_key", "tid").join(classes(), "tid", "left")
    named = joined.select("words_key", F.coalesce("root", "tid").alias("class_key"))
    return rows.select("doc_id", "fp", "words_key").join(shuffled(named), "words_key", "left").select("doc_id", "fp", "class_key")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(doc_id, class_id) for each row; a class is named by its smallest doc_id."""
    rows = saved(classed(docs, doc_id, text, similarity, width), "classed")
    # saved, so that a large class's rows aren't held together by the aggregate's shuffle
    names = saved(rows.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "names")
    return rows.join(shuffled(names), "class_key", "left").select("doc_id", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """The rows of docs with the smallest doc_id of their class, each once; rows without words all stay."""
    rows = saved(classed(docs, doc_id, text, similarity, width), "classed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("m")
    kept = rows.where(F.col("class_key").isNotNull()).groupBy("class_key").agg(first).select("m.doc_id", "m.fp")
    kept = kept.union(rows.where(F.col("class_key").isNull()).select("doc_id", "fp").distinct())
    kept = kept.select(F.col("doc_id").alias("id"), F.col("fp").alias("fp"))
    # one shuffle of the rows, which are one column each, so that no name can clash
    whole = docs.select(F.col(doc_id).alias("id"), digest(text).alias("fp"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(False).alias("kept"))
    marks = kept.select("id", "fp", F.lit(None).cast(whole.schema["row"].dataType).alias("row"), F.lit(True).alias("kept"))
    found = whole.unionByName(marks).groupBy("id", "fp").agg(F.first("row", ignorenulls=True).alias("row"), F.bool_or("kept").alias("kept"))
    return found.where("kept").select("row.*")
