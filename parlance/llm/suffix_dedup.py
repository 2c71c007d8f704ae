"""Repeated passages by suffix arrays: every byte of a string of LENGTH bytes that also starts earlier is removed.

Equal strings must meet in one task. Each string of LENGTH bytes is named by the least hash of the GRAM-byte strings in it,
which depends on its bytes alone; neighbouring strings mostly share the name, so a text becomes runs of starts, some 35 each.
Runs whose name comes from a gram that occurs once in the corpus can't repeat. The others are cut from their texts as slices, equal slices are folded
to their earliest place before and after a shuffle, and slices are dealt by name into parts of about PART_BYTES. A name with more
than HOT different slices, as the edges of a line that all documents have, is taken apart: its slices become single strings,
folded again, and dealt by their own digest.

In a part the suffixes of the slices are sorted in two stages: those smaller than the suffix one byte on are sorted directly, by
104 bytes; all others follow by a scan of the buckets of first bytes in ascending order, since such a suffix comes after its
successor and in the order of successors. Adjacent suffixes with a common prefix of LENGTH bytes or more are one class, and the
earliest start of a class is its first. What a document has to remove are the starts of its runs that aren't firsts.

No task holds more than a slice of rows, one text, one part or one document's runs; no group is as large as a hot key.

Defined cases: texts are compared as UTF-8 bytes and whole; null texts count as empty. Documents come in order of id, null ids last, those of
an equal id in order of a 64-bit digest of their texts. Rows that repeat both id and text are one document and get the same
result. Texts under LENGTH bytes stay as they are. Other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.arrow import mapped, release, slices
from parlance.llm.components import salted_join
from parlance.llm.storage import dropped, saved

LENGTH, GRAM = 100, 32
#: Grams of a string; a run of one gram's name has so many starts at most, and longer ones (of repeated bytes) are cut.
GRAMS = LENGTH - GRAM + 1
#: Suffixes are sorted by so many bytes, a multiple of 8 over LENGTH.
DEPTH = 104
PART_BYTES = 4_000_000
HOT = 4_096
#: Starts of one text that are hashed at once.
AT_ONCE = 2_000_000
COMPARED_AT_ONCE = 200_000


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams of data, and for each start of LENGTH bytes the least hash of the grams in them."""
    if len(data) < LENGTH:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = data.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        m = 1
        while m < GRAM:  # the hash of 2m bytes from those of m
            h = h[:-m] * np.uint64(0xC2B2AE3D27D4EB4F) + h[m:]
            h ^= h >> np.uint64(29)
            m *= 2
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    least, m = h, 1
    while 2 * m <= GRAMS:
        least = np.minimum(least[:-m], least[m:])
        m *= 2
    rest = GRAMS - m
    return h, np.minimum(least[:-rest], least[rest:]) if rest else least


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, starts, name, grams) of the runs in texts that lie one after another in data, up to ends; grams: 2 if the named gram occurs more than once in the run."""
    grams, name = names(data)
    text = np.searchsorted(ends, np.arange(len(name)), "right")
    at = np.flatnonzero(np.arange(len(name)) + LENGTH <= ends[text]) if len(name) else np.zeros(0, np.int64)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    name, text = name[at], text[at]
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at)))
    pieces = -(-sizes // GRAMS)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        left = np.repeat(sizes, pieces) - nth * GRAMS
        first, sizes = np.repeat(first, pieces) + nth * GRAMS, np.minimum(left, GRAMS)
    # the first gram so named of the run's first string, and the last one of its last string
    windows, last = sliding_window_view(grams, GRAMS), first + sizes - 1
    once = at[first] + windows[at[first]].argmin(1) == at[last] + GRAMS - 1 - windows[at[last], ::-1].argmin(1)
    begin = np.concatenate([[0], ends[:-1]])
    return text[first], at[first] - begin[text[first]], sizes, name[first], np.where(once, 1, 2)


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column in a row, and where each value ends."""
    column = pa.concat_arrays([column.fill_null("" if pa.types.is_string(column.type) else b"")])
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets[1:] - offsets[0]).astype(np.int64)


def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, ends = binary(batch.column("text"))
        for at in range(0, max(len(data), 1), AT_ONCE) if batch.num_rows == 1 else [0]:  # a slice of several texts is short
            part = data[at : at + AT_ONCE + LENGTH - 1] if batch.num_rows == 1 else data
            text, start, n, name, grams = runs_of(part, np.minimum(ends - at, len(part)))
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("digest").take(rows), pa.array(name.view(np.int64)), pa.array((start + at).astype(np.int32)), pa.array(n.astype(np.int16)), pa.array(grams.astype(np.int16))], names=["id", "digest", "name", "start", "n", "grams"])


def to_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        data, ends = binary(batch.column("text"))
        runs = batch.column("runs")
        counts, flat = runs.value_lengths().to_numpy(zero_copy_only=False), runs.flatten()
        doc = np.repeat(np.arange(batch.num_rows), counts)
        start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
        begin = np.concatenate([[0], ends[:-1]])[doc] + start
        raw, size = data.tobytes(), n + LENGTH - 1
        cut = [raw[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist(), strict=True)]
        rows = pa.array(doc)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(rows), batch.column("digest").take(rows), flat.field("name"), flat.field("start"), flat.field("many"), pa.array(cut, pa.binary())], names=["id", "digest", "name", "start", "many", "slice"])


def suffix_array(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Starts of all strings of LENGTH bytes in slices that lie one after another in data, in the order of the suffixes there."""
    count = len(ends)
    sizes = np.diff(np.concatenate([[0], ends]))
    base = np.concatenate([[0], ends[:-1]]) + np.arange(count)  # where slices begin, each followed by an end mark
    slice_of = np.repeat(np.arange(count), sizes)
    text = np.zeros(len(data) + count, np.int16)  # 0 marks an end, bytes are one more than they were
    text[np.arange(len(data)) + slice_of] = data.astype(np.int16) + 1
    n = len(text)
    # a suffix is smaller than its successor if the first byte that differs from the next is smaller than that
    step = np.append(np.diff(text), 1)
    differ = np.flatnonzero(step)
    smaller = step[differ[np.searchsorted(differ, np.arange(n))]] > 0
    stops = np.flatnonzero(smaller)
    # of a slice, all starts are wanted, and what follows the last one up to a suffix that is sorted directly
    last = base + sizes - LENGTH
    wanted = np.zeros(n + 1, np.int64)
    np.add.at(wanted, base, 1)
    np.add.at(wanted, stops[np.searchsorted(stops, last)] + 1, -1)
    wanted = np.cumsum(wanted[:-1]) > 0
    direct = np.flatnonzero(wanted & smaller)
    marks, direct = direct[text[direct] == 0], direct[text[direct] > 0]
    # stage one: by DEPTH bytes, none of them beyond the end of the slice
    padded = np.zeros(n + DEPTH, np.uint8)
    padded[:n] = np.maximum(text - 1, 0)
    keys = sliding_window_view(padded, DEPTH)[direct]
    end_of = (base + sizes)[np.searchsorted(base, direct, "right") - 1]
    short = np.flatnonzero(direct + DEPTH > end_of)
    keys[short] = np.where(np.arange(DEPTH) < (end_of[short] - direct[short])[:, None], keys[short], 0)
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{DEPTH}").ravel(), kind="stable")]
    del keys
    # stage two: bucket by bucket
    by_first = np.split(direct, np.searchsorted(text[direct], np.arange(1, 258)))
    by_first[0] = marks
    waiting: list[list[np.ndarray]] = [[] for _ in range(258)]
    larger = wanted & ~smaller
    found = []

    def induce(done: np.ndarray, bucket: int) -> np.ndarray:
        """Put the predecessors of sorted suffixes into their buckets; those of this bucket are returned."""
        found.append(done)
        before = done[done > 0] - 1
        before = before[larger[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        own = before[:0]
        for some in np.split(before, cuts):
            if len(some):
                if text[some[0]] == bucket:
                    own = some
                else:
                    waiting[text[some[0]]].append(some)
        return own

    for bucket in range(257):
        now = np.concatenate(waiting[bucket]) if waiting[bucket] else direct[:0]
        waiting[bucket] = []
        while len(now):
            now = induce(now, bucket)
        if len(by_first[bucket]):
            induce(by_first[bucket], bucket)
    order = np.concatenate(found)
    at = np.searchsorted(base, order, "right") - 1
    return (order - at)[order <= last[at]]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each start and the one before it, LENGTH at most; 0 for the first."""
    windows, out = sliding_window_view(data, LENGTH), np.zeros(len(order), np.int16)
    for at in range(1, len(order), COMPARED_AT_ONCE):
        some = windows[order[at - 1 : at + COMPARED_AT_ONCE]]
        unlike = some[1:] != some[:-1]
        out[at : at + COMPARED_AT_ONCE] = np.where(unlike.any(1), unlike.argmax(1), LENGTH)
    return out


def firsts_in(part: pa.Table) -> pa.Table:
    """(id, digest, start, n): the runs of starts whose string starts nowhere earlier, of a part's rows (late, id, digest, start, slice)."""
    part = part.sort_by([(c, "ascending") for c in ("late", "id", "digest", "start")]).combine_chunks()
    data, ends = binary(part.column("slice").combine_chunks() if part.num_rows else pa.array([], pa.binary()))
    order = suffix_array(data, ends)
    same = np.cumsum(common_prefixes(data, order) < LENGTH)
    row = np.searchsorted(ends, order, "right")
    begin = np.concatenate([[0], ends[:-1]])
    start = part.column("start").to_numpy().astype(np.int64)[row] + order - begin[row]
    # rows are in the order of places, so a document's are neighbours
    id_, late, digest = (part.column(c).combine_chunks() for c in ("id", "late", "digest"))
    i, d, l = id_.fill_null(0).to_numpy(), digest.to_numpy(), late.to_numpy(zero_copy_only=False)  # noqa: E741
    document = np.cumsum(np.concatenate([[True], (i[1:] != i[:-1]) | (d[1:] != d[:-1]) | (l[1:] != l[:-1])]))[row]
    sort = np.lexsort((start, document, same))
    first = np.sort(order[sort[np.concatenate([[True], np.diff(same[sort]) > 0])]])
    row = np.searchsorted(ends, first, "right")
    new = np.concatenate([[True], (np.diff(first) != 1) | (np.diff(row) != 0)])
    at = np.flatnonzero(new)
    rows = pa.array(row[at])
    start = part.column("start").to_numpy().astype(np.int64)[row[at]] + first[at] - begin[row[at]]
    out = pa.table({"id": id_.take(rows), "digest": digest.take(rows), "start": pa.array(start.astype(np.int32)), "n": pa.array(np.diff(np.append(at, len(first))).astype(np.int16))})
    release()
    return out


def covered(size: int, runs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs of bytes in strings of LENGTH that start in runs but not in firsts; both are rows (start, n)."""
    edge = np.zeros(size + 1, np.int64)
    for sign, some in ((1, runs), (-1, firsts)):
        np.add.at(edge, some[:, 0], sign)
        np.add.at(edge, some.sum(1), -sign)
    starts = np.flatnonzero(np.cumsum(edge) > 0)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > LENGTH)
    return np.stack([starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + LENGTH], 1)


def to_kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def table(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten()
        return np.concatenate([[0], np.cumsum(sizes)]), np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n")], 1)

    for batch in slices(batches, "text"):
        data, ends = binary(batch.column("text"))
        (runs_at, runs), (firsts_at, firsts) = table(batch.column("runs")), table(batch.column("firsts"))
        kept, spans, begin = [], [], 0
        for i, end in enumerate(ends.tolist()):
            found = covered(end - begin, runs[runs_at[i] : runs_at[i + 1]], firsts[firsts_at[i] : firsts_at[i + 1]]) if runs_at[i + 1] > runs_at[i] else ()
            mine, at, stay = data[begin:end], 0, []
            for a, b in found:
                stay.append(mine[at:a].tobytes())
                at = b
            kept.append(b"".join([*stay, mine[at:].tobytes()]))
            spans.append([{"start": a, "end": b} for a, b in found])
            begin = end
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(np.concatenate([[0], ends]))), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, spans, kept) of every row: bytes of its text, removed runs of them, and the bytes that stay."""
    whole = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("digest"))
    long_enough = whole.where(F.octet_length("text") >= LENGTH)
    runs = saved(mapped(long_enough, to_runs, "id long, digest long, name long, start int, n short, grams short"), "runs")
    repeated = runs.groupBy("name").agg(F.sum("grams").alias("n_grams")).where("n_grams > 1").select("name", (F.col("n_grams") > HOT).alias("many"))
    held = salted_join(runs, repeated, "name", "id").groupBy("id", "digest").agg(F.collect_set(F.struct("start", "n", "name", "many")).alias("runs"))
    held = saved(held, "held")
    dropped(runs)
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["digest"] == b["digest"])
    cut = mapped(long_enough.join(held, same(long_enough, held)).select(long_enough["id"], "text", long_enough["digest"], "runs"), to_slices, "id long, digest long, name long, start int, many boolean, slice binary")
    place = F.min(F.struct(F.col("id").isNull().alias("late"), "id", "digest", "start")).alias("place")
    folded = saved(cut.groupBy("name", "many", "slice").agg(place), "slices")
    parted = saved(in_parts(folded).groupBy("part").applyInArrow(firsts_in, "id long, digest long, start int, n short"), "firsts")
    dropped(folded)
    firsts = parted.groupBy("id", "digest").agg(F.collect_list(F.struct("start", "n")).alias("firsts"))
    spans = held.join(firsts, same(held, firsts), "left").select(held["id"], held["digest"], F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["n"].alias("n"))).alias("runs"), "firsts")
    every = whole.join(spans, same(whole, spans), "left").select(whole["id"], "text", "runs", "firsts")
    return mapped(every, to_kept, "id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary")


def in_parts(folded: DataFrame) -> DataFrame:
    """Rows (part, late, id, digest, start, slice) of the slices, those of hot names as single strings."""
    row = lambda df, key: df.select(F.xxhash64(key).alias("key"), "place.*", "slice")
    many = folded.where("many")
    hot = many.groupBy("name").agg(F.count("*").alias("n_slices")).where(F.col("n_slices") > HOT).select("name", F.lit(True).alias("hot"))
    told = salted_join(many, hot, "name", "slice", how="left")
    single = told.where("hot").select("place", "slice", F.explode(F.sequence(F.lit(0), F.octet_length("slice") - LENGTH)).alias("at"))
    string = F.substring(F.col("slice"), F.col("at") + 1, F.lit(LENGTH)).alias("slice")
    moved = F.struct("place.late", "place.id", "place.digest", (F.col("place.start") + F.col("at")).alias("start"))
    single = single.select(string, moved.alias("place")).groupBy("slice").agg(F.min("place").alias("place"))
    every = row(folded.where(~F.col("many")), "name").unionByName(row(told.where("hot IS NULL"), "name")).unionByName(row(single, "slice"))
    total = folded.agg(F.sum(F.octet_length("slice"))).first()[0] or 0
    return every.withColumn("part", F.pmod("key", F.lit(-(-total // PART_BYTES) or 1)).cast("int")).drop("key")
