"""Token ids as Simple-8b words (Anh and Moffat, 2010) in ordered shards.

A word has a 4-bit selector on top of 60 bits that hold so many ids of so many bits each. Selector 0 is an escape: the
next word is one raw value of 2**60 or more, whose top bits are not 0, so a decoder tells words apart without reading in
order. Ids are coded in blocks of a fixed number; the offset of each block's first word is kept, so blocks decode alone.

The file format is a Parquet table of segments: shard and segment (their order is the order of the ids), first (ids before it in the shard), n_ids, doc_ids,
doc_lengths, block_size, block_offsets (the last one is the number of words) and words (little-endian, binary). Spark's
own writer commits it, so a lost executor leaves no half-written shard, and any store that Spark writes to will do.

Documents go in ascending doc_id order (null first), equal ids by text, or shuffled by a seed. Each ends with end_id, so a null or empty text
has that one id. Repeated rows are each written. Texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain, islice, repeat
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.arrow import mapped, slices
from parlance.llm.token_counts import byte_characters

#: Fixed values of the format: (ids, bits of each) by selector.
SELECTORS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in SELECTORS], np.int64)
TOP = np.uint64(60)
BLOCK = 8192
#: Words and chunks whose ids a task keeps, about 150 bytes for each.
KEPT_WORDS, KEPT_CHUNKS = 500_000, 600_000
SIMPLE = re.compile(r"([^\W\d_]+)([^\w\s]*)")


def encode_block(values: np.ndarray) -> np.ndarray:
    """Words of one block of non-negative integers below 2**64; the longest fitting selector is taken each time."""
    n = len(values)
    v = np.concatenate([values.astype(np.uint64), np.zeros(120, np.uint64)])
    bits = np.where(v >> TOP > 0, 64, np.minimum(np.frexp(v.astype(np.float64))[1], 60)).astype(np.uint8)
    choice = np.zeros(n, np.uint8)
    for s in range(len(SELECTORS) - 1, 0, -1):
        count, width = SELECTORS[s]
        fits = bits <= width
        if np.count_nonzero(fits[:n]) < min(count, n):
            continue
        reach = 1
        while reach < count:  # fits[i]: so do the next ones, reach in all
            more = min(reach, count - reach)
            fits = fits[: len(fits) - more] & fits[more:]
            reach += more
        choice[fits[:n]] = s
    step = COUNTS[choice].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    first = np.array(starts, np.int64)
    picked = choice[first] if n else choice
    place = np.concatenate([[0], np.cumsum(1 + (picked == 0))]).astype(np.int64)
    words = np.zeros(place[-1], np.uint64)
    for s in np.unique(picked):
        mine, (count, width) = picked == s, SELECTORS[s]
        if s == 0:
            words[place[:-1][mine] + 1] = v[first[mine]]
            continue
        parts = v[first[mine][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(width))
        words[place[:-1][mine]] = np.bitwise_or.reduce(parts, axis=1) | (np.uint64(s) << TOP)
    return words


def decode_words(words: np.ndarray, n: int) -> np.ndarray:
    """The first n values of a run of words that starts at a block."""
    selector = (words >> TOP).astype(np.int64)
    escape = selector == 0
    raw = np.concatenate([[False], escape[:-1]])
    count = np.where(raw, 0, COUNTS[selector])
    to = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
    out = np.zeros(max(int(to[-1]), n), np.uint64)
    for s in np.unique(selector[~raw]):
        mine = np.flatnonzero(~raw & (selector == s))
        k, width = SELECTORS[s]
        if s == 0:
            out[to[mine]] = words[mine + 1]
        elif width:
            shift = np.arange(k, dtype=np.uint64) * np.uint64(width)
            out[(to[mine][:, None] + np.arange(k)).ravel()] = ((words[mine][:, None] >> shift) & np.uint64((1 << width) - 1)).ravel()
    return out[:n]


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offset of each block's first word and the end)."""
    parts = [encode_block(values[i : i + block]) for i in range(0, len(values), block)]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK, first: int = 0, last: int | None = None) -> np.ndarray:
    """Values first to last (exclusive; all by default); only the blocks that hold them are decoded."""
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint64)
    b, e = first // block, (last - 1) // block
    parts = [decode_words(words[offsets[i] : offsets[i + 1]], min(block, n - i * block)) for i in range(b, e + 1)]
    return np.concatenate(parts)[first - b * block : last - b * block]


def trim(kept: dict, most: int) -> None:
    """Forget the older half of what is kept."""
    if len(kept) > most:
        for key in list(islice(kept, most // 2)):
            del kept[key]


#: What a tokenizer's file says of its steps where chunks of a text can be encoded apart.
APART = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def cuts_apart(tokenizer_json: str) -> bool:
    """Whether the ids of a text are those of its blank-free chunks in a row, and of a chunk those of its letters and its signs."""
    spec = json.loads(tokenizer_json)
    added = [t["content"] for t in spec.get("added_tokens") or []]
    return all(spec.get(k) == v for k, v in APART.items()) and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and all(len(a.split()) == 1 and not a.isalpha() for a in added)


class ChunkIds(dict):
    """Ids of blank-free chunks of a text, as little-endian 32-bit integers.

    Where the tokenizer's patterns never match across white space, a text's ids are those of its chunks in a row, and
    a chunk met before needs no second encoding. Most chunks are a word of letters, perhaps with punctuation after it;
    the tokenizer then cuts there, so word and punctuation are looked up apart, the word in lower case. By another file's steps texts
    are encoded whole.
    """

    def __init__(self, tokenizer_json: str, apart: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.apart = Tokenizer.from_str(tokenizer_json), cuts_apart(tokenizer_json) if apart is None else apart
        self.words: dict[str, bytes] = {}
        self.bytes = str.maketrans({chr(b): c for b, c in byte_characters().items()})

    def word(self, word: str) -> bytes:
        """Ids of a lower-case word of letters: one piece of the pre-tokenizer, in its characters for bytes."""
        ids = self.words.get(word)
        if ids is None:
            spelled = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.bytes)
            ids = self.words[word] = array("I", [t.id for t in self.tokenizer.model.tokenize(spelled)]).tobytes()
        return ids

    def whole(self, text: str) -> bytes:
        """Ids by all of the tokenizer's steps."""
        ids = self.words.get(text)
        if ids is None:
            ids = self.words[text] = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        s = chunk.decode("utf-8")
        found = SIMPLE.fullmatch(s)
        word = found[1].lower() if found else ""
        if word.isalpha() and (s.isascii() or ("Σ" not in s and is_normalized("NFC", s))):
            ids = self.word(word) + self.whole(found[2]) if found[2] else self.word(word)
        else:
            ids = self.whole(s)
        self[chunk] = ids
        return ids

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text, which is given in UTF-8."""
        if not self.apart:
            return [array("I", self.tokenizer.encode(t.decode("utf-8"), add_special_tokens=False).ids).tobytes() if t else b"" for t in texts]
        trim(self.words, KEPT_WORDS)
        trim(self, KEPT_CHUNKS)
        return [b"".join(map(self.__getitem__, t.split())) if t else b"" for t in texts]

    def encode_column(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with end_id after it; how many each has). A chunk is looked up once a column."""
        if not self.apart:
            coded = self.encode(texts.cast(pa.binary()).to_pylist())
            end = array("I", [end_id]).tobytes()
            return np.frombuffer(b"".join(chain.from_iterable(zip(coded, repeat(end), strict=False))), "<u4"), np.array([len(x) // 4 + 1 for x in coded], np.int64)
        trim(self.words, KEPT_WORDS)
        trim(self, KEPT_CHUNKS)
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        found = lists.flatten().dictionary_encode()
        coded = [array("I", [end_id]).tobytes(), *map(self.__getitem__, found.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat, starts = np.frombuffer(b"".join(coded), "<u4"), np.cumsum(sizes) - sizes
        n_chunks = lists.value_lengths().to_numpy()
        at = np.zeros(len(found) + len(texts), np.int64)  # 0: the end
        at[np.arange(len(found)) + np.repeat(np.arange(len(texts)), n_chunks)] = found.indices.to_numpy() + 1
        n = sizes[at]
        to = np.cumsum(n)
        values = flat[np.repeat(starts[at] - to + n, n) + np.arange(to[-1] if len(to) else 0)]
        return values, np.diff(to[np.cumsum(n_chunks + 1) - 1], prepend=0)


def segments(doc_id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("shard", T.IntegerType()), T.StructField("segment", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(doc_id_type)), T.StructField("doc_lengths", T.ArrayType(T.LongType())),
        T.StructField("block_size", T.IntegerType()), T.StructField("block_offsets", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()),
    ])


def write_ids(docs: DataFrame, path: str, tokenizer_json: str, end_id: int, doc_id: str = "doc_id", text: str = "text", seed: int | None = None) -> None:
    """Encode all texts in order and write the segments to path.

    With a seed the order is that of digests of seed, doc_id and the row's own number: shuffled, repeated rows apart. It
    is the same in each try of a task, as long as docs is read from the same files.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = segments(docs.schema[doc_id].dataType)
    apart = cuts_apart(tokenizer_json)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        ids = ChunkIds(shared.value, apart)
        out, shard = to_arrow_schema(schema), TaskContext.get().partitionId()
        first = 0
        for i, part in enumerate(slices(batches, "text")):
            values, lengths = ids.encode_column(part.column("text"), end_id)
            words, offsets = encode(values)
            row = [shard, i, first, len(values), part.column("doc_id").to_pylist(), lengths.tolist(), BLOCK, offsets.tolist(), words.astype("<u8").tobytes()]
            first += len(values)
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], names=out.names)

    # The order of equal ids is by text; ranges are cut before the texts are encoded, so each is encoded once.
    ordered = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("tie", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    if seed is None:
        ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    else:
        ordered = ordered.withColumn("tie", F.xxhash64(F.lit(seed), "doc_id", F.monotonically_increasing_id())).repartitionByRange("tie").sortWithinPartitions("tie", "doc_id").drop("tie")
    mapped(ordered, run, schema).write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments.

    start counts the ids of all documents before. The driver holds one number for each shard, as many as there were
    writing tasks.
    """
    found = spark.read.parquet(path)
    totals = sorted((r["shard"], r["n"]) for r in found.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, at = {}, 0
    for shard, n in totals:
        base[shard], at = at, at + n
    schema = T.StructType([T.StructField("doc_id", found.schema["doc_ids"].dataType.elementType)] + [T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                words = np.frombuffer(row["words"].as_buffer(), "<u8").astype(np.uint64)
                ids = decode(words, row["block_offsets"].values.to_numpy(), row["n_ids"].as_py(), row["block_size"].as_py()).astype("<u4")
                lengths = row["doc_lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                starts = base[row["shard"].as_py()] + row["first"].as_py() + ends - lengths
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], names=schema.names)

    return mapped(found, run, schema)
