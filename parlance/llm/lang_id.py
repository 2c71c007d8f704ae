"""Language identification by rank order (Cavnar and Trenkle, 1994).

A profile is the list of a language's K most frequent letter n-grams. A document's own list is compared with each
profile by out-of-place distance: the sum over the document's n-grams of how far the two ranks are apart, or K where the
profile lacks the n-gram. The nearest profile wins.

N-grams have 1 to 3 characters, so that three code points pack exactly into one 63-bit integer: counts are free of hash
collisions. Texts are lower-cased, every run of non-letters becomes one blank, and no n-gram reaches over a blank.

Defined cases: a null text, an empty one and one without a letter are predicted `und` with score 0, as is everything
when nothing was learned. Rows with null language or text teach nothing. Equal counts rank by code point, equal distances
go to the alphabetically first language. Repeated rows count each time. Texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.arrow import free, mapped, slices, with_columns

UNDETERMINED = "und"
PROFILE_SIZE = 300
#: Profiles of so many languages at most go to a task at once, PROFILE_SIZE entries of 16 bytes for each; of more, texts are compared with one lot after another.
LANGUAGES_AT_ONCE = 5_000
#: Code points from here on are no letters (as of Unicode 16).
LETTER_LIMIT = 0x33480
BLANK, SHIFT = 32, np.uint64(21)
#: A task hands on its counts when it holds so many.
HELD_COUNTS = 2_000_000
SALTS = 16


def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(LETTER_LIMIT)), bool, LETTER_LIMIT)


def ngrams(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Packed 1- to 3-grams of a text, in no order; empty if there is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    good = is_letter[np.minimum(points, LETTER_LIMIT - 1)]
    keep = good.copy()
    keep[1:] |= good[:-1]
    squeezed = np.where(good, points, BLANK)[keep].astype(np.uint64)
    if not good.any():
        return np.zeros(0, np.int64)
    lead = [] if squeezed[0] == BLANK else [np.uint64(BLANK)]
    tail = [] if squeezed[-1] == BLANK else [np.uint64(BLANK)]
    c = np.concatenate([np.array(lead, np.uint64), squeezed, np.array(tail, np.uint64)])
    two = (c[:-1] << SHIFT) | c[1:]
    three = (two[:-1] << SHIFT) | c[2:]
    return np.concatenate([c[c != BLANK], two, three[c[1:-1] != BLANK]]).astype(np.int64)


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """languages, sorted; codes, sorted, with entries starts[i]:starts[i + 1] of codes[i]: the language's place and the code's rank there."""

    languages: list[str]
    codes: np.ndarray
    starts: np.ndarray
    owners: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int) -> Profiles:
        """Of (language, code, rank)."""
        languages = sorted({r[0] for r in rows})
        place = {name: i for i, name in enumerate(languages)}
        code, owner, rank = (np.array(x, np.int64) for x in ([r[1] for r in rows], [place[r[0]] for r in rows], [r[2] for r in rows]))
        order = np.lexsort((owner, code))
        codes, first = np.unique(code[order], return_index=True)
        return cls(languages, codes, np.append(first, len(rows)), owner[order].astype(np.int32), rank[order].astype(np.int32), size)

    def lots(self) -> Iterator[Profiles]:
        """Profiles of at most LANGUAGES_AT_ONCE languages each, in order."""
        if len(self.languages) <= LANGUAGES_AT_ONCE:
            yield self
            return
        code = np.repeat(self.codes, np.diff(self.starts))
        for at in range(0, len(self.languages), LANGUAGES_AT_ONCE):
            mine = (self.owners >= at) & (self.owners < at + LANGUAGES_AT_ONCE)
            yield Profiles.of(list(zip([self.languages[i] for i in self.owners[mine]], code[mine].tolist(), self.ranks[mine].tolist(), strict=True)), self.size)

    def nearest(self, top: np.ndarray) -> tuple[str, float]:
        if not len(top) or not self.languages:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[at] == top)
        begin, n = self.starts[at[known]], np.diff(self.starts)[at[known]]
        entry = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        # an n-gram that a profile lacks is `size` out of place
        nearer = self.size - np.abs(self.ranks[entry] - np.repeat(known, n))
        apart = self.size * len(top) - np.bincount(self.owners[entry], nearer, len(self.languages))
        best = int(apart.argmin())
        return self.languages[best], 1.0 - float(apart[best]) / (self.size * len(top))


def count_ngrams(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with text and language; tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        n_held = 0

        def folded(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                codes, counts = folded(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])
            held.clear()

        for part in slices(batches, text):
            fresh: dict[str, list[np.ndarray]] = {}
            for name, words in zip(part.column(lang).to_pylist(), part.column(text).to_pylist(), strict=True):
                fresh.setdefault(name, []).append(ngrams(words, is_letter))
            for name, codes in fresh.items():
                held.setdefault(name, []).append(np.unique(np.concatenate(codes), return_counts=True))
                held[name] = [folded(held[name])]
            n_held = sum(len(p[0][0]) for p in held.values())
            if n_held > HELD_COUNTS:
                yield from out()
        yield from out()

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias(text), F.col(lang).cast("string").alias(lang))
    return mapped(known, run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from all labelled rows. Languages are salted while ranking, so no task holds all n-grams of one."""
    order = [F.col("n").desc(), F.col("gram")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SALTS))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    top = (
        count_ngrams(docs, text, lang)
        .withColumn("at", F.row_number().over(salted)).where(F.col("at") <= size)
        .withColumn("at", F.row_number().over(whole)).where(F.col("at") <= size)
        .select("lang", "gram", (F.col("at") - 1).alias("at"))
    )
    return Profiles.of([(r["lang"], r["gram"], r["at"]) for r in top.toLocalIterator()], size)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text", drop: tuple[str, ...] = (), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score under these names; the other columns stay."""
    lots = list(profiles.lots())
    if len(lots) == 1:
        return told(docs, lots[0], text, drop, names)
    columns = [c for c in docs.columns if c not in (*names, *drop)]
    parts = [(free(f"{names[0]}_{i}", docs.columns), free(f"{names[1]}_{i}", docs.columns)) for i in range(len(lots))]
    for lot, part in zip(lots, parts, strict=True):
        docs = told(docs, lot, text, (), part)
    # the nearest of all, and of equals the first
    best = F.array_min(F.array(*[F.struct((-F.col(s)).alias("apart"), F.lit(i).alias("lot"), F.col(l).alias("lang")) for i, (l, s) in enumerate(parts)]))
    return docs.select(*[F.col(f"`{c}`") for c in columns], best["lang"].alias(names[0]), (-best["apart"]).alias(names[1]))


def told(docs: DataFrame, profiles: Profiles, text: str, drop: tuple[str, ...], names: tuple[str, str]) -> DataFrame:
    def start():
        is_letter = letters()

        def work(texts: list) -> list:
            found = [profiles.nearest(ranked(ngrams(t, is_letter), profiles.size)) if t else (UNDETERMINED, 0.0) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return work

    return with_columns(docs, text, [(names[0], T.StringType()), (names[1], T.DoubleType())], start, drop)


def fold(doc_id: str, of: int = 5) -> Column:
    """crc32 of the id as text, modulo of; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(of))
