"""Suffix-array dedup, hard negatives and vector codes against brute force."""

import hashlib
import random

import numpy as np
import pytest

from parlance.llm import hard_negatives, suffix_dedup, vector_codes


def slices_of(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(97, 97 + rng.integers(1, 26), 400).astype(np.uint8)
    base[200:330] = base[200]  # one byte for longer than a string
    out = []
    for _ in range(25):
        at, n = rng.integers(0, 250), 100 + rng.integers(0, 50)
        x = base[at : at + n].copy()
        if rng.random() < 0.5:
            x[rng.integers(0, len(x))] = rng.integers(0, 255)
        out.append(x)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array(seed):
    found = slices_of(seed)
    data, ends = np.concatenate(found), np.cumsum([len(x) for x in found])
    order = suffix_dedup.suffix_array(data, ends)
    begin = ends - [len(x) for x in found]
    assert sorted(order.tolist()) == [b + i for b, x in zip(begin, found, strict=True) for i in range(len(x) - 99)]
    raw = data.tobytes()
    strings = [raw[i : i + 100] for i in order]
    assert strings == sorted(strings)
    prefix = lambda a, b: next((i for i in range(100) if a[i] != b[i]), 100)
    assert suffix_dedup.common_prefixes(data, order).tolist() == [0, *map(prefix, strings, strings[1:])]


def test_equal_strings_have_one_name():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 99, n).astype(np.uint8) for n in (0, 99, 100, 101, 350, 700)] + [np.full(400, 45, np.uint8)]
    text, start, n, name, grams = suffix_dedup.runs_of(np.concatenate(texts), np.cumsum([len(t) for t in texts]))
    named = {(int(a), int(b) + j): int(h) for a, b, c, h in zip(text, start, n, name, strict=True) for j in range(c)}
    assert sorted(named) == [(i, j) for i, t in enumerate(texts) for j in range(len(t) - 99)]
    by_string: dict = {}
    for (i, j), h in named.items():
        assert by_string.setdefault(texts[i][j : j + 100].tobytes(), h) == h
    assert set(grams[text == 6]) == {2} and n.max() <= suffix_dedup.GRAMS


def without_repeats(docs):
    """{(id, text): (spans, kept)}, the slow way; ids in order, null last, equal ids by digest aside."""
    seen, out = set(), {}
    for i, text in docs:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        out[i, text] = bytes(b for b, g in zip(data, gone, strict=True) if not g)
    return out


def repeated_documents():
    rng = random.Random(5)
    words = ["alpha", "beta", "ünïcode", "漢字", "delta", "x", "12345", "\0", "-" * 30]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    licence = "This licence line of more than a hundred bytes stands in most of the documents, with other words before it and after it."
    docs = [(i, f"{prose(rng.randint(0, 40))}\n{licence}\n{prose(rng.randint(0, 40))}") for i in range(40)]
    copy = docs[3][1]
    docs += [(50, copy), (51, copy[:150]), (52, copy[40:] + prose(5)), (53, "-" * 99), (54, "-" * 100), (55, "-" * 400), (56, "ab" * 200), (57, None), (58, ""), (None, copy), (60, "é" * 300)]
    return docs


@pytest.mark.parametrize("hot", [None, 3])
def test_texts_without_repeats(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 150)
    docs = repeated_documents()
    want = without_repeats([d for d in docs if d[0] is not None] + [d for d in docs if d[0] is None])
    df = spark.createDataFrame([(*d, 1, "x") for d in docs + docs[:2]], "doc_id long, text string, digest int, runs string").repartition(5)
    rows = suffix_dedup.without_repeats(df).collect()
    assert len(rows) == len(docs) + 2
    kept = {}
    for r in rows:
        kept.setdefault(r["id"], set()).add(bytes(r["kept"]))
        assert r["n_bytes"] - sum(s["end"] - s["start"] for s in r["spans"]) == len(r["kept"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    assert kept == {i: {k} for (i, _), k in want.items()}


def test_equal_ids_are_in_order_of_digest(spark):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(8))
    rows = suffix_dedup.without_repeats(spark.createDataFrame([(1, "a " + text), (1, "b " + text), (1, "b " + text), (0, "short")], "doc_id long, text string")).collect()
    removed = sorted(len(r["spans"]) for r in rows if r["id"] == 1)
    assert removed in ([0, 0, 1], [0, 1, 1])  # one text keeps the passage; rows that repeat it are the same document


def brute_negatives(rows, positives=5, negatives=3):
    rows = [(i, np.floor(np.array(v, float) * 256).astype(int), c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, v, c in rows:
        if a % 50:
            continue
        scored = sorted((-int(v @ w), i, k) for i, w, k in rows if i != a and len(w) == len(v))
        for s, p, k in [x for x in scored if x[2] == c][:positives]:
            window = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("dimension,scale", [(2, 1.0), (8, 1.0), (32, 40.0)])
def test_hard_negatives(spark, monkeypatch, dimension, scale):
    monkeypatch.setattr(hard_negatives, "LEAF", 6)
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 120)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "AT_ONCE", 2)
    rng = np.random.default_rng(dimension)
    rows = [(i, (rng.standard_normal(dimension) * scale).round(1).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(1000 + i, rows[i][1], (rows[i][2] + 1) % 3) for i in range(0, 400, 9)]  # ties
    rows += [(2000, None, 1), (2050, [float("nan")] * dimension, 1), (2100, rows[0][1], None), (None, rows[0][1], 1), (2150, [], 1), (2200, [0.0] * dimension, 9), (2250, [1.0] * (dimension + 1), 1)]
    df = spark.createDataFrame([(*r, 7.0, "x") for r in rows], "vec_id long, embedding array<double>, label int, score double, part string")
    found = hard_negatives.mined(df, df["vec_id"] % 50 == 0).collect()
    got = sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found)
    assert got == brute_negatives(rows) and got


def test_trees_leave_leaves_out(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((2000, 3))
    v = np.floor(v / np.linalg.norm(v, axis=1, keepdims=True) * 256)
    part = hard_negatives.Part(np.arange(2000), v, np.zeros(2000, int))
    seen = []
    leaf = part.leaf
    part.leaf = lambda i: seen.append(i) or leaf(i)
    part.search(np.array([-1]), v[:1], np.array([0]), np.array([-1e15]), np.array([1e15]), 5, True)
    assert len(seen) < len(part.tree.paths) / 3


def brute_codes(rows, parts=8, entries=16, rounds=6):
    rows = sorted(((i is None, i or 0, v, c) for i, v, c in rows), key=lambda r: r[:3])
    x = np.floor(np.array([r[2] for r in rows], float) * 4096).astype(int).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        index, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                mine = x[index[:, p] == e, p]
                if len(mine):
                    books[p, e] = mine.sum(0) // len(mine)
    index, d = nearest()
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    error = d.sum(1).tolist()
    by_label: dict = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[3]] = by_label.get(r[3], 0) + e
    return sorted((str(None if r[0] else r[1]), "".join(f"{j:02x}" for j in i), e, by_label[r[3]], digest) for r, i, e in zip(rows, index.tolist(), error, strict=True))


@pytest.mark.parametrize("n", [3, 300])
def test_vector_codes(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i * 3 % 401, rng.standard_normal(16).round(1).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [rows[0], (None, rows[1][1], None)]
    odd = [(5000, None, 1), (5001, [None] * 16, 1), (5002, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<double>, label int, error int, code string").repartition(3)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.codes(df).collect())
    assert got == brute_codes(rows)


def test_annuli_are_exact_and_smaller():
    rng = np.random.default_rng(2)
    entries, rows = rng.integers(-900, 900, (16, 8)), rng.integers(-900, 900, (500, 8))
    entries[7] = entries[3]
    index, best, done = vector_codes.Annuli.of(entries).nearest(np.concatenate([rows, entries]))
    d = ((np.concatenate([rows, entries])[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all() and done < d.size
    with pytest.raises(OverflowError):
        vector_codes.integers(np.array([1e30]), 4096)


def test_other_dimensions(spark):
    rows = [(1, [0.5] * 3, 1), (2, [0.25] * 3, 1), (3, [], 1), (4, [0.5] * 8, None)]
    got = {r["vec_id"]: r for r in vector_codes.codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert set(got) == {1, 2, 3, 4} and len({r["codebooks_sha256"] for r in got.values()}) == 3 and got[3]["error"] == 0
