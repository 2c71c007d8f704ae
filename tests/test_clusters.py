"""Clusters of a meeting are those of the plain method, without a matrix of all pairs."""

import tracemalloc

import numpy as np
import pytest

from parlance.operators import matching


def plain(vectors, threshold, blocked):
    """C2, C3 by looking at all pairs before each merge."""
    groups, bars = {i: [i] for i in range(len(vectors))}, {i: set(b) for i, b in enumerate(blocked)}
    centre = {i: v / np.sqrt(v @ v) for i, v in enumerate(vectors)}
    raw = {i: v for i, v in enumerate(vectors)}
    while True:
        open_ = lambda i, j: not any(b in bars[i] for b in groups[j]) and not any(b in bars[j] for b in groups[i])
        pairs = [(-(centre[i] @ centre[j]), i, j) for i in groups for j in groups if i < j and open_(i, j)]
        if not pairs or -min(pairs)[0] < threshold:
            return sorted(sorted(g) for g in groups.values())
        _, i, j = min(pairs)
        mean = (raw[i] * len(groups[i]) + raw[j] * len(groups[j])) / (len(groups[i]) + len(groups[j]))
        raw[i] = centre[i] = mean / np.sqrt(mean @ mean)
        groups[i] += groups.pop(j)
        bars[i] |= bars[j]


@pytest.mark.parametrize("seed", range(6))
def test_same_as_all_pairs(monkeypatch, seed):
    monkeypatch.setattr(matching, "SCORES", 100)
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(35, 4))
    blocked = [{int(x) for x in rng.integers(0, 35, 2)} - {i} if seed % 2 else set() for i in range(35)]
    assert sorted(matching.merge_closest(v, np.ones(35), 0.6, blocked)) == plain(v, 0.6, blocked)


def test_no_matrix_of_all_pairs(monkeypatch):
    """The blocks' survivors, too, are merged in the memory of their vectors."""
    monkeypatch.setattr(matching, "SCORES", 1 << 16, raising=False)
    n = 1_500
    v = np.random.default_rng(1).normal(size=(n, 16))
    tracemalloc.start()
    found = matching.grouped_ids(list(range(n)), v, 0.9, {}, block=500)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found) == set(range(n)) and len(set(found.values())) > n // 2
    assert most < n * n * 8 // 2
