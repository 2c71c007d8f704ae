"""A history is replayed in the memory of its vectors."""

import tracemalloc

import numpy as np
import pytest

from parlance.operators import live


@pytest.mark.parametrize("n, m", [(0, 3), (4, 0), (5, 1), (40, 23)])
def test_best_two_is_that_of_all_scores(monkeypatch, n, m):
    monkeypatch.setattr(live, "SCORES", 60)
    rng = np.random.default_rng(n)
    unit, voices = rng.integers(-2, 3, (n, 3)).astype(float), rng.integers(-2, 3, (m, 3)).astype(float)
    first, score, after, favourite = live.best_two(unit, voices)
    whole = unit @ voices.T
    for i in range(n):
        order = np.argsort(-whole[i], kind="stable")
        assert first[i] == (order[0] if m else -1)
        assert score[i] == (whole[i, order[0]] if m else 0) and after[i] == (whole[i, order[1]] if m > 1 else 0)
    for k in range(m if n else 0):
        assert favourite[k] == n - 1 - np.argmax(whole[::-1, k])


def test_no_matrix_of_rows_and_voices(monkeypatch):
    monkeypatch.setattr(live, "SCORES", 1 << 16)
    rng = np.random.default_rng(1)
    unit, voices = rng.normal(size=(3_000, 8)), rng.normal(size=(3_000, 8))
    tracemalloc.start()
    live.best_two(unit, voices)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 3_000 * 3_000 * 8 // 8
