from __future__ import annotations

import numpy as np
import pytest

from quillsift.operators.topk import TaskTopK


@pytest.mark.parametrize("room", [0, 10**6])
def test_blocks_in_any_size_keep_the_best(room):
    rng = np.random.default_rng(4)
    scores = np.round(rng.normal(size=(300, 7)), 1)
    scores[rng.random(scores.shape) < 0.3] = np.nan
    scores[:, 6] = np.nan
    ids = rng.permutation(300)
    best = TaskTopK(7, 12)
    best._room = room
    start = 0
    while start < 300:
        step = int(rng.integers(1, 40))
        best.offer(ids[start : start + step], scores[start : start + step])
        start += step
    query, chunk, score = best.best()
    for q in range(7):
        wanted = sorted((-s, i) for s, i in zip(scores[:, q], ids) if not np.isnan(s))[:12]
        assert list(zip(-score[query == q], chunk[query == q])) == wanted


def test_nothing_offered():
    query, chunk, score = TaskTopK(3, 2).best()
    assert query.size == chunk.size == score.size == 0
