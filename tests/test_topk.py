import numpy as np
import pytest

from chunkwright.operators.topk import RunningTop


@pytest.mark.parametrize("k", [1, 3, 50])
def test_running_top_against_a_full_sort(k):
    rng = np.random.default_rng(k)
    scores = np.round(rng.random((7, 900)), 2)  # many ties
    some = rng.random((7, 900)) < 0.8
    top = RunningTop(7, k)
    at = 0
    while at < 900:
        n = int(rng.integers(1, 90))
        top.add(scores[:, at : at + n], np.arange(at, min(at + n, 900)), some[:, at : at + n])
        at += n
    i, keys, s = top.best()
    got = list(zip(i.tolist(), keys.tolist(), s.tolist()))
    want = [(q, j, scores[q, j]) for q in range(7) for j in sorted(np.flatnonzero(some[q]).tolist(), key=lambda j: (-scores[q, j], j))[:k]]
    assert got == want


def test_nothing_seen():
    assert [len(x) for x in RunningTop(3, 2).best()] == [0, 0, 0]
