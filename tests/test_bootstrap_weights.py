"""Weights of the bootstrap."""

import tracemalloc

import numpy as np
import pyarrow as pa

from holdfast.operators import bootstrap

P = bootstrap.PRIME


def test_weights_follow_their_definition():
    r = np.random.default_rng(3)
    first, second = r.integers(0, P, (2, 200))
    first[:4], second[:4] = [0, P - 1, 1, P - 1], [P - 1, 0, P - 1, P - 1]
    steps = bootstrap.poisson_steps()
    for b in range(5):
        c = bootstrap.coefficients(7, b)
        draws = [(((c[3] * x + c[2]) * x + c[1]) * x + c[0] + c[4] * y) % P for x, y in zip(first.tolist(), second.tolist())]
        assert bootstrap.replicate_weights(first, second, 7, b).tolist() == [sum(y / P >= s for s in steps) for y in draws]
    for y, step in zip(bootstrap.DRAW_STEPS, steps):
        assert (y - 1) / P < step <= y / P


def test_a_cell_needs_no_matrix_of_all_replicates():
    r = np.random.default_rng(4)
    n = 20_000
    cell = pa.table({"hash_a": r.integers(0, P, n), "hash_b": r.integers(0, P, n), "label": r.integers(0, 2, n), "score": r.random(n)})
    tracemalloc.start()
    seen = 0
    for _ in bootstrap._weights_by_score(cell, 1, range(40)):
        seen += 1
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 40 and most < 40 * n * 8
