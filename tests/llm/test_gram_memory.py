"""Four-grams are counted in little memory, and the same wherever a stretch ends."""

import tracemalloc

import numpy as np
import pytest

from loomgraph.llm import toxicity


@pytest.mark.parametrize("size", [0, 1, 3, toxicity.STRETCH - 1, toxicity.STRETCH, 2 * toxicity.STRETCH + 2, 4 << 20])
def test_stretches(size):
    data = np.random.default_rng(size).integers(32, 128, size).astype(np.uint8)
    total = np.zeros(toxicity.CODES**4, np.int64)
    tracemalloc.start()
    toxicity.add_four_grams(data, total)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    codes = np.concatenate([np.zeros(3, np.int64), toxicity.CODE_OF[data], [0]])
    grams = sum(codes[k : len(codes) - 3 + k] * toxicity.CODES ** (3 - k) for k in range(4))
    assert (total == np.bincount(grams, minlength=toxicity.CODES**4)).all()
    assert peak < 24 << 20
