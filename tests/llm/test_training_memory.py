"""What the driver holds while the quality scorer is fitted."""

from __future__ import annotations

import tracemalloc

import numpy as np

from docquarry.llm import quality


def test_fitting_holds_one_matrix():
    rng = np.random.default_rng(0)
    rows = [(rng.choice(1024, 40, replace=False).astype(np.int32), rng.random(40).astype(np.float32)) for _ in range(1500)]
    label = rng.random(1500).astype(np.float32)
    tracemalloc.start()
    quality.fit_linear(rows, label, 1024, 1e-4, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.9 * 1500 * 1025 * 4
