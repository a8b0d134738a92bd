"""op6 moves a bounded multiple of its vectors at once, and finds all links however its cells are cut."""

from __future__ import annotations

import numpy as np
import pytest

from sievework.llm import embeddings
from tests.llm import brute
from tests.llm.test_operators import rows, same


@pytest.mark.parametrize("copy", [0, 10**9])
def test_many_cells_blocks_and_rounds(spark, monkeypatch, copy):
    """With many pivots and with one: blocks, halves of the circle and rounds lose no pair and count none twice."""
    for name, value in (("SMALL_BLOCK", 16), ("BLOCK", 32), ("AT_ONCE", 7), ("COPY", copy)):
        monkeypatch.setattr(embeddings, name, value)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 6))
    x = np.concatenate([centres[draw.integers(0, 40, 300)] + 0.3 * draw.normal(size=(300, 6)), draw.normal(size=(100, 6))])
    x[:20] = x[20:40]
    data = [(3 * k, v) for k, v in enumerate(x.tolist())]
    got = embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    same(rows(got, "vec_id", "n_links", "component_id", "kept"), brute.op6(data))


def test_rounds_are_bounded_and_whole():
    """Every pair of blocks is asked once, and a round moves no more rows than it may."""
    cells, size, most = [(0, 1000, 700), (3, 90, 0), (5, 250, 4000)], 100, 1500
    seen = []
    for pieces in embeddings.rounds(cells, size, most):
        load = 0.0
        for cell, i, low, high in pieces:
            own, foreign = next(c[1:] for c in cells if c[0] == cell)
            down, across = -(-own // size), -(-foreign // size)
            for j in range(low, high):
                load += own / down + (0 if i == j else own / down if j < down else foreign / across)
                seen.append((cell, i, j))
        assert load <= most
    wanted = [(c, i, j) for c, own, foreign in cells for i in range(-(-own // size)) for j in range(i, -(-own // size) - (-foreign // size))]
    assert seen == wanted


def test_halves_meet_once():
    """Of two cells that vectors of both reach, one compares them."""
    for number in (1, 2, 5, 8):
        home = np.arange(number)
        half = embeddings._half(np.ones((number, number), bool), home)
        assert (half ^ half.T == ~np.eye(number, dtype=bool)).all()
