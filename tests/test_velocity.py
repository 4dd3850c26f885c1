from __future__ import annotations

import numpy as np
import pytest

from tremorframe.operators.velocity import Model, table, travel_times


def test_times_grow_and_s_is_later():
    m = Model.named("iasp91")
    d = np.arange(1.0, 500.0, 7.0)
    p, s = travel_times(m, d, 10.0), travel_times(m, d, 10.0, "S")
    assert (s > p).all()
    assert travel_times(m, np.array([100.0]), 0.0)[0] == pytest.approx(16.7, abs=3)


def test_velocity_at_depth():
    m = Model.named("korea")
    assert [m.velocity(z, "P") for z in (0, 1, 12, 35, 400)] == [4.5, 5.9, 6.2, 7.2, 8.0]
    assert m.velocity(0.5, "S") == 2.6


def test_table_is_the_function():
    m = Model.named("ak135")
    t = table(m, 200, 20)
    for z in (0, 7, 20):
        assert np.allclose(t["P"][:, z], travel_times(m, np.arange(201.0), float(z)))


def test_no_layers():
    assert travel_times(Model("none", ()), np.array([60.0]), 5.0)[0] == 10.0
