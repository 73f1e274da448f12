"""Planes recovered from the distances of planted points."""

from itertools import combinations

import numpy as np
import pytest

from skein.operators import scaling


def distances(points):
    return {(i, j): float(np.linalg.norm(points[i] - points[j])) for i, j in combinations(range(len(points)), 2)}


def frame(spark, d):
    return spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "i long, j long, d double")


def test_planes_of_planted_points(spark):
    rng = np.random.default_rng(5)
    points = rng.random((10, 2)) * [3, 1]
    d = distances(points)
    got = {r.i: np.array([r.x, r.y]) for r in scaling.classical_plane(frame(spark, d), rounds=8).collect()}
    assert distances([got[k] for k in range(10)]) == {k: pytest.approx(v, abs=1e-4) for k, v in d.items()}
    # ranks alone
    top = max(d.values())
    plane, stress = scaling.kruskal_plane(frame(spark, {k: (v / top) ** 2 for k, v in d.items()}), rounds=6)
    assert all(a >= b for a, b in zip(stress, stress[1:])) and stress[-1] < 0.1 and stress[-1] < stress[0]
    found = distances([np.array([r.x, r.y]) for r in sorted(plane.collect(), key=lambda r: r.i)])
    order = lambda values: np.argsort(np.argsort([values[k] for k in sorted(d)]))
    assert np.corrcoef(order(found), order(d))[0, 1] > 0.97


def test_monotone_fit():
    assert scaling.monotone(np.array([1.0, 3.0, 2.0, 4.0, 0.0]), np.array([1, 1, 1, 1, 3])).tolist() == [1, 1.5, 1.5, 1.5, 1.5]
