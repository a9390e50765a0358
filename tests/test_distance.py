"""Distances on maps against brute force: seeds, several maps, missing cells, empty tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.operators import distance


def test_border_min_against_all_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 200):
        for share in (0.0, 0.1, 0.6, 1.0):
            v = np.sort(rng.choice(3 * n, n, replace=False))
            seeds = np.where(rng.random(n) < share, rng.choice([0.0, 1.0, 30.0, 500.0], n) * rng.random(n).round(1), np.inf)
            q = np.sort(rng.choice(4 * n, n, replace=False))
            want = (seeds[None, :] + np.maximum(np.abs(q[:, None] - v[None, :]) - 0.5, 0) ** 2).min(axis=1)
            np.testing.assert_allclose(distance.border_min(v, seeds, q), want)


def brute(cells, height, resolution):
    """Signed distances to a surface {(x, y): z}: to the nearest solid less to the nearest free space, both as boxes of cells."""
    out = {}
    for (x, y), own in cells.items():
        if own is None:
            continue
        over, under = math.inf, math.inf
        for (u, v), z in cells.items():
            if z is None:
                continue
            flat = max(abs(x - u) - 0.5, 0) ** 2 + max(abs(y - v) - 0.5, 0) ** 2
            over = min(over, flat + max((height - z) / resolution, 0) ** 2)
            under = min(under, flat + min((height - z) / resolution, 0) ** 2)
        out[x, y] = resolution * (math.sqrt(over) - math.sqrt(under))
    return out


def test_distance_to_a_surface(spark):
    rng = random.Random(6)
    maps = {m: {(x, y): rng.choice((0.0, 0.2, 1.1, 3.0, rng.random())) for x in range(7) for y in range(5) if rng.random() < 0.8} for m in (1, 2)}
    maps[2][0, 0] = None
    rows = [(m, x, y, z) for m, cells in maps.items() for (x, y), z in cells.items()]
    df = spark.createDataFrame([*rows, rows[0]], "map_id int, ix int, iy int, z double")
    heights = [-2.0, 0.1, 0.7, 1.1, 5.0]
    got = {(r.map_id, r.iz, r.ix, r.iy): r.distance for r in distance.distance_3d(df, "z", heights, 0.5).collect()}
    assert len(got) == (sum(map(len, maps.values())) - 1) * len(heights)
    for m, cells in maps.items():
        for k, h in enumerate(heights):
            for (x, y), d in brute(cells, h, 0.5).items():
                assert got[m, k, x, y] == pytest.approx(d)
    high = [d for (m, k, x, y), d in got.items() if k == 4]
    assert min(high) > 1.9  # above all terrain: at most the clearance to the highest cell and more than none
    assert distance.distance_3d(df.limit(0), "z", heights, 0.5).count() == 0


def test_planar_distance_of_several_maps(spark):
    rows = [(m, x, y, (x, y) == (m, m)) for m in (0, 3) for x in range(9) for y in range(4)]
    df = spark.createDataFrame(rows, "map_id int, ix int, iy int, occ boolean")
    for r in distance.distance_2d(df, F.col("occ")).collect():
        d = math.hypot(max(abs(r.ix - r.map_id) - 0.5, 0), max(abs(r.iy - r.map_id) - 0.5, 0))
        assert r.distance == pytest.approx(d or -0.5)
