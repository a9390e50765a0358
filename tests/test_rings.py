"""Planar segments, edges and surface points on written-out rings."""

import math
import random

from fieldscan.operators import rings

SCHEMA = "scan int, ring int, t double, seq long, x double, y double, z double"
CFG = rings.RingConfig(group=3, near=1.5, far_share=0.0, blind=0.5)


def ring(spark, points, scan=1):
    return [(scan, 0, float(k), k, *map(float, p), 0.0) for k, p in enumerate(points)]


def labels(spark, rows, cfg=CFG):
    out = rings.plane_labels(spark.createDataFrame(rows, SCHEMA), ["scan", "ring"], cfg).orderBy("scan", "seq").collect()
    return [r.label for r in out]


def test_a_straight_wall_is_a_plane(spark):
    wall = [(5.0, 0.2 * k) for k in range(30)]
    got = labels(spark, ring(spark, wall))
    # segments of 1.5 m begin and end at every eighth point; each but the first starts along the one before it
    assert got[:9] == ["possible_plane", *["plane"] * 8] and set(got[:24]) == {"possible_plane", "plane"}


def test_a_corner_is_an_edge_between_planes(spark):
    corner = [(5.0, 0.2 * k) for k in range(17)] + [(5.0 - 0.2 * k, 3.2) for k in range(1, 20)]
    got = labels(spark, ring(spark, corner))
    assert got.count("edge_plane") == 1 and got[16] == "edge_plane"


def test_missing_readings_part_segments(spark):
    wall = [(0.0, 0.0) if k in (0, 11) else (5.0, 0.2 * k) for k in range(26)]
    got = labels(spark, ring(spark, wall))
    assert got[0] == "none" and got[11] == "none" and got[1] == "possible_plane"


def test_rings_are_walked_apart_and_wait_no_longer_than_needed(spark):
    wall = [(5.0, 0.2 * k) for k in range(30)]
    alone = labels(spark, ring(spark, wall))
    assert labels(spark, ring(spark, wall) + ring(spark, wall, 2) + ring(spark, wall[:2], 3)) == alone * 2 + ["none"] * 2
    walk, most = rings.PlaneWalk(CFG), 0
    for k in range(2_000):
        walk.push({"x": 5.0, "y": 0.2 * k, "z": 0.0})
        most = max(most, len(walk.points))
    assert most <= 10  # a segment and the points it is judged by, however long the ring


def plain_surfaces(labels, points, every):
    out, run = [], []
    for k, label in enumerate(labels):
        if label in ("plane", "possible_plane"):
            run.append(k)
            if len(run) == every:
                out.append((run[0], every, *points[k]))
                run = []
        else:
            if run:
                out.append((run[0], len(run), *(sum(points[i][a] for i in run) / len(run) for a in range(3))))
            run = []
    return out


def test_surface_points(spark):
    rng = random.Random(2)
    marks = [rng.choice(("plane", "plane", "possible_plane", "none", "wire")) for _ in range(60)]
    points = [(rng.random(), rng.random(), rng.random()) for _ in marks]
    df = spark.createDataFrame([(1, float(k), k, *p, m) for k, (p, m) in enumerate(zip(points, marks, strict=True))], "scan int, t double, seq long, x double, y double, z double, label string")
    got = sorted(tuple(r)[1:] for r in rings.surface_points(df, ["scan"], 3).collect())
    want = sorted(plain_surfaces(marks, points, 3))
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(math.isclose(a, b) for g, w in zip(got, want, strict=True) for a, b in zip(g, w, strict=True))


def test_small_planes_take_every_second_middle(spark):
    line = [(3.0 + 0.3 * k, 0.0) for k in range(12)]
    df = spark.createDataFrame([(*r, "none") for r in ring(spark, line)], SCHEMA + ", label string")
    cfg = rings.RingConfig(blind=0.1, up_cos=-2.0, down_cos=2.0)
    got = [r.label for r in rings.edge_points(df, ["scan", "ring"], cfg).orderBy("seq").collect()]
    # places 3 to 8 may be judged: 3, 5 and 7 are middles that count
    assert got == ["none"] * 2 + ["plane"] * 7 + ["none"] * 3


def plain_fill(ranges, energies, bright):
    """Beam after beam around the circle, as recordings were filled."""
    r, e, n, i = list(ranges), list(energies), len(ranges), 0
    lit = lambda k: r[k % n] is not None and e[k % n] > bright
    while i < n:
        if r[i] is not None:
            i += 1
            continue
        if lit(i - 1) and lit(i + 1) and (lit(i + 2) or lit(i - 2)):
            fill, other = [i], i + 1
        elif lit(i - 1) and lit(i - 2) and not lit(i + 1) and lit(i + 2) and lit(i + 3):
            fill, other = [i, (i + 1) % n], i + 2
        else:
            i += 1
            continue
        mean = (r[i - 1] + r[other % n]) / 2, (e[i - 1] + e[other % n]) / 2
        for k in fill:
            r[k], e[k] = mean
        i += 2
    return r


def test_filled_beams_light_up_later_gaps(spark):
    from fieldscan.operators import scans

    rng, scan_rows, want = random.Random(12), [], {}
    for scan in range(60):
        ranges = [None if rng.random() < 0.35 else round(rng.uniform(1, 9), 2) for _ in range(20)]
        if scan == 0:  # a chain of gaps, each lit by the one filled before it, and a gap over the seam
            ranges = [None if k in (0, 4, 6, 8, 12, 13, 19) else 2.0 + k for k in range(20)]
        energies = [None if x is None else rng.choice((150.0, 250.0, 300.0)) if scan else 250.0 for x in ranges]
        scan_rows += [(scan, k, x, e) for k, (x, e) in enumerate(zip(ranges, energies, strict=True))]
        want |= {(scan, k): x for k, x in enumerate(plain_fill(ranges, energies, 200.0))}
    df = spark.createDataFrame(scan_rows, "scan_id int, beam int, range double, energy double")
    got = {(r.scan_id, r.beam): r.filled for r in scans.fill_bright_gaps_in_order(df, 20).collect()}
    assert got.keys() == want.keys() and all(g == want[k] or math.isclose(g, want[k]) for k, g in got.items())
    assert got[0, 0] is not None and got[0, 19] is not None
    once = {(r.scan_id, r.beam): r.filled for r in scans.fill_bright_gaps(df, 20).collect()}
    assert once != got
