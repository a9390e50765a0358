"""Small hand-made cases: edges, ties, missing values, empty tables, brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.functions import geo
from fieldscan.operators import distance, fold, grid, points, timejoin, windows


def test_asof_takes_equal_times_and_respects_age(spark):
    left = spark.createDataFrame([(1, 1, 1.0), (1, 2, 5.0), (2, 3, 1.0)], "device_id long, seq long, t double")
    right = spark.createDataFrame([(1, 9, 1.0, 7.0), (1, 10, 2.0, 8.0)], "device_id long, seq long, t double, value double")
    got = {r.seq: r.prev_value for r in timejoin.asof_join(left, right, ["device_id"], ["value"], max_age=2.0).collect()}
    assert got == {1: 7.0, 2: None, 3: None}
    assert timejoin.asof_join(left, right.limit(0), ["device_id"], ["value"]).where("prev_value IS NOT NULL").count() == 0


def test_cell_edges(spark):
    g = grid.Geometry(4.0, 4.0, 1.0)
    rows = spark.createDataFrame([(2.0, 2.0), (-2.0, 0.0), (-1.999, 1.999), (0.0, 0.0), (2.001, 0.0)], "x double, y double")
    ix, iy = g.index(F.col("x"), F.col("y"))
    assert [tuple(r) for r in rows.select(ix, iy).collect()] == [(0, 0), (None, None), (3, 0), (2, 2), (None, None)]


def test_line_both_ends(spark):
    seg = spark.createDataFrame([(1, 0, 0, 5, 2), (2, 3, 3, 3, 3), (3, 4, 1, 0, 0)], "seg_id int, ix0 int, iy0 int, ix1 int, iy1 int")
    got = {}
    for r in grid.cells_on_line(seg).orderBy("seg_id", "step").collect():
        got.setdefault(r.seg_id, []).append((r.ix, r.iy))
    assert got[2] == [(3, 3)] and got[1][0] == (0, 0) and got[1][-1] == (5, 2) and len(got[1]) == 6 and got[3][-1] == (0, 0)


@pytest.mark.parametrize("occupied", [set(), {(2, 2)}, {(0, 0), (3, 4)}, "all"])
def test_distance_against_brute_force(spark, occupied):
    cells = [(0, x, y) for x in range(6) for y in range(5)]
    taken = {(x, y) for _, x, y in cells} if occupied == "all" else occupied
    df = spark.createDataFrame([(m, x, y, (x, y) in taken) for m, x, y in cells], "map_id int, ix int, iy int, occ boolean")
    got = {(r.ix, r.iy): r.distance for r in distance.distance_2d(df, F.col("occ")).collect()}
    for _, x, y in cells:
        others = [(u, v) for _, u, v in cells if ((u, v) in taken) != ((x, y) in taken)]
        if not others:
            assert got[x, y] == (-math.inf if (x, y) in taken else math.inf)
            continue
        d = min(math.hypot(max(abs(x - u) - 0.5, 0), max(abs(y - v) - 0.5, 0)) for u, v in others)
        assert got[x, y] == pytest.approx(-d if (x, y) in taken else d)


def test_radius_join_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(1, i, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.uniform(-1, 1)) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, id int, x double, y double, z double")
    got = {(r.id, r.p_id) for r in points.radius_join(df, df, ["k"], 1.0).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if sum((a[i] - b[i]) ** 2 for i in (2, 3, 4)) <= 1.0}


def test_clusters_along_a_chain(spark):
    rows = [(1, i, float(i), 0.0, 0.0) for i in range(40)] + [(1, 100, 90.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, pid int, x double, y double, z double")
    got = points.euclid_clusters(df, ["k"], "pid", 1.1, 2).collect()
    assert [(r.cluster, r.n) for r in got] == [(0, 40)]


def test_planes(spark):
    rows = [(1, x, y, -(1 + 0.2 * x + 0.3 * y) / 0.5) for x in (0.0, 1.0, 2.0) for y in (0.0, 1.0, 3.0)]
    r = points.fit_planes(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"]).first()
    assert (r.a, r.b, r.c) == (pytest.approx(0.2), pytest.approx(0.3), pytest.approx(0.5))


def test_hull_of_a_square(spark):
    rows = [(1, x / 2, y / 2) for x in range(5) for y in range(5)]
    got = points.convex_hull(spark.createDataFrame(rows, "k int, x double, y double"), ["k"]).orderBy("step").collect()
    assert [(r.x, r.y) for r in got] == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_linear_sampling_of_a_plane(spark):
    g = grid.Geometry(6.0, 6.0, 0.5)
    cells = grid.with_center(grid.make_grid(spark, g), g).withColumn("h", 2 * F.col("x") - F.col("y") + 1)
    q = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(0.1, 0.2), (-1.3, 2.0), (2.2, -2.1)])], "query_id int, x double, y double")
    got = {r.query_id: r.value for r in grid.sample_linear(cells, q, g, "h").collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(-3.6), 2: pytest.approx(7.5)}


def test_enu_of_the_origin_and_north(spark):
    lit = lambda *v: [F.lit(x) for x in v]
    e, n, u = geo.enu(*lit(39.001, 117.0, 10.0), *lit(39.0, 117.0, 10.0))
    r = spark.range(1).select(e.alias("e"), n.alias("n"), u.alias("u")).first()
    assert abs(r.e) < 1e-6 and r.n == pytest.approx(111.0, abs=0.2) and abs(r.u) < 0.01


def test_filters_with_feedback(spark):
    rows = [(1, "a", i, float(i), v) for i, v in enumerate([1.0, 1.2, 9.0, None, 1.4])]
    df = spark.createDataFrame(rows, "device_id int, channel string, seq int, t double, value double")
    out = fold.ordered_fold(df, ["device_id", "channel"], ["value"], "filtered double", *fold.median_step(3, 2.0)).orderBy("seq").collect()
    assert [r.filtered for r in out] == [1.0, 1.1, 1.1, 1.1, 1.2]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(d, i, i * 0.3, float((i * 7 + d) % 11)) for d in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "device_id int, seq int, t double, value double")
    df.where("seq < 20").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("seq >= 20").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    step = fold.low_pass_step(0.5, 3.0)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = fold.stream_fold(stream, ["device_id"], ["value"], "filtered double", *step).writeStream.format("memory").queryName("folded").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = fold.ordered_fold(df, ["device_id"], ["value"], "filtered double", *step)
    key = lambda r: (r.device_id, r.seq, round(r.filtered, 9))
    assert sorted(map(key, spark.table("folded").collect())) == sorted(map(key, batch.collect()))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "device_id int, seq int, t double, v double, w double")
    assert windows.dead_reckon(empty).count() == 0 and windows.path_length(windows.dead_reckon(empty)).count() == 0
    assert fold.ordered_fold(empty, ["device_id"], ["v"], "kept boolean", *fold.sample_step(1.0)).count() == 0


def test_messages_round_trip(spark, tmp_path):
    from fieldscan.sources import messages

    df = spark.createDataFrame([("imu", 1), ("odom", 2), ("imu", 3)], "topic string, seq int").withColumn("ts", F.timestamp_seconds(F.col("seq") * 50_000))
    messages.write_messages(df, str(tmp_path / "m"))
    back = messages.read_messages(spark, str(tmp_path / "m"), ["imu"])
    assert sorted(r.seq for r in back.collect()) == [1, 3]
    names = spark.createDataFrame([("imu",), ("lidar",)], "topic string")
    assert [r.topic for r in messages.required_topics(df, names).collect()] == ["lidar"]


def test_waypoints_and_tracks(spark, tmp_path):
    from fieldscan.sources import messages

    (tmp_path / "w.json").write_text('{"name": "a", "latitude": 1.0, "longitude": 2.0}\n{"latitude_deg": 95.0, "longitude_deg": 2.0}\n')
    got = messages.read_waypoints(spark, str(tmp_path / "w.json")).collect()
    assert [(r.name, r.valid) for r in got] == [("a", True), ("wp_02", False)]
    track = spark.createDataFrame([(1, 2.0, 1.0, float("nan"), 0.0, 0.0), (1, 1.0, 3.0, 4.0, 0.0, 0.0)], "track int, time double, lat double, lon double, alt double, heading_deg double")
    messages.write_track_csv(track, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("lon IS NULL").count() == 1
    messages.write_track_kml(track.na.fill(0.0), str(tmp_path / "kml"))
    assert "4.0,3.0,0.0 0.0,1.0,0.0" in spark.read.text(str(tmp_path / "kml")).first()[0]


def replay(spark, tmp_path, df, make, name):
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_metrics_and_frames(spark, tmp_path):
    from fieldscan.streaming import streams

    df = spark.range(100).select(F.timestamp_seconds(F.col("id") * 2).alias("ts"), F.lit("imu").alias("topic"), F.lit(1).alias("lidar_id"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
    rates = replay(spark, tmp_path / "a", df, lambda s: streams.stream_metrics(s, "20 seconds", "20 seconds", "1 second"), "rates_live")
    assert {(r.n, r.rate) for r in rates.collect()} == {(10, 0.5)}
    frames = replay(spark, tmp_path / "b", df, lambda s: streams.stream_frames(s, "10 seconds", "1 second"), "frames_live")
    assert {r.n for r in frames.collect()} == {5}


def test_health(spark):
    from fieldscan.streaming import streams

    df = spark.createDataFrame([(10.0, 9.9, 9.0), (10.0, 9.0, 9.9), (10.0, None, 9.9)], "t double, a double, b double")
    assert [r.health for r in streams.health(df, {"a": "a", "b": "b"}, {"a": 0.5, "b": 0.5}).collect()] == ["b_timeout", "a_timeout", "a_timeout"]


def test_asof_join_by_bucket_is_the_same(spark):
    from fieldscan.operators import timejoin

    rng = random.Random(21)
    rows = lambda n, none: [(rng.choice("ab"), rng.randrange(400) / 10, i, None if none and rng.random() < 0.2 else rng.random()) for i in range(n)]
    left, right = (spark.createDataFrame(rows(n, k), "device_id string, t double, seq long, v double") for n, k in ((300, False), (60, True)))
    for kind in ({}, {"forward": True}, {"strict": True}, {"max_age": 1.5}):
        plain = timejoin.asof_join(left, right, ["device_id"], ["v"], **kind).collect()
        split = timejoin.asof_join(left, right, ["device_id"], ["v"], bucket=3.0, **kind).collect()
        assert sorted(map(repr, plain)) == sorted(map(repr, split))


def test_tracks_against_a_plain_walk(spark):
    from fieldscan.operators import fold

    rng = random.Random(22)
    rows = [(k, float(t), rng.randrange(2, 6), rng.randrange(40) / 10, rng.randrange(40) / 10) for k in range(3) for t in range(12) for _ in range(rng.randrange(5))]
    df = spark.createDataFrame(rows, "device_id long, t double, size long, x double, y double")
    got = {(r.device_id, r.t, r.seq): r.track for r in fold.track_clusters(df, ["device_id"], 1.0, 3.0).collect()}
    for key in range(3):
        tracks, serial = {}, 0
        for t in range(12):
            tracks = {i: p for i, p in tracks.items() if p[2] > t}
            taken = set()
            own = sorted((r for r in rows if r[0] == key and r[1] == t), key=lambda r: (-r[2], r[3], r[4]))
            for place, (_, _, _, x, y) in enumerate(own, 1):
                near = min(((math.hypot(p[0] - x, p[1] - y), i) for i, p in tracks.items() if i not in taken), default=None)
                i = near[1] if near and near[0] <= 1.0 else serial
                serial += i == serial
                taken.add(i)
                tracks[i] = (x, y, t + 3.0)
                assert got[key, float(t), place] == i


def test_heading_alignment_once_a_goal():
    from fieldscan.operators import fold

    init, step = fold.alignment_step(30.0, 10.0, 0.4, 0.5)
    state, seen = init(), []
    pose = lambda t, yaw, x=0.0: {"t": t, "x": x, "y": 0.0, "yaw": math.radians(yaw), "gx": None, "gy": None}
    goal = lambda t, x, y: {"t": t, "x": None, "y": None, "yaw": None, "gx": x, "gy": y}
    rows = [pose(0, 0), goal(1, 0.0, 5.0), pose(1.1, 0), pose(1.2, 85), pose(1.5, 70), pose(1.6, 88), pose(1.9, 89), pose(2.1, 91), pose(2.2, 0), goal(3, 5.0, 0.0), pose(3.1, 5), goal(4, 0.2, 0.0), pose(4.1, 90)]
    for row in rows:
        state, out = step(state, row)
        seen.append(out["aligning"])
    #                 goal         near   away   near               held          once         new    small         close
    assert seen == [False, False, True, True, True, True, True, False, False, False, False, False, False]


def test_deskew_against_matrices(spark):
    from fieldscan.operators import lidar

    rng = np.random.default_rng(23)

    def matrix(q):
        x, y, z, w = q
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])

    def exp(v):
        a = np.linalg.norm(v)
        k = v / a
        m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        return np.eye(3) + np.sin(a) * m + (1 - np.cos(a)) * m @ m

    unit = lambda: (v := rng.normal(size=4)) / np.linalg.norm(v)
    poses = [(1, k, 0.02 + 0.03 * k, *unit(), *rng.normal(size=12)) for k in range(3)]
    end, mount, shift = (*unit(), *rng.normal(size=3)), unit(), rng.normal(size=3)
    points = [(1, i, float(t), *rng.normal(size=3)) for i, t in enumerate([0.01, 0.02, 0.03, 0.05, 0.06, 0.1])]
    frame = lambda rows, names: spark.createDataFrame([tuple(float(v) if isinstance(v, np.floating) else v for v in r) for r in rows], "scan_id long, " + names)
    kinds = ", ".join(f"{c} double" for c in lidar.POSE)
    out = lidar.deskew(frame(points, "seq long, t double, x double, y double, z double"), frame(poses, f"seq long, t double, {kinds}"), frame([(1, *end)], ", ".join(f"{c} double" for c in lidar.POSE[:7])), tuple(map(float, mount)), tuple(map(float, shift)))
    got = {r.seq: np.array([r.x, r.y, r.z]) for r in out.collect()}
    li, re_ = matrix(mount), matrix(end[:4])
    for _, i, t, *p in points:
        own = [q for q in poses if q[2] < t]
        want = np.array(p)
        if own:
            _, _, t0, *q = own[-1]
            dt = t - t0
            p0, v, a, w = (np.array(q[k : k + 3]) for k in (4, 7, 10, 13))
            world = matrix(q[:4]) @ exp(w * dt) @ (li @ want + shift) + p0 + v * dt + 0.5 * a * dt * dt - np.array(end[4:])
            want = li.T @ (re_.T @ world - shift)
        assert np.allclose(got[i], want, atol=1e-9)


def test_cubic_surface_gives_cubics_back(spark):
    from fieldscan.operators import grid, sampling

    g = grid.Geometry(8.0, 8.0, 1.0)
    f = lambda x, y: 1 + x - 2 * y + x * y + 0.5 * x * x
    cells = grid.with_center(grid.make_grid(spark, g), g).withColumn("h", f(F.col("x"), F.col("y")))
    rng = random.Random(24)
    q = spark.createDataFrame([(i, rng.uniform(-2.4, 2.4), rng.uniform(-2.4, 2.4)) for i in range(40)] + [(40, 9.0, 0.0), (41, 3.9, -3.9)], "query_id long, x double, y double")
    got = {r.query_id: r for r in sampling.sample_cubic(cells, q, g, "h").collect()}
    assert all(got[i].value == pytest.approx(f(got[i].x, got[i].y)) for i in range(40)) and got[40].value is None and got[41].value is not None


def test_walks_by_bucket_are_the_same(spark):
    rng = random.Random(25)
    odom = spark.createDataFrame([(k, i, rng.randrange(600) / 10, rng.random(), rng.uniform(-1, 1)) for k in "ab" for i in range(200)], "device_id string, seq long, t double, v double, w double")
    plain, split = windows.dead_reckon(odom), windows.dead_reckon(odom, bucket=2.5)
    assert plain.columns == split.columns
    rows = lambda df: {(r.device_id, r.seq): (r.theta, r.x, r.y) for r in df.collect()}
    a, b = rows(plain), rows(split)
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v) for k, v in a.items())
    lengths = [{r.device_id: (r.length_m, r.n) for r in windows.path_length(plain, x).collect()} for x in (None, 2.5)]
    assert lengths[0].keys() == lengths[1].keys() and all(lengths[1][k] == pytest.approx(v) for k, v in lengths[0].items())


def plain_clusters(rows, tolerance, least):
    """Smallest id, size of the connected groups of (id, x, y, z)."""
    label, out = {}, {}
    for r in sorted(rows):
        if r[0] in label:
            continue
        todo, label[r[0]] = [r], r[0]
        while todo:
            p = todo.pop()
            for q in rows:
                if q[0] not in label and sum((p[i] - q[i]) ** 2 for i in (1, 2, 3)) <= tolerance * tolerance:
                    label[q[0]] = r[0]
                    todo.append(q)
    for name in label.values():
        out[name] = out.get(name, 0) + 1
    return {k: n for k, n in out.items() if n >= least}


@pytest.mark.parametrize("spread, n", [(6.0, 250), (2.5, 150), (12.0, 250)])
def test_clusters_against_brute_force(spark, spread, n):
    rng = random.Random(int(spread * 7))
    rows = [(i, rng.uniform(-spread, spread), rng.uniform(-spread, spread), rng.uniform(-1, 1)) for i in range(n)]
    rows += [(1000 + i, 3.0 + rng.uniform(0, 0.2), -3.0 + rng.uniform(0, 0.2), 0.0) for i in range(120)]  # a dense cell
    rows += [(2000 + i, rng.choice((3.9, 4.15)), -3.0 + 0.05 * (i % 5), 0.0) for i in range(40)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, pid int, x double, y double, z double")
    got = {r.cluster: r.n for r in points.euclid_clusters(df, ["k"], "pid", 1.0, 2).collect()}
    assert got == plain_clusters(rows, 1.0, 2)


def test_links_grow_with_cells_not_with_points(spark):
    rng = random.Random(1)
    dense = [(1, i, rng.uniform(0, 2.0), rng.uniform(0, 2.0), 0.0) for i in range(3_000)]
    df = spark.createDataFrame(dense, "k int, pid int, x double, y double, z double")
    links, placed = points.cell_links(df, ["k"], "pid", 1.0)
    assert placed.select("a").distinct().count() <= 16 and links.count() <= 16 * 15 / 2
    assert points.euclid_clusters(df, ["k"], "pid", 1.0, 1).count() == 1


def test_maps_are_kept_apart(spark):
    g = grid.Geometry(4.0, 4.0, 1.0)
    cells = spark.createDataFrame([(m, x, y, float(10 * m + x)) for m in (1, 2) for x in range(4) for y in range(4)], "map_id int, ix int, iy int, h double")
    asked = spark.createDataFrame([(m, 5, 0.5, 0.5) for m in (1, 2)], "map_id int, query_id int, x double, y double")
    from fieldscan.operators import mapping, sampling

    near = {r.map_id: r.value for r in grid.sample_nearest(cells, asked, g, "h").collect()}
    assert near == {1: 11.0, 2: 21.0}
    for sample in (grid.sample_linear, mapping.sample_convolved, sampling.sample_cubic):
        got = {r.map_id: r.value for r in sample(cells, asked.withColumn("x", F.lit(0.0)), g, "h").collect()}
        assert got == pytest.approx({1: 11.5, 2: 21.5}), sample
    both = grid.merge_maps(cells, cells.where("map_id = 2").withColumn("h", F.col("h") + 1), "h", True)
    assert {(r.map_id, r.h) for r in both.where("ix = 0 AND iy = 0").collect()} == {(1, 10.0), (2, 21.0)}
    turned = mapping.rotate_map(cells, g, "h", math.pi / 2)
    assert turned.count() == 32 and {r.map_id for r in turned.collect()} == {1, 2}
    assert mapping.transform_map(cells, g, "h", [], 0.0, (0.0, 0.0, 1.0)).count() == 32


@pytest.mark.parametrize("most", [4, 64])
def test_nearest_anywhere_in_uneven_density(spark, most):
    rng = random.Random(most)
    rows = [(1, i, rng.uniform(0, 0.1), rng.uniform(0, 0.1), 0.0) for i in range(200)] + [(1, 500 + i, rng.uniform(-90, 90), rng.uniform(-90, 90), rng.uniform(-5, 5)) for i in range(40)]
    rows += [(2, 900 + i, float(i), 0.0, 0.0) for i in range(3)] + [(1, 800 + i, 50.0, 50.0, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, id int, x double, y double, z double")
    asked = df.where("id % 3 = 0")
    got = {}
    for r in points.knn_anywhere(asked, df, ["k"], ["id"], 5, ["id"], most).collect():
        got.setdefault((r.k, r.id), []).append((r["rank"], r.p_id))
    for k, i, *at in rows:
        if i % 3:
            continue
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(at, r[2:], strict=True)), 9), r[1]) for r in rows if r[0] == k)[:5]
        assert sorted(got[k, i]) == [(n + 1, p) for n, (_, p) in enumerate(near)]
    assert points.knn_anywhere(asked.limit(0), df, ["k"], ["id"], 5, ["id"]).count() == 0
    assert points.start_radius(df, ["k"], most) < 0.2
