"""Point clouds and their joins: voxels, neighbours within a radius, boxes, polygons, planes and clusters."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.store import saved, shuffled


def voxel(size: float, axes: str = "xyz") -> list[Column]:
    return [F.floor(F.col(a) / size).alias(f"v{a}") for a in axes]


def voxel_downsample(points: DataFrame, key: list[str], leaf: float) -> DataFrame:
    """Centroid and number of the points of each voxel."""
    return points.groupBy(*key, *voxel(leaf)).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def voxel_nearest_center(points: DataFrame, key: list[str], size: float, tie: list[str]) -> DataFrame:
    """Of each voxel's points the one nearest its centre, ties by the tie columns."""
    cells = points.select("*", *voxel(size))
    d2 = reduce(lambda a, b: a + b, [F.pow(F.col(a) - (F.col(f"v{a}") + 0.5) * size, 2) for a in "xyz"])
    keep = [c for c in points.columns if c not in key]
    best = cells.withColumn("_d2", F.round(d2, 9)).groupBy(*key, "vx", "vy", "vz").agg(F.min_by(F.struct(*keep), F.struct("_d2", *tie)).alias("p"))
    return best.select(*key, "p.*")


def dedup_cells(points: DataFrame, key: list[str], size: float, order: list[str]) -> DataFrame:
    """(key, cx, cy, and the columns of order): of the points of a key in one square of the ground the last in order."""
    cells = [F.floor(F.col(a) / size).alias(f"c{a}") for a in "xy"]
    return points.groupBy(*key, *cells).agg(F.max(F.struct(*order)).alias("p")).select(*key, "cx", "cy", "p.*")


def radius_join(queries: DataFrame, points: DataFrame, key: list[str], radius: float, axes: str = "xyz", bounds: list[tuple[float, float]] | None = None) -> DataFrame:
    """(query columns, point columns as p_<name>, d2) of all pairs of one key within the radius.

    Space is cut into cells of the radius; each query looks into its own and the neighbouring cells, so the join is on
    cells and grows with the pairs near each other. Queries are the side that multiplies (3^axes): give the smaller one. With
    bounds, the least and largest coordinate of the points on each axis, cells beyond them are not looked into.
    """
    offsets = F.array(*[F.array(*[F.lit(int(x)) for x in c]) for c in _offsets(len(axes))])
    q = queries.withColumn("_o", F.explode(offsets))
    q = q.select(*queries.columns, *[(F.floor(F.col(a) / radius) + F.get("_o", F.lit(i))).alias(f"_c{a}") for i, a in enumerate(axes)])
    for a, (low, high) in zip(axes, bounds or [], strict=bool(bounds)):
        q = q.where(F.col(f"_c{a}").between(math.floor(low / radius), math.floor(high / radius)))
    p = points.select(*[F.col(k).alias(k) for k in key], *[F.col(c).alias(f"p_{c}") for c in points.columns if c not in key], *[F.floor(F.col(a) / radius).alias(f"_c{a}") for a in axes])
    d2 = reduce(lambda a, b: a + b, [F.pow(F.col(a) - F.col(f"p_{a}"), 2) for a in axes])
    cells = [f"_c{a}" for a in axes]
    return q.join(p, [*key, *cells]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop(*cells)


def _offsets(n: int, reach: int = 1) -> list[tuple[int, ...]]:
    return [()] if n == 0 else [(*rest, k) for rest in _offsets(n - 1, reach) for k in range(-reach, reach + 1)]


def knn_join(queries: DataFrame, points: DataFrame, key: list[str], query_id: list[str], k: int, radius: float, tie: list[str], bounds: list[tuple[float, float]] | None = None) -> DataFrame:
    """The k nearest points within the radius, with their rank; fewer where there are fewer."""
    near = radius_join(queries, points, key, radius, bounds=bounds).withColumn("_d", F.round("d2", 9))
    rank = F.row_number().over(W.partitionBy(*key, *query_id).orderBy("_d", *[f"p_{t}" for t in tie]))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).drop("_d")


def bounds_of(points: DataFrame) -> list[tuple[float, float]]:
    """The least and largest coordinate on each axis; none without points."""
    r = points.agg(*[f(a).cast("double") for a in "xyz" for f in (F.min, F.max)]).first()
    return [] if None in r else [(r[0], r[1]), (r[2], r[3]), (r[4], r[5])]


def start_radius(points: DataFrame, key: list[str], most: int, bounds: list[tuple[float, float]] | None = None, levels: int = 16) -> float:
    """The largest of the extent's halves, quarters, ... such that no cell of that side has more than `most` points of a key; the
    smallest of them where none has."""
    extent = max([high - low for low, high in (bounds_of(points) if bounds is None else bounds)] or [1.0]) or 1.0
    # from coarse to fine, a level a job: most levels are never counted, and coarse cells are few
    for level in range(levels + 1):
        cells = points.groupBy(*key, *[F.floor(F.col(a) * 2.0**level / extent).alias(f"_c{a}") for a in "xyz"]).count()
        if (cells.agg(F.max("count")).first()[0] or 0) <= most:
            return extent / 2**level
    return extent / 2**levels


def knn_anywhere(queries: DataFrame, points: DataFrame, key: list[str], query_id: list[str], k: int, tie: list[str], most: int = 64) -> DataFrame:
    """(key, query_id, p_<name> of the point, d2, rank): the k nearest points of each query's key, however far; all where there are
    fewer. Ties as in knn_join.

    The first radius is so small that no cell is crowded, so where points are dense few are compared. Queries that have not found
    enough look twice as far, and only they, in rounds that are written and read: a query's cells grow until they hold k.
    """
    have = points.groupBy(*key).agg(F.least(F.count("*"), F.lit(k)).alias("_need"))
    bounds = bounds_of(points)
    left, radius, done = saved(queries.join(have, key)), start_radius(points, key, most, bounds), []
    while not left.isEmpty():
        near = saved(knn_join(left, points, key, query_id, k, radius, tie, bounds))
        found = near.groupBy(*key, *query_id).agg(F.count("*").alias("_n"))
        enough = left.join(found, [*key, *query_id]).where("_n >= _need").select(*key, *query_id)
        kept = [c for c in near.columns if c not in queries.columns or c in (*key, *query_id)]
        done.append(near.select(*kept).drop("_need").join(enough, [*key, *query_id], "left_semi"))
        left, radius = saved(left.join(enough, [*key, *query_id], "left_anti")), radius * 2
    if not done:
        return knn_join(queries, points, key, query_id, k, radius, tie).select(*key, *query_id, *[f"p_{c}" for c in points.columns if c not in key], "d2", "rank")
    return reduce(DataFrame.unionByName, done)


def in_box(points: DataFrame, boxes: DataFrame, tile: float, keep: bool = True) -> DataFrame:
    """Points inside any box (x0, x1, y0, y1, z0, z1), borders included; with keep=False those in none. Any number of boxes:
    both sides meet on tiles of the ground, and a point stays one row."""
    span = lambda a: F.sequence(F.floor(F.col(f"{a}0") / tile), F.floor(F.col(f"{a}1") / tile))
    tiles = boxes.withColumn("_tx", F.explode(span("x"))).withColumn("_ty", F.explode(span("y")))
    p = points.withColumn("_tx", F.floor(F.col("x") / tile)).withColumn("_ty", F.floor(F.col("y") / tile))
    same = [p[c] == tiles[c] for c in ("_tx", "_ty")] + [p[a].between(tiles[f"{a}0"], tiles[f"{a}1"]) for a in "xyz"]
    return p.join(tiles, reduce(lambda a, b: a & b, same), "left_semi" if keep else "left_anti").drop("_tx", "_ty")


def box_join(points: DataFrame, boxes: DataFrame, tile: float) -> DataFrame:
    """(point columns, box_id) of points inside boxes, for any number of boxes: both sides meet on tiles of the ground."""
    span = lambda a: F.sequence(F.floor(F.col(f"{a}0") / tile), F.floor(F.col(f"{a}1") / tile))
    tiles = boxes.withColumn("_tx", F.explode(span("x"))).withColumn("_ty", F.explode(span("y")))
    p = points.withColumn("_tx", F.floor(F.col("x") / tile)).withColumn("_ty", F.floor(F.col("y") / tile))
    inside = reduce(lambda a, b: a & b, [F.col(a).between(F.col(f"{a}0"), F.col(f"{a}1")) for a in "xyz"])
    return p.join(tiles, ["_tx", "_ty"]).where(inside).select(*points.columns, "box_id")


def point_in_polygon(x: Column, y: Column, vertices: list[tuple[float, float]]) -> Column:
    """Even-odd rule with half-open edges for a fixed polygon."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, [*vertices[1:], vertices[0]], strict=True):
        if y1 != y2:
            at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
            crossings = crossings + (((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at)).cast("int")
    return crossings % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, tile: float) -> DataFrame:
    """(point columns, poly_id) of points inside polygons (poly_id, vertices array<struct<x, y>>), for any number of them:
    tiles of the bounding box pick candidates, crossings are folded over the vertices."""
    lo, hi = (lambda a: F.array_min(f"vertices.{a}")), (lambda a: F.array_max(f"vertices.{a}"))
    tiles = polygons
    for a in "xy":
        tiles = tiles.withColumn(f"_t{a}", F.explode(F.sequence(F.floor(lo(a) / tile), F.floor(hi(a) / tile))))
    p = points.withColumn("_tx", F.floor(F.col("x") / tile)).withColumn("_ty", F.floor(F.col("y") / tile))
    both = p.join(tiles, ["_tx", "_ty"])
    ahead = F.concat(F.slice("vertices", 2, F.size("vertices") - 1), F.slice("vertices", 1, 1))
    edges = F.zip_with("vertices", ahead, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = lambda e: ((e["a"]["y"] > F.col("y")) != (e["b"]["y"] > F.col("y"))) & (F.col("x") < e["a"]["x"] + (F.col("y") - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"]))
    return both.where(F.size(F.filter(edges, hit)) % 2 == 1).select(*points.columns, "poly_id")


def polygon_measures(polygons: DataFrame) -> DataFrame:
    """Shoelace area, centroid and bounding box of (poly_id, vertices)."""
    ahead = F.concat(F.slice("vertices", 2, F.size("vertices") - 1), F.slice("vertices", 1, 1))
    edges = F.zip_with("vertices", ahead, lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("u"), b["y"].alias("v")))
    total = lambda f: F.aggregate("_e", F.lit(0.0), lambda s, e: s + f(e))
    cross = lambda e: e["x"] * e["v"] - e["u"] * e["y"]
    out = polygons.withColumn("_e", edges).withColumn("_a", total(cross) / 2)
    out = out.withColumn("area", F.abs("_a")).withColumn("cx", total(lambda e: (e["x"] + e["u"]) * cross(e)) / (6 * F.col("_a"))).withColumn("cy", total(lambda e: (e["y"] + e["v"]) * cross(e)) / (6 * F.col("_a")))
    for a in "xy":
        out = out.withColumn(f"{a}0", F.array_min(f"vertices.{a}")).withColumn(f"{a}1", F.array_max(f"vertices.{a}"))
    return out.drop("_e", "_a", "vertices")


def convex_hull(points: DataFrame, key: list[str], many: int = 100_000) -> DataFrame:
    """(key, step, x, y): the hull of each group, counter-clockwise from the smallest point. Each task first keeps, of about `many`
    rows at a time, only hull points of each group, so a large group meets as a few points: the hull of hulls is the hull."""
    import pandas as pd

    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in key)

    def hulls(pdf: pd.DataFrame, least: int) -> pd.DataFrame:
        """The hull points of each group with their step; groups of fewer than `least` rows as they are."""
        pdf = pdf.reset_index(drop=True)
        number = pdf.groupby(key, sort=False).ngroup().to_numpy()
        order = np.lexsort((pdf["y"].to_numpy(), pdf["x"].to_numpy(), number))
        x, y = pdf["x"].to_numpy()[order].tolist(), pdf["y"].to_numpy()[order].tolist()
        ends = [0, *(np.flatnonzero(np.diff(number[order])) + 1).tolist(), len(order)]
        rows, steps = [], []
        for low, high in zip(ends[:-1], ends[1:], strict=True):
            kept = range(low, high) if high - low < least else chain(x, y, low, high)
            rows += kept
            steps += range(len(kept))
        return pdf.iloc[order[rows]].assign(step=np.array(steps, dtype=np.int32))

    def local(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= many:
                yield hulls(pd.concat(held), 8)[[*key, "x", "y"]]
                held, n = [], 0
        if n:
            yield hulls(pd.concat(held), 8)[[*key, "x", "y"]]

    def whole(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            same = (held[key] == held[key].iloc[-1]).all(axis=1)
            done = held[~same]  # rows of a group are together, so only the last may go on
            if len(done):
                yield hulls(done, 0)[[*key, "step", "x", "y"]]
            held = held[same]
        if held is not None and len(held):
            yield hulls(held, 0)[[*key, "step", "x", "y"]]

    pruned = points.select(*key, "x", "y").dropna().mapInPandas(local, f"{types}, x double, y double")
    return pruned.repartition(*key).sortWithinPartitions(*key).mapInPandas(whole, f"{types}, step int, x double, y double")


def chain(x: list[float], y: list[float], low: int, high: int) -> list[int]:
    """Places of the hull's points, counter-clockwise, among the points low to high in order of (x, y); of equal ones, one."""
    at = [k for k in range(low, high) if k == low or x[k] != x[k - 1] or y[k] != y[k - 1]]
    if len(at) < 3:
        return at

    def half(places: list[int]) -> list[int]:
        out: list[int] = []
        for k in places:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[k] - y[out[-2]]) <= (y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-2]]):
                out.pop()
            out.append(k)
        return out[:-1]

    return half(at) + half(at[::-1])


def fit_planes(neighbours: DataFrame, key: list[str]) -> DataFrame:
    """Least-squares plane a x + b y + c z = -1 of each group's points, by Cramer's rule on sums of products; null when the
    points do not span one."""
    sums = {f"s{a}{b}": F.sum(F.col(a) * F.col(b)) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")} | {f"s{a}": F.sum(a) for a in "xyz"}
    g = neighbours.groupBy(*key).agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    m = [["sxx", "sxy", "sxz"], ["sxy", "syy", "syz"], ["sxz", "syz", "szz"]]
    rhs = ["sx", "sy", "sz"]

    def det(rows: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g_, h, i) = rows
        return a * (e * i - f * h) - b * (d * i - f * g_) + c * (d * h - e * g_)

    cols = [[F.col(x) for x in row] for row in m]
    whole = det(cols)
    parts = {name: det([[-F.col(rhs[r]) if c == k else cols[r][c] for c in range(3)] for r in range(3)]) for k, name in enumerate("abc")}
    return g.select(*key, "n", *[F.when(F.abs(whole) > 1e-9, p / whole).alias(name) for name, p in parts.items()])


def plane_validity(neighbours: DataFrame, planes: DataFrame, key: list[str], most: float) -> DataFrame:
    """planes (key, a, b, c) with `residual`, the largest distance of one of its points from a plane, and `valid`: whether no point is
    farther than `most`. A group without a plane is not valid."""
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    away = F.try_divide(F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + 1), norm)
    worst = neighbours.join(planes.select(*key, *"abc"), key).groupBy(*key).agg(F.max(away).alias("residual"))
    return planes.join(worst, key, "left").withColumn("valid", F.coalesce(F.col("residual") <= most, F.lit(False)))


def cell_links(points: DataFrame, key: list[str], point_id: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """(key, a, b) links between cells that hold points within the tolerance of each other, and points with their cell, `a`. A
    cell, named by its smallest point_id, is so small that its own points are within the tolerance.

    Occupied cells meet the occupied ones at most two cells away. A pair is linked if the boxes about its points are near enough at
    their farthest, or if the point of each that is nearest to the other's middle are; it is left out if the boxes are too far at
    their nearest. Only of pairs that this leaves open, the points near the other's box are compared.
    """
    side, near2 = tolerance / 3**0.5 * (1 - 1e-9), tolerance * tolerance
    cell = [f"_c{a}" for a in "xyz"]
    placed = points.select(*key, point_id, *"xyz", *[F.floor(F.col(a) / side).alias(c) for a, c in zip("xyz", cell, strict=True)])
    boxes = [f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    cells = saved(placed.groupBy(*key, *cell).agg(F.min(point_id).alias("a"), *boxes))
    placed = saved(placed.join(shuffled(cells.select(*key, *cell, "a")), [*key, *cell]).drop(*cell))
    box = [f"{n}{a}" for a in "xyz" for n in ("lo", "hi")]
    ahead = [o for o in _offsets(3, 2) if o > (0, 0, 0)]
    looked = cells.withColumn("_o", F.explode(F.array(*[F.array(*[F.lit(v) for v in o]) for o in ahead])))
    looked = looked.select(*key, "a", *[(F.col(c) + F.get("_o", F.lit(i))).alias(c) for i, c in enumerate(cell)])
    # boxes come after cells have met: what is looked at is far more than what is found
    pairs = looked.join(shuffled(cells.select(*key, *cell, F.col("a").alias("b"))), [*key, *cell]).drop(*cell)
    pairs = pairs.join(shuffled(cells.select(*key, "a", *box)), [*key, "a"]).join(shuffled(cells.select(*key, F.col("a").alias("b"), *[F.col(c).alias(f"b_{c}") for c in box])), [*key, "b"])
    gap = lambda a: F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(f"b_hi{a}"), F.col(f"b_lo{a}") - F.col(f"hi{a}"))
    far = lambda a: F.greatest(F.col(f"hi{a}") - F.col(f"b_lo{a}"), F.col(f"b_hi{a}") - F.col(f"lo{a}"))
    square = lambda f: reduce(lambda p, q: p + q, [f(a) * f(a) for a in "xyz"])
    pairs = saved(pairs.where(square(gap) <= near2).withColumn("linked", square(far) <= near2))
    open_ = pairs.where("NOT linked")

    def facing(own: str, other: str) -> DataFrame:
        """For each open pair the point of one cell that is nearest to the middle of the other's box."""
        names = {c: (f"b_{c}" if own == "a" else c) for c in box}
        middle = [(F.col(names[f"lo{a}"]) + F.col(names[f"hi{a}"])) / 2 for a in "xyz"]
        wanted = open_.select(*key, "a", "b", *[m.alias(f"m{a}") for m, a in zip(middle, "xyz", strict=True)])
        own_points = placed.select(*key, F.col("a").alias(own), *"xyz")
        d2 = reduce(lambda p, q: p + q, [F.pow(F.col(a) - F.col(f"m{a}"), 2) for a in "xyz"])
        return wanted.join(shuffled(own_points), [*key, own]).groupBy(*key, "a", "b").agg(F.min_by(F.struct(*"xyz"), d2).alias(f"at_{own}"))

    both = facing("a", "b").join(shuffled(facing("b", "a")), [*key, "a", "b"])
    between = reduce(lambda p, q: p + q, [F.pow(F.col(f"at_a.{a}") - F.col(f"at_b.{a}"), 2) for a in "xyz"])
    met = saved(both.withColumn("linked", between <= near2).select(*key, "a", "b", "linked"))
    left = open_.drop("linked").join(shuffled(met.where("NOT linked").select(*key, "a", "b")), [*key, "a", "b"])

    def beside(own: str) -> DataFrame:
        """Points of one cell of a pair within the tolerance of the other's box."""
        names = {c: (f"b_{c}" if own == "a" else c) for c in box}
        wanted = left.select(*key, "a", "b", *[F.col(names[c]).alias(c) for c in box])
        near = wanted.join(shuffled(placed.select(*key, F.col("a").alias(own), *"xyz")), [*key, own])
        away = lambda a: F.greatest(F.lit(0.0), F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"))
        return near.where(square(away) <= near2).select(*key, "a", "b", *[F.col(a).alias(f"{a}_{own}") for a in "xyz"]).distinct()

    d2 = reduce(lambda p, q: p + q, [F.pow(F.col(f"{a}_a") - F.col(f"{a}_b"), 2) for a in "xyz"])
    compared = beside("a").join(shuffled(beside("b")), [*key, "a", "b"]).where(d2 <= near2).select(*key, "a", "b").distinct()
    links = pairs.where("linked").select(*key, "a", "b").unionByName(met.where("linked").select(*key, "a", "b")).unionByName(compared)
    return saved(links), placed


def euclid_clusters(points: DataFrame, key: list[str], point_id: str, tolerance: float, least: int) -> DataFrame:
    """(key, cluster, n, x, y, z): connected groups of points within the tolerance, named by their smallest point_id, with
    their centroid. Points of a small cell are one node, so links and labels grow with occupied cells, not with points near each
    other. Labels fall along links until none changes; each round is written and read, so lineage stays short."""
    links, placed = cell_links(points, key, point_id, tolerance)
    edges = saved(links.unionByName(links.select(*key, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = saved(placed.select(*key, "a").distinct().withColumn("label", F.col("a")))
    while True:
        seen = edges.join(shuffled(labels.withColumnRenamed("a", "b")), [*key, "b"]).groupBy(*key, "a").agg(F.min("label").alias("near"))
        step = labels.join(shuffled(seen), [*key, "a"], "left").select(*key, "a", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # a label is itself a cell: take that cell's label too, which halves the rounds
        hop = step.select(*key, F.col("a").alias("label"), F.col("label").alias("next"))
        now = saved(step.join(shuffled(hop), [*key, "label"]).select(*key, "a", "old", F.col("next").alias("label")))
        labels = now.select(*key, "a", "label")
        if now.where("old <> label").isEmpty():
            break
    sized = placed.join(shuffled(labels), [*key, "a"]).groupBy(*key, F.col("label").alias("cluster"))
    return sized.agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z")).where(F.col("n") >= least)
