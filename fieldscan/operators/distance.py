"""Exact distances on grid maps: a separable min-plus transform, one line at a time.

The distance between a cell and another cell's border is, per axis, max(|difference| - 0.5, 0). For seeds s given on some cells
the transform is, for each cell, the least squared distance to a cell plus that cell's seed. It is taken along y and then along
x. Along a line the cell that gives the least never moves back as the place moves on, so the places in the middle are
settled first and bound those between them: n log n for a line, at any distance and with any seeds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def border_min(v: np.ndarray, seeds: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each place of q, rising, the least of seeds + max(|q - v| - 0.5, 0)^2; v rises too. Infinite seeds are none."""
    known = np.isfinite(seeds)
    v, seeds = v[known], seeds[known]
    n, out = len(q), np.full(len(q), np.inf)
    if not len(v) or not n:
        return out
    arg, step = np.zeros(n, dtype=np.int64), 1 << (n - 1).bit_length()
    while step:
        k = np.arange(step - 1, n, 2 * step)
        low = np.where(k >= step, arg[np.maximum(k - step, 0)], 0)
        high = np.where(k + step < n, arg[np.minimum(k + step, n - 1)], len(v) - 1)
        size = high - low + 1
        start = np.cumsum(size) - size
        row = np.repeat(np.arange(len(k)), size)
        c = np.arange(len(row)) - np.repeat(start - low, size)
        value = seeds[c] + np.maximum(np.abs(q[k][row] - v[c]) - 0.5, 0) ** 2
        if len(k):
            out[k] = np.minimum.reduceat(value, start)
            best = np.flatnonzero(value == out[k][row])[::-1]
            arg[k[row[best]]] = c[best]  # the first of equals, written last
        step >>= 1
    return out


def along(cells: DataFrame, line: list[str], place: str, seeds: list[str], fill: bool) -> DataFrame:
    """The transform of each seed column along lines (the columns `line`), places in `place`.

    With fill, every place from _low to _high of the line is given; else those of rows with `here`. A task holds one line.
    """
    names = [*line, place, "here", *seeds, *(["_low", "_high"] if fill else [])]
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in [*line, place, "here"]) + "".join(f", {s} double" for s in seeds)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows[place].to_numpy()
        q, here = v, rows["here"].to_numpy(dtype=bool)
        if fill:
            q = np.arange(rows["_low"].iat[0], rows["_high"].iat[0] + 1)
            there, here = v[here], np.zeros(len(q), dtype=bool)
            here[there - q[0]] = True
        found = {s: border_min(v, rows[s].to_numpy(dtype=float, na_value=np.inf), q) for s in seeds}
        out = pd.DataFrame({**{c: np.repeat(rows[c].iloc[:1].to_numpy(), len(q)) for c in line}, place: q, "here": here, **found})
        return out if fill else out[here]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = (pdf[line] != pdf[line].shift()).any(axis=1).to_numpy()
            edges = np.flatnonzero(new)
            held = pdf.iloc[edges[-1] :] if len(edges) else pdf
            done = [one(pdf.iloc[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            if done:
                yield pd.concat(done, ignore_index=True)
        if held is not None and len(held):
            yield one(held)

    return cells.select(*names).repartition(*line).sortWithinPartitions(*line, place).mapInPandas(run, schema)


def border_transform(cells: DataFrame, key: list[str], seeds: list[str]) -> DataFrame:
    """(key, ix, iy, and the transform of each seed column) for each cell of maps (key, ix, iy, seeds) that has a seed; a null seed
    is none. A cell that occurs twice counts with its lesser seeds."""
    once = cells.groupBy(*key, "ix", "iy").agg(*(F.min(s).cast("double").alias(s) for s in seeds))
    once = once.withColumn("here", F.coalesce(*seeds).isNotNull())
    bounds = once.groupBy(*key).agg(F.min("iy").alias("_low"), F.max("iy").alias("_high"))
    columns = along(once.join(bounds, key), [*key, "ix"], "iy", seeds, True)
    return along(columns, [*key, "iy"], "ix", seeds, False).select(*key, "ix", "iy", *seeds)


def distance_2d(cells: DataFrame, occupied: Column, key: list[str] | None = None) -> DataFrame:
    """Distance in cells from each cell to the nearest cell of the other kind's border, negative inside obstacles; infinite, of
    either sign, in a map without a cell of the other kind. Cells that a map has not are neither kind; null is not occupied."""
    key = key or ["map_id"]
    seed = lambda flag: F.when(F.coalesce(occupied.cast("boolean"), F.lit(False)) == flag, 0.0)
    out = border_transform(cells.select(*key, "ix", "iy", seed(True).alias("_to_occ"), seed(False).alias("_to_free")), key, ["_to_occ", "_to_free"])
    d = F.when(F.col("_to_occ") == 0, -F.sqrt("_to_free")).otherwise(F.sqrt("_to_occ"))
    return out.select(*key, "ix", "iy", d.alias("distance"))


def distance_3d(cells: DataFrame, layer: str, heights: list[float], resolution: float) -> DataFrame:
    """(map_id, iz, ix, iy, distance): for each height h the signed distance to the surface that the layer z is.

    To terrain a cell's seed is ((h - z) / resolution)^2 where h is above z and 0 where it is not, to free space the other way
    round; the distance is the first less the second, in metres. Above all terrain it is the way down to it, below all of it minus
    the way up. Cells without a height are no terrain and get no distance. Each height is a map of its own, so they run side by side.
    """
    stacked = cells.withColumn("_z", F.explode(F.array(*[F.struct(F.lit(k).alias("iz"), F.lit(float(h)).alias("h")) for k, h in enumerate(heights)])))
    rise = (F.col("_z.h") - F.col(layer)) / resolution
    square = lambda c: F.when(~F.isnan(layer) & F.col(layer).isNotNull(), c * c)
    seeded = stacked.select("map_id", F.col("_z.iz").alias("iz"), "ix", "iy", square(F.greatest(rise, F.lit(0.0))).alias("_over"), square(F.least(rise, F.lit(0.0))).alias("_under"))
    out = border_transform(seeded, ["map_id", "iz"], ["_over", "_under"])
    return out.select("map_id", "iz", "ix", "iy", (resolution * (F.sqrt("_over") - F.sqrt("_under"))).alias("distance"))
