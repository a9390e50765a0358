"""More on scans (scan_id, beam, angle, range): neighbour shadows, gaps, compensation, revolutions, directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fold import delayed_fold


def shadow_filter_neighbours(beams: DataFrame, n: int, d: float, increment: float) -> DataFrame:
    """A beam's window counts when at least n of the beams at +-n lie within d metres of it; a beam is kept in any window
    of n beams, from a counting one on. Places outside the scan are not looked at."""
    span = F.array(*[F.lit(k) for k in range(-n, n + 1) if k])
    sent = beams.where("range IS NOT NULL").withColumn("_k", F.explode(span)).select("scan_id", (F.col("beam") + F.col("_k")).alias("beam"), F.col("range").alias("_r"), (F.col("_k") * increment).alias("_a"))
    both = beams.join(sent, ["scan_id", "beam"])
    near = F.sqrt(F.col("range") * F.col("range") + F.col("_r") * F.col("_r") - 2 * F.col("range") * F.col("_r") * F.cos("_a")) <= d
    ok = both.groupBy("scan_id", "beam").agg((F.count_if(near) >= n).alias("_ok"))
    w = W.partitionBy("scan_id").orderBy("beam").rowsBetween(-(n - 1), 0)
    out = beams.join(ok, ["scan_id", "beam"], "left").withColumn("_c", F.bool_or(F.coalesce("_ok", F.lit(False))).over(w))
    return out.withColumn("kept", F.when(F.col("_c"), F.col("range"))).drop("_ok", "_c")


def fill_bright_gaps(beams: DataFrame, n: int, bright: float = 200.0) -> DataFrame:
    """beams (scan_id, beam, range, energy) with `filled` and `filled_energy`: one missing beam, or two in a row, get the
    mean of the seen beams at both sides where these are bright (energy above `bright`) and so is the next one on at least
    one side, or, for two, on both. Around the circle of n beams; what is filled does not light up later gaps."""
    columns = ["scan_id", "beam", "range", "energy"]
    ring = beams.select(*columns)
    low = ring.where(F.col("beam") < 3).withColumn("beam", F.col("beam") + n)
    high = ring.where(F.col("beam") >= n - 4).withColumn("beam", F.col("beam") - n)
    w = W.partitionBy("scan_id").orderBy("beam")
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    lit = lambda k: F.coalesce(at("range", k).isNotNull() & (at("energy", k) > bright), F.lit(False))
    one = (lit(-1) & lit(1) & lit(2)) | (lit(-1) & lit(-2) & lit(1))
    first = lit(-1) & lit(-2) & ~lit(1) & lit(2) & lit(3)
    second = lit(-2) & lit(-3) & ~lit(-1) & lit(1) & lit(2)

    def filled(c: str):
        mean = lambda a, b: (at(c, a) + at(c, b)) / 2
        gap = F.when(one, mean(-1, 1)).when(first, mean(-1, 2)).when(second & at("range", -1).isNull(), mean(-2, 1))
        return F.when(F.col("range").isNotNull(), F.col(c)).otherwise(gap)

    padded = ring.unionByName(low.select(*columns)).unionByName(high.select(*columns))
    out = padded.withColumns({"filled": filled("range"), "filled_energy": filled("energy")})
    return out.where(F.col("beam").between(0, n - 1))


class GapWalk:
    """Fills gaps of one scan beam by beam; what was filled lights up later gaps. Beams below 0 are copies of the last ones, as
    they were, and those from n on of the first ones, as they became. Three beams ahead and two behind are held."""

    def __init__(self, n: int, bright: float):
        self.n, self.bright = n, bright
        self.beams: list[list] = []  # [beam, range, energy], the oldest not yet given
        self.first: list[list] = []
        self.at = 0  # the beam to look at next

    def push(self, row: dict) -> list[dict]:
        beam = [row["beam"], row["range"], row["energy"]]
        if 0 <= row["beam"] < 3:
            self.first.append(beam)
        if row["beam"] >= self.n:
            beam[1:] = self.first[row["beam"] - self.n][1:]
        self.beams.append(beam)
        while self.beams and self.at < self.n and self.at + 3 <= self.beams[-1][0]:
            self.look()
        return self.release(self.at - 2)

    def finish(self) -> list[dict]:
        return self.release(self.n + 3)

    def release(self, before: int) -> list[dict]:
        out = []
        while self.beams and self.beams[0][0] < before:
            _, x, energy = self.beams.pop(0)
            out.append({"filled": x, "filled_energy": energy})
        return out

    def look(self) -> None:
        here = self.at - self.beams[0][0]
        if self.beams[here][1] is not None:
            self.at += 1
            return
        near = lambda k: self.beams[here + k]
        lit = {k: near(k)[1] is not None and (near(k)[2] or 0) > self.bright for k in (-2, -1, 1, 2, 3)}
        if lit[-1] and lit[1] and (lit[2] or lit[-2]):
            fill, other = [0], 1
        elif lit[-1] and lit[-2] and not lit[1] and lit[2] and lit[3]:
            fill, other = [0, 1], 2
        else:
            self.at += 1
            return
        mean = [(near(-1)[i] + near(other)[i]) / 2 for i in (1, 2)]
        for k in fill:
            near(k)[1:] = mean
        self.at += 2


def fill_bright_gaps_in_order(beams: DataFrame, n: int, bright: float = 200.0) -> DataFrame:
    """As fill_bright_gaps, but beam after beam from 0 on: a filled beam lights up the gaps after it, also over the seam, where
    a gap of the last and the first beam is filled at the end. A task holds six beams."""
    columns = ["scan_id", "beam", "range", "energy"]
    ring = beams.select(*columns)
    before = ring.where(F.col("beam") >= n - 2).withColumn("beam", F.col("beam") - n)
    after = ring.where(F.col("beam") < 3).withColumn("beam", F.col("beam") + n)
    rows = ring.unionByName(before).unionByName(after).withColumns({"t": F.col("beam").cast("double"), "seq": F.col("beam")})
    done = delayed_fold(rows, ["scan_id"], ["beam", "range", "energy"], "filled double, filled_energy double", lambda: GapWalk(n, bright))
    # beam n is the first one again, as the end of the scan left it
    once = done.where(F.col("beam").between(0, n)).groupBy("scan_id", (F.col("beam") % n).alias("beam"))
    return once.agg(F.min_by("range", "t").alias("range"), F.min_by("energy", "t").alias("energy"), F.max("filled").alias("filled"), F.max("filled_energy").alias("filled_energy"))


def angle_compensate(beams: DataFrame, mult: int, degrees: Column) -> DataFrame:
    """Seen beams into 360 * mult bins, each filling mult bins from floor(angle * mult), capped at the last; the last beam
    wins."""
    first = F.floor(degrees * mult).cast("int")
    filled = beams.where("range IS NOT NULL").withColumn("bin", F.explode(F.sequence(first, F.least(first + mult - 1, F.lit(360 * mult - 1)))))
    return filled.groupBy("scan_id", "bin").agg(F.max_by("range", "beam").alias("range"))


def assemble_revolutions(packets: DataFrame, collect_angle: int, whole: int = 3600) -> DataFrame:
    """Packets (device_id, seq, angle, span, n), tenths of a degree, up to the one that reaches collect_angle make a
    revolution; whole tells whether their spans add up."""
    w = W.partitionBy("device_id").orderBy("seq")
    end = ((F.col("angle") < collect_angle) & (F.col("angle") + F.col("span") >= collect_angle)).cast("int")
    out = packets.withColumn("_e", end).withColumn("revolution", F.coalesce(F.sum("_e").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return out.groupBy("device_id", "revolution").agg(F.count("*").alias("packets"), F.sum("n").alias("points"), (F.sum("span") == whole).alias("whole"))


def revolution_losses(revolutions: DataFrame) -> DataFrame:
    """Per device its whole revolutions, and how many were dropped for being incomplete, with their packets and points."""
    lost = ~F.coalesce(F.col("whole"), F.lit(False))
    sums = [F.coalesce(F.sum(F.when(lost, F.col(c))), F.lit(0)).alias(f"lost_{c}") for c in ("packets", "points")]
    return revolutions.groupBy("device_id").agg(F.count_if(~lost).alias("revolutions"), F.count_if(lost).alias("lost"), *sums)


def scan_stats(beams: DataFrame, far: float) -> DataFrame:
    """(scan_id, n_valid, nearest): beams nearer than far, and the nearest range."""
    return beams.groupBy("scan_id").agg(F.count_if(F.col("range") < far).alias("n_valid"), F.min("range").alias("nearest"))


def sector_histogram(beams: DataFrame, per_sector: int, near: float, far: float) -> DataFrame:
    """(scan_id, sector, level): the sum of far - range over a sector's beams from near to far; others add nothing."""
    close = F.when(F.col("range").between(near, far), far - F.col("range"))
    sectors = beams.withColumn("sector", F.floor(F.col("beam") / per_sector).cast("int"))
    return sectors.groupBy("scan_id", "sector").agg(F.coalesce(F.sum(close), F.lit(0.0)).alias("level"))


def mask_angles(beams: DataFrame, low: float, high: float, masks: list[tuple[float, float]], near: float, far: float) -> DataFrame:
    """Beams with low <= angle <= high; inside a mask or outside the limits they stay, as missing."""
    hidden = ~F.coalesce(F.col("range").between(near, far), F.lit(False))
    for a, b in masks:
        hidden = hidden | ((F.col("angle") > a) & (F.col("angle") < b))
    return beams.where(F.col("angle").between(low, high)).withColumn("range", F.when(~hidden, F.col("range")))


def best_direction(levels: DataFrame, beams: DataFrame, goal: float, n: int, cone: float, near: float, far: float, free: float = 0.1) -> DataFrame:
    """(scan_id, direction) in degrees: the goal where the beams (scan_id, degrees, range) from `cone` before it to `cone` behind
    it lack less than `free` to `far`, summed; else the border between two of the n sectors (scan_id, sector, level) that are
    both free, nearest to it around the circle, the lower sector first at equal distance; else -1."""
    ahead = F.pmod(F.col("degrees") - goal + cone, F.lit(360.0)) < 2 * cone
    close = F.when(ahead & (F.col("range") >= near) & (F.col("range") < far), far - F.col("range"))
    ways = beams.groupBy("scan_id").agg((F.coalesce(F.sum(close), F.lit(0.0)) < free).alias("_open"))
    ring = levels.unionByName(levels.where("sector = 0").withColumn("sector", F.lit(n)))
    w = W.partitionBy("scan_id").orderBy("sector")
    pairs = ring.withColumn("_next", F.lead("level").over(w)).where(F.col("sector") < n)
    both = (F.col("level") < free) & (F.col("_next") < free)
    border = F.pmod(F.col("sector") + 1, F.lit(n)) * (360.0 / n)
    gap = F.least(F.pmod(border - goal, F.lit(360.0)), F.pmod(goal - border, F.lit(360.0)))
    best = pairs.groupBy("scan_id").agg(F.min_by(F.when(both, border), F.when(both, F.struct(F.round(gap, 9), "sector"))).alias("_best"))
    return ways.join(best, "scan_id", "left").select("scan_id", F.when(F.col("_open"), F.lit(float(goal))).otherwise(F.coalesce("_best", F.lit(-1.0))).alias("direction"))
