"""Every registered query of the robot-telemetry and grid operators, with the SQL that states the same result."""

from __future__ import annotations

from .plans import extra, folds, lidar, live, maps, motion, rings, space, vision

flagship = motion.flagship
ALL = {**motion.QUERIES, **space.QUERIES, **folds.QUERIES, **vision.QUERIES, **maps.QUERIES, **extra.QUERIES, **lidar.QUERIES, **rings.QUERIES, **live.QUERIES}


def queries() -> dict:
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
