"""Distance joins between point sets of the same group, on a grid of cells.

Cells are as wide as the radius, so partners can only sit in the 27 cells around a point. One side is
copied to those cells and both meet on (group, cell): a hot group is spread over its cells, and no pair
further than two cells apart is ever formed.

Rows of both sides are counted per cell first. The counts say which side is the smaller one, which is the
side that is copied, and which cells would give a task more rows than it should hold. Such a cell is
cut: rows of either side are dealt over as many parts as that side needs there, and meet all parts of the
other. The list of such cells is bounded by rows / task size. Callers that know the smaller side name it
and save the count.

Where no group has more than ``WHOLE_GROUP`` rows on either side, both sides meet on the group alone: some
hundred tests of distance cost less than 27 copies of a row. Otherwise targets are counted before they are
broadcast, since Spark's estimates leave the copies out.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.session import rows_per_task

XYZ = ("x", "y", "z")
_CELL = ("_cx", "_cy", "_cz")
_PARTS = ("_part_p", "_part_t")
# the cell is a hair wider than the radius, so rounding cannot push an edge partner two cells away
_SLACK = 1 + 1e-9
WHOLE_GROUP = 1_000
BROADCAST_ROWS = 500_000


def _in_cell(df: DataFrame, r: float, prefix: str = "") -> DataFrame:
    return df.withColumns({cell: F.floor(F.col(f"{prefix}{x}") / F.lit(r * _SLACK)) for cell, x in zip(_CELL, XYZ)})


def _around(cells: DataFrame) -> DataFrame:
    """Each row once per cell of its neighbourhood."""
    near = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    for cell in _CELL:
        cells = cells.withColumn("_d", F.explode(near)).withColumn(cell, F.col(cell) + F.col("_d")).drop("_d")
    return cells


def squared_distance() -> Column:
    return reduce(lambda a, b: a + b, [(F.col(x) - F.col(f"_t{x}")) * (F.col(x) - F.col(f"_t{x}")) for x in XYZ])


def small_groups(df: DataFrame, group: Sequence[str], limit: int = WHOLE_GROUP) -> bool:
    """Whether no group has more rows than may meet the other side without cells."""
    if not group:
        return False
    largest = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return largest <= min(limit, rows_per_task(df.sparkSession))


def layout(points: DataFrame, targets: DataFrame, r: float, group: Sequence[str]) -> tuple[str, DataFrame | None]:
    """The side to copy ("points" or "targets"), and the cells to cut with the parts each side needs there, if any."""
    cell = [*group, *_CELL]
    mine = _in_cell(points.select(*group, *XYZ), r).select(*cell, F.lit(1).alias("p"), F.lit(0).alias("t"))
    other = _in_cell(targets.select(*group, *XYZ), r).select(*cell, F.lit(0).alias("p"), F.lit(1).alias("t"))
    counts = mine.unionByName(other).dropna().groupBy(*cell).agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    n = counts.agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.max("p").alias("top_p"), F.max("t").alias("top_t")).first()
    copied, small, large = ("targets", "t", "p") if (n["t"] or 0) <= (n["p"] or 0) else ("points", "p", "t")
    limit = rows_per_task(points.sparkSession)
    if max(n[f"top_{large}"] or 0, 27 * (n[f"top_{small}"] or 0)) <= limit:
        return copied, None
    spread = _around(counts.select(*cell, F.col(small).alias("n"))).groupBy(*cell).agg(F.sum("n").alias(small))
    met = counts.select(*cell, large).join(spread, cell, "full_outer").where((F.col(small) > limit) | (F.col(large) > limit))
    parts = [F.greatest(F.ceil(F.coalesce(s, F.lit(0)) / limit), F.lit(1)).cast("int").alias(p) for s, p in zip("pt", _PARTS)]
    return copied, met.select(*cell, *parts)


def _dealt(df: DataFrame, cut: DataFrame | None, group: Sequence[str], own: str, other: str) -> DataFrame:
    """Rows of cut cells get a part of their own side and are copied to every part of the other side."""
    if cut is None:
        return df.withColumns({p: F.lit(0) for p in _PARTS})
    spread_by = F.xxhash64(*[c for c in df.columns if c not in _CELL])
    joined = df.join(F.broadcast(cut.withColumnsRenamed({p: f"_n{p}" for p in _PARTS})), [*group, *_CELL], "left")
    joined = joined.withColumn(own, F.pmod(spread_by, F.coalesce(f"_n{own}", F.lit(1))).cast("int"))
    joined = joined.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"_n{other}", F.lit(1)) - 1)))
    return joined.drop(*[f"_n{p}" for p in _PARTS])


def sides(
    points: DataFrame, targets: DataFrame, r: float, group: Sequence[str], extra: Sequence[str] = (), copied: str | None = None
) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides with cell and part columns, and whether a point can appear more than once.

    Target coordinates are named ``_tx, _ty, _tz``; equal targets are one.
    """
    cut = None
    if copied is None:
        copied, cut = layout(points, targets, r, group)
    right = targets.select(*group, *extra, *[F.col(x).alias(f"_t{x}") for x in XYZ]).distinct()
    left, right = _in_cell(points, r), _in_cell(right, r, "_t")
    if copied == "points":
        left = _around(left)
    else:
        right = _around(right)
    return _dealt(left, cut, group, *_PARTS), _dealt(right, cut, group, *reversed(_PARTS)), copied == "points" or cut is not None


def _meet(
    points: DataFrame,
    targets: DataFrame,
    r: float,
    group: Sequence[str],
    near: Column,
    how: str,
    extra: Sequence[str] = (),
    copied: str | None = None,
    whole: bool | None = None,
) -> DataFrame:
    """Join on nearness; ``how`` is inner (a row per pair), left_semi or left_anti.

    Where a point may sit in several cells or parts, semi and anti joins look for the places that have a
    partner and then pick the points there. ``whole`` says whether groups are small enough to meet without
    cells; it is found out where neither it nor the side to copy is given.
    """
    if whole is None:
        whole = copied is None and small_groups(points, group) and small_groups(targets, group)
    if whole:
        right = targets.select(*[F.col(c).alias(f"_r{c}") for c in group], *extra, *[F.col(x).alias(f"_t{x}") for x in XYZ])
        condition = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_r{c}") for c in group], near)
        return points.join(right.hint("shuffle_hash"), condition, how).drop(*[f"_r{c}" for c in group])
    left, right, repeated = sides(points, targets, r, group, extra, copied)
    if repeated and how != "inner":
        left = left.select(*group, *XYZ, *_CELL, *_PARTS)
    keys = [*group, *_CELL, *_PARTS]
    right = right.withColumnsRenamed({c: f"_r{c}" for c in keys})
    right = F.broadcast(right) if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else right.hint("merge")
    condition = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_r{c}") for c in keys], near)
    if not repeated or how == "inner":
        return left.join(right, condition, how).drop(*_CELL, *_PARTS, *[f"_r{c}" for c in keys])
    places = left.join(right, condition, "left_semi").select(*group, *XYZ).distinct()
    return points.join(places, [*group, *XYZ], how).select(*points.columns)


def near_points(points: DataFrame, targets: DataFrame, r: float, group: Sequence[str], copied: str | None = None) -> DataFrame:
    """Points strictly closer than ``r`` to some target of their group. Stops at the first partner."""
    return _meet(points, targets, r, group, squared_distance() < F.lit(r * r), "left_semi", copied=copied)


def within_radius(points: DataFrame, targets: DataFrame, r: float, group: Sequence[str], residue: str = "res_idx") -> DataFrame:
    """Residues of each group with any point strictly within ``r`` of a target, one row each."""
    return near_points(points, targets, r, group).select(*group, residue).distinct()


def count_within_radius(points: DataFrame, targets: DataFrame, r: float, group: Sequence[str], residue: str = "res_idx") -> DataFrame:
    """Number of such residues per group; groups without any are kept at 0."""
    hits = within_radius(points, targets, r, group, residue).groupBy(*group).agg(F.count(F.lit(1)).alias("n_clash_res"))
    return points.select(*group).distinct().join(hits, list(group), "left").fillna(0, ["n_clash_res"])


def min_distance(points: DataFrame, targets: DataFrame, cutoff: float, group: Sequence[str], residue: str = "res_idx") -> DataFrame:
    """Smallest distance per residue, for residues within ``cutoff`` (inclusive)."""
    near = squared_distance() <= F.lit(cutoff * cutoff * (1 + 1e-12))
    met = _meet(points.select(*group, residue, *XYZ), targets, cutoff, group, near, "inner")
    nearest = met.groupBy(*group, residue).agg(F.sqrt(F.min(squared_distance())).alias("min_dist"))
    return nearest.where(F.col("min_dist") <= cutoff)


def carve(points: DataFrame, targets: DataFrame, d: float, group: Sequence[str], copied: str | None = None) -> DataFrame:
    """Points further than ``d`` from every target of their group."""
    return _meet(points, targets, d, group, squared_distance() <= F.lit(d * d), "left_anti", copied=copied)


def nearest_up_to(points: DataFrame, targets: DataFrame, limit: float, group: Sequence[str], key: Sequence[str], whole: bool | None = None) -> DataFrame:
    """Distance of each point to its nearest target where that is within ``limit``; null beyond."""
    met = _meet(points.select(*group, *key, *XYZ), targets, limit, group, squared_distance() <= F.lit(limit * limit), "inner", whole=whole)
    near = met.groupBy(*group, *key).agg(F.sqrt(F.min(squared_distance())).alias("target_dist"))
    return points.join(near, [*group, *key], "left")


def hits(
    points: DataFrame,
    targets: DataFrame,
    r: float,
    group: Sequence[str],
    point_key: Sequence[str],
    target_key: Sequence[str],
    copied: str | None = None,
    whole: bool | None = None,
) -> DataFrame:
    """Distinct (group, point key, target key) with a pair strictly closer than ``r``."""
    near = squared_distance() < F.lit(r * r)
    met = _meet(points.select(*group, *point_key, *XYZ), targets, r, group, near, "inner", target_key, copied, whole)
    return met.select(*group, *point_key, *target_key).distinct()
