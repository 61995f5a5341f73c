"""Diversity sampling: farthest-point picks, even quotas, disjoint halves, stratified-uniform samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from peptarium.functions.keys import stable_hash
from peptarium.functions.numeric import num
from peptarium.operators.ordering import first_per, lookup, row_rank, top_k, with_ranks
from peptarium.session import freeze, freeze_counted, rows_per_task

CANDIDATES = 1000
CELLS = 4096  # per group
REACH = 0.5  # of a squared distance
SHIPPED = 200_000  # rows of a broadcast


def quotas(df: DataFrame, group: str, total: int) -> DataFrame:
    """Even quota per group over the sorted group ids: the first ``total mod n`` groups get one more."""
    ids = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("group_size"))
    n = ids.count()
    ranked = row_rank(ids, [], [F.col(group)], out="_i")
    base, extra = divmod(total, max(n, 1))
    return ranked.select(group, "group_size", F.least(F.lit(base) + (F.col("_i") <= extra).cast("int"), F.col("group_size")).alias("quota"))


def _square(axes: Sequence[str], other: str) -> Column:
    terms = [(F.col(a) - F.col(f"{other}{a}")) * (F.col(a) - F.col(f"{other}{a}")) for a in axes]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _greedy_block(axes: Sequence[str], key: str, depth: int):
    """Greedy picks among one group's candidates, as long as no row outside can be further away.

    Candidates are the ``depth`` rows furthest from what is chosen, in cells that can hold such rows.
    Distances only shrink, so a candidate that stays above the last candidate's distance and above the
    bound of the cells left out (``_limit``) beats every row not in the list.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_far", key], ascending=[False, True], kind="mergesort")
        whole = len(pdf) < depth
        floor = max(-1.0 if whole else float(pdf["_far"].iloc[-1]), float(pdf["_limit"].iloc[0]))
        x = pdf[list(axes)].to_numpy(float)
        far = pdf["_far"].to_numpy(float).copy()
        names = pdf[key].to_numpy()
        # rank of each key, so that equal distances go to the smallest key
        rank = np.empty(len(names), int)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        room, done, chosen = int(pdf["_room"].iloc[0]), int(pdf["_done"].iloc[0]), []
        while len(chosen) < room:
            top = far.max()
            if chosen and not top > floor:
                break
            ties = np.flatnonzero(far == top)
            i = ties[np.argmin(rank[ties])]
            chosen.append(i)
            far = np.minimum(far, ((x - x[i]) ** 2).sum(axis=1))
            far[chosen] = -2.0
            if len(chosen) == len(far):
                break
        out = pdf.iloc[chosen][[c for c in pdf.columns if c not in ("_far", "_room", "_done", "_limit")]].copy()
        out["fps_order"] = done + np.arange(len(chosen))
        return out

    return pick


def _open_cells(axes: Sequence[str], depth: int = CANDIDATES):
    """Cells of one group that may hold one of its next picks, the bound of all others, and a floor.

    From the corners of a cell's box come a least and a greatest distance of its rows to the picks. Some row is
    at least as far as the largest least distance; cells that reach ``REACH`` of it are opened. Cells whose rows
    are all beyond the floor hold ``depth`` rows that are not picked yet, so the ``depth`` furthest rows are beyond
    it too. Boxes without a count of rows (``_rows``) give no floor.
    """

    def choose(boxes: pd.DataFrame, picks: pd.DataFrame) -> pd.DataFrame:
        if not len(boxes) or not len(picks):
            return boxes.iloc[:0, :2].assign(_limit=0.0, _floor=-1.0)
        low, high = (boxes[[f"{side}{a}" for a in axes]].to_numpy(float) for side in ("_lo", "_hi"))
        least, most = np.full(len(boxes), np.inf), np.full(len(boxes), np.inf)
        for p in picks[list(axes)].to_numpy(float):
            least = np.minimum(least, (np.maximum(0, np.maximum(low - p, p - high)) ** 2).sum(axis=1))
            most = np.minimum(most, (np.maximum(abs(p - low), abs(p - high)) ** 2).sum(axis=1))
        floor = -1.0
        if "_rows" in boxes:
            far_first = np.argsort(-least, kind="stable")
            enough = np.flatnonzero(boxes["_rows"].to_numpy()[far_first].cumsum() >= depth + len(picks))
            if len(enough):  # a shade below, as rows are measured in another order of steps
                floor = least[far_first[enough[0]]] * (1 - 1e-9)
        opened = most >= max(REACH * least.max(), floor)
        limit = most[~opened].max() * (1 + 1e-9) if (~opened).any() else -1.0
        return boxes.loc[opened].iloc[:, :2].assign(_limit=limit, _floor=floor)  # group and cell

    return choose


def fps(
    df: DataFrame, group: str, axes: Sequence[str], quota: DataFrame, key: str, candidates: int = CANDIDATES, cells: int = CELLS
) -> DataFrame:
    """Farthest-point sampling per group: start nearest the centroid, then greedy max-min distance.

    Returns (group, key, axes, fps_order). No group is ever gathered. Rows are written once; each belongs to a
    cell in a grid of at most ``cells`` cells over its group. A round bounds the distances of whole cells from
    their boxes, measures only rows of cells that can still hold a next pick, keeps per group the ``candidates``
    furthest of those (a rank limit that Spark applies before the shuffle), and picks among them while the
    result is provably the global one. Only the picks are written per round. At least one pick per unfinished
    group is made per round; usually most of the quota is. ``candidates`` and ``cells`` bound memory, not the
    result. A quota that covers the group returns it whole, in greedy order.

    Rows stay where they were written: what a round needs to know of groups, cells and picks is broadcast as long
    as it is at most ``SHIPPED`` rows; beyond that it is joined.
    """
    axes = list(axes)
    base = df.select(group, key, *[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    return _fps(freeze(base), group, axes, quota, key, candidates, cells)


def _fps(base: DataFrame, group: str, axes: Sequence[str], quota: DataFrame, key: str, candidates: int = CANDIDATES, cells: int = CELLS) -> DataFrame:
    """``fps`` over written rows (group, key, axes) without nulls in them."""
    axes = list(axes)
    base = base.where(F.col(group).isNotNull())
    spans = [agg(a).alias(f"{side}{a}") for side, agg in (("_c", F.avg), ("_lo", F.min), ("_hi", F.max)) for a in axes]
    spans_of, groups = freeze_counted(base.groupBy(group).agg(F.count(F.lit(1)).alias("_rows"), *spans))
    n, most = spans_of.agg(F.sum("_rows"), F.max("_rows")).first()
    small = (n or 0) <= rows_per_task(base.sparkSession)
    sides = max(1, int(cells ** (1 / len(axes))))
    cell = F.lit(0).cast("bigint")
    for a in axes:
        wide = F.col(f"_hi{a}") - F.col(f"_lo{a}")
        step = F.when(wide > 0, F.least(F.floor((F.col(a) - F.col(f"_lo{a}")) / wide * sides), F.lit(sides - 1))).otherwise(F.lit(0))
        cell = cell * sides + step.cast("bigint")
    shipped = groups <= SHIPPED
    placed = base.join(F.broadcast(spans_of.drop("_rows")), group) if shipped else lookup(base, spans_of, [group], "inner", weight="_rows", small=small, most=most)
    rows = placed.select(group, key, *axes, cell.alias("_cell"), _square(axes, "_c").alias("_d"))
    if not shipped:  # where the cell of a row takes a join, it is written with the row
        rows = freeze(rows)
    corners = [agg(a).alias(f"{side}{a}") for side, agg in (("_lo", F.min), ("_hi", F.max)) for a in axes]
    nearest = F.min("_d").alias("_near")
    boxes, n_boxes = freeze_counted(rows.groupBy(group, "_cell").agg(*corners, F.count(F.lit(1)).alias("_rows"), nearest))
    wanted = freeze(quota.select(group, "quota").where(F.col("quota") > 0))
    picks = wanted.agg(F.sum("quota")).first()[0] or 0
    ship = lambda df, n: F.broadcast(df) if n <= SHIPPED else df
    # only rows as near to the centroid as any are put in order
    least = ship(boxes.groupBy(group).agg(F.min("_near").alias("_near")).join(wanted.select(group), group), groups)
    nearby = rows.join(least, group).where(F.col("_d") <= F.col("_near"))
    start = first_per(nearby, [group], ["_d", key]).select(group, key, *axes, F.lit(0).alias("fps_order"))
    boxes = boxes.drop("_near")
    picked = freeze(start)
    order = [F.col("_far").desc(), F.col(key).asc()]
    schema, rounds = picked.schema, 0
    open_schema = StructType([boxes.schema[group], boxes.schema["_cell"], StructField("_limit", DoubleType()), StructField("_floor", DoubleType())])
    while True:
        room = picked.groupBy(group).agg(F.count(F.lit(1)).alias("_done")).join(wanted, group)
        room = room.withColumn("_room", F.col("quota") - F.col("_done")).where(F.col("_room") > 0).select(group, "_room", "_done")
        if room.isEmpty():
            return picked
        waiting = boxes.join(ship(room.select(group), groups), group, "left_semi").groupBy(group)
        known = picked.select(F.col(group).alias("_group"), *axes).groupBy("_group")
        opened = waiting.cogroup(known).applyInPandas(_open_cells(axes, candidates), open_schema)
        # picks per group are at most its quota
        lists = picked.groupBy(group).agg(F.collect_list(F.struct(*axes)).alias("_picks"), F.collect_list(key).alias("_keys"))
        closest = F.array_min(
            F.transform("_picks", lambda p: sum(((F.col(a) - p[a]) * (F.col(a) - p[a]) for a in axes), F.lit(0.0)))
        )
        unfinished = lists.join(room.select(group), group, "left_semi")
        near = rows.drop("_d").join(ship(opened, n_boxes), [group, "_cell"]).drop("_cell")
        met = near.join(F.broadcast(unfinished), group) if picks <= SHIPPED else lookup(near, unfinished, [group], "inner", small=small)
        far = met.where(~F.array_contains("_keys", F.col(key))).withColumn("_far", closest).drop("_picks", "_keys")
        # enough rows lie beyond the floor, so nothing short of it is put in order
        best = top_k(far.where(F.col("_far") >= F.col("_floor")).drop("_floor"), [group], order, candidates)
        block = best.join(room, group).groupBy(group).applyInPandas(_greedy_block(axes, key, candidates), schema)
        fresh = freeze(block.where(F.col("fps_order").isNotNull()))
        if fresh.isEmpty():
            return picked
        rounds += 1
        picked = picked.unionByName(fresh)
        if rounds % 20 == 0:  # keep the plan short when a quota needs many rounds
            picked = freeze(picked)


def sample_half(df: DataFrame, group: str, axes: Sequence[str], total: int, key: str) -> DataFrame:
    """FPS over percentile-standardised axes with even quotas; rows with a missing axis take no part."""
    rows = df.select(group, key, *[num(a).alias(a) for a in axes]).dropna()
    rows = rows.withColumnsRenamed({a: f"_raw_{a}" for a in axes})
    rows = freeze(with_ranks(rows, {f"_raw_{a}": a for a in axes}, pct=True).select(group, key, *axes))
    return _fps(rows, group, axes, quotas(rows, group, total), key).select(group, key, "fps_order")


def titration(df: DataFrame, group: str, base_axes: Sequence[str], first: str, second: str, total: int, key: str) -> DataFrame:
    """Two disjoint halves, each spanning the base axes plus one accessibility axis, tagged by it."""
    half = total // 2
    one = sample_half(df, group, [*base_axes, first], half, key)
    rest = df.join(one.select(key), key, "left_anti")
    two = sample_half(rest, group, [*base_axes, second], total - half, key)
    return one.withColumn("access_sampled", F.lit(first)).unionByName(two.withColumn("access_sampled", F.lit(second)))


def span_sample(df: DataFrame, column: str, total: int, lo: float, hi: float, key: Sequence[str], nbins: int = 25, seed: int = 0) -> DataFrame:
    """Stratified-uniform sample: an equal quota from each value bin of [lo, hi), by seeded hash."""
    width = (hi - lo) / nbins
    v = num(column)
    binned = df.where((v >= lo) & (v < hi)).withColumn("bin", F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(nbins - 1)).cast("int"))
    hashed = binned.withColumn("_h", stable_hash(*key, seed=seed))
    return top_k(hashed, ["bin"], [F.col("_h").asc(), *[F.col(k) for k in key]], max(1, total // nbins)).drop("_h")
