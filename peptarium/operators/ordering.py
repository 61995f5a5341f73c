"""Order statistics that hold up when one group owns a large share of the rows.

Three building blocks serve every rank, median, AUC and numbering in the package:

``running_total``  exclusive prefix sum inside each group, in a given order.
``value_ladder``   one row per distinct (group, value) with its tie count and rank offset.
``lookup``         left join onto a unique-key table, with hot keys salted.

Tables that fit one task use a plain window. Larger ones are range-partitioned on
(group, order), so a hot group is spread over many slices, and slice offsets are added back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.functions.numeric import let
from peptarium.session import freeze, freeze_counted, rows_per_task


def fits_one_task(df: DataFrame) -> bool:
    return df.count() <= rows_per_task(df.sparkSession)


BUCKETS = 65_536


def key_load(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows, a bound of the rows of any one key): keys are counted in hash buckets, in one pass that ships only counts."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if keys else F.lit(0)
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    rows, most = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    return rows or 0, most or 0


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join where null keys match each other; key columns come from the left."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(renamed[f"__r_{c}"])
    return left.join(renamed, condition, how).drop(*[f"__r_{c}" for c in on])


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    weight: str | None = None,
    small: bool | None = None,
    null_safe: bool = False,
    most: int | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` (unique on ``on``), splitting keys that hold many left rows.

    Null keys match nothing, or each other with ``null_safe``. Null keys that match nothing are dealt
    evenly, so they never share a task.

    ``weight`` names a right column that already counts the left rows of each key; without it the
    counts are taken from ``left``, and only if a bound shows that some key may be hot. ``most`` gives
    the rows of the most frequent key, nulls left out, if the caller knows it. Only keys above the task size
    are salted. There are at most ``rows / task size`` of them, which bounds the broadcast list of hot keys.
    """
    on = list(on)
    drop = [weight] if weight and weight.startswith("_") else []
    limit = rows_per_task(left.sparkSession)
    if on and (small is None or (small is False and weight is None and most is None)):
        rows, bound = key_load(left, on)
        small = (small is None and rows <= limit) or bound <= limit
    join = null_safe_join if null_safe else DataFrame.join
    if small or not on:
        return join(left, right, on, how).drop(*drop)
    if most is not None and most <= limit:
        hot = None
    elif weight:
        hot = right.where(F.col(weight) > limit).select(*on, F.col(weight).alias("_rows"))
    else:
        hot = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    lone = F.lit(1)
    if hot is not None:
        hot = hot.select(*on, F.ceil(F.col("_rows") / limit).cast("int").alias("_parts"))
    if not null_safe:
        hot = hot.dropna(subset=on) if hot is not None else None
        lone = F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on]), F.lit(2**31 - 1)).otherwise(F.lit(1))
    # maps cannot be hashed; what is left of the row spreads it well enough
    spread_by = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    if hot is None:
        dealt = left.withColumn("_salt", F.when(lone > 1, F.pmod(F.xxhash64(*spread_by), lone)).otherwise(F.lit(0)).cast("int"))
        return join(dealt, right.withColumn("_salt", F.lit(0)), [*on, "_salt"], how).drop("_salt", *drop)
    salted = (
        join(left, F.broadcast(hot), on, "left")
        .withColumn("_parts", F.coalesce("_parts", lone))
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.col("_parts")).cast("int"))
        .drop("_parts")
    )
    copies = (
        join(right, F.broadcast(hot), on, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return join(salted, copies, [*on, "_salt"], how).drop("_salt", *drop)


def running_total(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    weight: Column | str | None = None,
    out: str = "before",
    small: bool | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Add ``out``: the weight (default 1 per row) of all rows of the group that come earlier.

    ``rows``, if the caller knows a bound of their number, saves counting them.
    """
    groups, order = list(groups), [F.col(o) if isinstance(o, str) else o for o in order]
    amount = F.lit(1).cast("bigint") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    n = rows
    if small is None and not groups and rows is not None:
        small = rows <= rows_per_task(df.sparkSession)
    if small is None:
        # a window needs one group in a task, not the table
        n, most = key_load(df, groups)
        small = most <= rows_per_task(df.sparkSession)
    earlier = (Window.unboundedPreceding, -1)
    if small:
        w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(*earlier)
        return df.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)).cast("bigint"))

    n = df.count() if n is None else n
    spark = df.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / rows_per_task(spark)))
    sliced = freeze(
        df.repartitionByRange(slices, *[F.col(g) for g in groups], *order).withColumn("_slice", F.spark_partition_id())
    )
    totals = sliced.groupBy(*groups, "_slice").agg(F.sum(amount).alias("_in_slice"))
    # at most one row per (group, slice): the window below is bounded by the number of slices
    offsets = totals.withColumn(
        "_offset",
        F.coalesce(F.sum("_in_slice").over(Window.partitionBy(*groups).orderBy("_slice").rowsBetween(*earlier)), F.lit(0)),
    ).select(*groups, "_slice", "_offset")
    # slices follow the group order, so only the first group of a slice can continue from an earlier one:
    # at most one non-zero offset per slice, which is what bounds the broadcast
    carried = F.broadcast(offsets.where(F.col("_offset") > 0))
    w = Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(*earlier)
    local = sliced.withColumn("_local", F.coalesce(F.sum(amount).over(w), F.lit(0)))
    return (
        null_safe_join(local, carried, [*groups, "_slice"])
        .withColumn(out, (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("bigint"))
        .drop("_slice", "_local", "_offset")
    )


def key_census(df: DataFrame, key: Column) -> tuple[int, int, list[str]]:
    """(rows, the rows of the most frequent key, a sample of keys in order): one pass that moves a hash per row.

    ``key`` is a text; null keys count as repeated. Different keys of one hash may count as repeated too. The sample
    is by hash, some ``SAMPLED`` keys in a task's share of rows, and meant for ``cut_points``.
    """
    every = max(1, rows_per_task(df.sparkSession) // SAMPLED)
    picked = F.when(F.pmod(F.xxhash64(F.lit(every), key), F.lit(every)) == 0, key)
    keys = df.select(F.xxhash64(key).alias("_hash"), picked.alias("_key"), key.isNull().alias("_none")).repartition("_hash")
    counts = keys.groupBy("_hash", "_key", "_none").agg(F.count(F.lit(1)).alias("_rows"))
    most = F.max(F.when(F.col("_none"), F.col("_rows") + 1).otherwise(F.col("_rows")))
    rows, most, sample = counts.agg(F.sum("_rows"), most, F.collect_list("_key")).first()
    return rows or 0, most or 0, sorted(sample, key=str.encode)


SAMPLED = 256


def cut_points(sample: Sequence[str], slices: int) -> list[str]:
    """At most ``slices - 1`` keys that cut an ordered sample into equal slices."""
    return sorted({sample[len(sample) * i // slices] for i in range(1, slices)}, key=str.encode) if sample else []


def slice_of(key: Column, points: Sequence[str]) -> Column:
    """How many of the ordered ``points`` are not above a text, found by bisection."""
    if not points:
        return F.lit(0)
    at = F.array(*[F.lit(p) for p in points])
    steps = F.array(*[F.lit(2**i) for i in reversed(range(len(points).bit_length()))])

    def bisect(k: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(at, n + step - 1) <= k, n + step).otherwise(n))

    return F.coalesce(let(key, bisect), F.lit(0))  # never null, so no join adds a filter that would part one exchange into two


def rank_between(df: DataFrame, key: Column, points: Sequence[str], order: Sequence[Column | str], out: str) -> DataFrame:
    """1-based position of every row in the whole table, without writing the rows.

    Slices are cut at the given ``points`` of ``key``, which must never fall along ``order``. A slice's offset comes by
    broadcast, the place inside it from a window. Unlike sampled ranges, the points stay the same when rows are worked
    out again, so counts and places agree; as both end in the same exchange of ``df``, Spark runs that once.
    """
    sliced = df.withColumn("_slice", slice_of(key, points))
    totals = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_in_slice"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_slice", F.coalesce(F.sum("_in_slice").over(earlier), F.lit(0)).alias("_offset"))
    placed = sliced.withColumn("_place", F.row_number().over(Window.partitionBy("_slice").orderBy(*order)))
    return placed.join(F.broadcast(offsets), "_slice").withColumn(out, F.col("_offset") + F.col("_place")).drop("_slice", "_offset", "_place")


def row_rank(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], out: str = "rank_in_group", small: bool | None = None, rows: int | None = None
) -> DataFrame:
    """1-based position inside each group. ``order`` must end in a unique key."""
    return running_total(df, groups, order, out="_before", small=small, rows=rows).withColumn(out, F.col("_before") + 1).drop("_before")


def value_ladder(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    extra: Sequence[Column] = (),
    descending: bool = False,
    small: bool | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct (group, value): ``n_ties``, ``below`` (rows that sort earlier), ``n``.

    Rows are counted per value before anything is shuffled or sorted, so heavy ties cost nothing.
    Null values are left out. ``steps`` are the counts (``value_steps``), if the caller has them.
    """
    groups = list(groups)
    if small is None:
        small = fits_one_task(df)
    if steps is None:
        steps = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_ties"), *extra)
    counted = steps
    order = F.col(value).desc() if descending else F.col(value).asc()
    steps = running_total(steps, groups, [order], "n_ties", "below", small=small)
    if small:
        return steps.withColumn("n", F.sum("n_ties").over(Window.partitionBy(*groups)))
    sizes = counted.groupBy(*groups).agg(F.sum("n_ties").alias("n"))
    return lookup(steps, sizes, groups, "inner", small=False, null_safe=True) if groups else beside(steps, sizes)


def average_rank() -> Column:
    """Rank of a ladder row with ties averaged."""
    return F.col("below") + (F.col("n_ties") + 1) / 2.0


def rank_table(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    out: str = "rank",
    method: str = "average",
    pct: bool = False,
    small: bool | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Rank of every distinct (group, value), with ``_ties``, the number of rows that hold it.

    ``method`` is one of average, min, max, dense; ``pct`` divides by the number of ranked rows
    (by the number of distinct values for dense).
    """
    groups = list(groups)
    if small is None:
        small = fits_one_task(df)
    ladder = value_ladder(df, groups, value, small=small, steps=steps)
    if method == "average":
        rank, size = average_rank(), F.col("n")
    elif method == "min":
        rank, size = F.col("below") + 1.0, F.col("n")
    elif method == "max":
        rank, size = (F.col("below") + F.col("n_ties")).cast("double"), F.col("n")
    elif method == "dense":
        ladder = running_total(ladder, groups, [F.col(value)], out="_dense", small=small)
        top = ladder.groupBy(*groups).agg((F.max("_dense") + 1).alias("_distinct"))
        ladder = lookup(ladder, top, groups, "inner", small=small, null_safe=True) if groups else beside(ladder, top)
        rank, size = F.col("_dense") + 1.0, F.col("_distinct")
    else:
        raise ValueError(f"unknown rank method: {method!r}")
    score = rank / size if pct else rank
    return ladder.select(*groups, value, score.alias(out), F.col("n_ties").alias("_ties"))


def with_rank(
    df: DataFrame,
    value: str,
    groups: Sequence[str] = (),
    out: str = "rank",
    method: str = "average",
    pct: bool = False,
    small: bool | None = None,
    population: DataFrame | None = None,
) -> DataFrame:
    """Rank every row by ``value`` inside its group; null values rank null.

    The input is counted per (group, value) once, and that table is written; at most ``BROADCAST_STEPS`` of them
    are looked up by broadcast. ``population`` is a table with the same rows that is cheaper to read than ``df``,
    such as the one ``df`` was derived from; the counts are then taken there.
    """
    source = df if population is None else population
    steps, distinct = value_steps(source.where(F.col(value).isNotNull()), groups, value)
    if small is None:
        small = distinct <= rows_per_task(df.sparkSession)
    ranks = rank_table(source, value, groups, out, method, pct, small, steps)
    if distinct <= BROADCAST_STEPS:
        return df.join(F.broadcast(ranks.drop("_ties")), [*groups, value], "left")
    most = steps.agg(F.max("n_ties")).first()[0]
    return lookup(df, ranks, [*groups, value], weight="_ties", small=small, most=most)


BROADCAST_STEPS = 100_000


def with_ranks(
    df: DataFrame, columns: dict[str, str], groups: Sequence[str] = (), pct: bool = False, small: bool | None = None, many_groups: bool = False
) -> DataFrame:
    """Average ranks of several columns (``{value: out}``) inside ``groups``; null values and null groups rank null.

    The input is unpivoted and counted per (metric, group, cell) once, whatever the number of metrics, where a cell
    is a narrow range of values (``_coarse``). Metrics whose cells hold one value each are ranked by that, and so
    looked up by broadcast. Those with more values are dealt by cell: a cell's offset comes by broadcast, the place
    inside it from a window, so their values are neither counted one by one nor written. Metrics with too many cells
    or too full ones, and all metrics if the caller expects ``many_groups``, are counted per value; at most
    ``BROADCAST_STEPS`` of those are looked up by broadcast, more by a join. Several metrics that need their rows
    moved are ranked on narrow rows (row, metric, value) and pivoted back, so the wide rows move at most once.
    """
    groups, metrics = list(groups), list(columns)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if len({kinds[m] for m in metrics}) > 1:
        df = df.withColumns({f"_as_{m}": F.col(m).cast("double") for m in metrics})
        names = {f"_as_{m}": out for m, out in columns.items()}
        return with_ranks(df, names, groups, pct, small, many_groups).drop(*names)
    kind, limit, scope = kinds[metrics[0]], rows_per_task(df.sparkSession), ["_metric", *groups]

    def unpivoted(rows: DataFrame, chosen: Sequence[str], *keep: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(metrics.index(m)).alias("_metric"), F.col(m).alias("_value")) for m in chosen])
        return rows.select(*keep, *groups, F.inline(cells)).dropna(subset=["_value", *groups])

    tables, sizes, most, split = [], {}, {}, []
    by_value = metrics
    if kind in ("double", "float", "int", "bigint") and not many_groups:
        spans = [F.count(F.lit(1)).alias("_ties"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi")]
        cells = unpivoted(df, metrics).groupBy(*scope, _coarse("_value", CELLS).alias("_cell")).agg(*spans)
        cells = freeze(cells.withColumn("_mixed", F.col("_lo") < F.col("_hi")))
        fullest = F.max(F.when(F.col("_mixed"), F.col("_ties"))).alias("fullest")  # null: one value a cell
        found = {metrics[r["_metric"]]: r for r in cells.groupBy("_metric").agg(F.count(F.lit(1)).alias("n"), F.max("_ties").alias("most"), fullest).collect()}
        split = [m for m, r in found.items() if r["fullest"] and r["n"] <= BROADCAST_STEPS and r["fullest"] <= limit]
        by_value = [m for m, r in found.items() if r["fullest"] and m not in split]
        sizes, most = {m: r["n"] for m, r in found.items()}, {m: r["most"] for m, r in found.items()}
        at = F.when(F.col("_metric").isin([metrics.index(m) for m in split]), F.col("_cell").cast(kind)).otherwise(F.col("_lo"))
        tables = [cells.where(~F.col("_metric").isin([metrics.index(m) for m in by_value])).select(*scope, at.alias("_value"), "_ties", "_mixed")]
    if by_value:
        counted = freeze(unpivoted(df, by_value).groupBy(*scope, "_value").agg(F.count(F.lit(1)).alias("_ties")))
        for r in counted.groupBy("_metric").agg(F.count(F.lit(1)).alias("n"), F.max("_ties").alias("most")).collect():
            sizes[metrics[r["_metric"]]], most[metrics[r["_metric"]]] = r["n"], r["most"]
        tables.append(counted.withColumn("_mixed", F.lit(False)))
    steps = reduce(DataFrame.unionByName, tables)
    if small is None:
        small = sum(sizes.values()) <= limit
    ladder = running_total(steps, scope, ["_value"], "_ties", "_below", small=small)
    share = F.lit(1)
    if pct:
        if small:
            ladder = ladder.withColumn("_n", F.sum("_ties").over(Window.partitionBy(*scope)))
        else:
            totals, populations = freeze_counted(steps.groupBy(*scope).agg(F.sum("_ties").alias("_n")))
            if populations <= BROADCAST_STEPS:
                ladder = ladder.join(F.broadcast(totals), scope)
            else:
                ladder = lookup(ladder, totals, scope, "inner", small=False)
        share = F.col("_n")
    else:
        ladder = ladder.withColumn("_n", share)
    rank = (F.col("_below") + (F.col("_ties") + 1) / 2.0) / share
    ranks = ladder.select(*scope, "_value", rank.alias("_rank"), "_ties")
    of = lambda rows, m: rows.where(F.col("_metric") == metrics.index(m)).drop("_metric")
    large = [m for m in metrics if m not in split and sizes.get(m, 0) > BROADCAST_STEPS]
    moved = [*large, *split]
    for m in metrics:
        if m not in moved or len(moved) == 1:
            mine = of(ranks, m).withColumnsRenamed({"_value": m, "_rank": columns[m]})
            if m in split:
                df = _rank_in_cells(df, groups, m, of(ladder, m), columns[m])
            elif m in large:
                df = lookup(df, mine, [*groups, m], weight="_ties", small=small, most=most[m])
            else:
                df = df.join(F.broadcast(mine.drop("_ties")), [*groups, m], "left")
    if len(moved) > 1:
        wide = freeze(df.withColumn("_row", F.monotonically_increasing_id()))
        narrow = []
        if large:
            met = lookup(unpivoted(wide, large, "_row"), ranks, [*scope, "_value"], "inner", weight="_ties", small=small, most=max(most[m] for m in large))
            narrow.append(met.select("_row", "_metric", "_rank"))
        if split:
            names = F.col("_metric").isin([metrics.index(m) for m in split])
            narrow.append(_rank_in_cells(unpivoted(wide, split, "_row"), scope, "_value", ladder.where(names), "_rank").select("_row", "_metric", "_rank"))
        narrow = reduce(DataFrame.unionByName, narrow)
        found = narrow.groupBy("_row").agg(*[F.max(F.when(F.col("_metric") == metrics.index(m), F.col("_rank"))).alias(columns[m]) for m in moved])
        df = wide.join(found, "_row", "left").drop("_row")
    return df


CELLS = 1024


def _rank_in_cells(df: DataFrame, keys: Sequence[str], value: str, ladder: DataFrame, out: str) -> DataFrame:
    """Average rank over ``_n`` of every row, from a ladder of cells (keys, ``_value`` = cell, ``_below``, ``_ties``, ``_mixed``, ``_n``).

    Rows of a cell with several values meet in a task. A cell of one value ranks by itself, so its rows, and those
    without a rank, are dealt evenly.
    """
    steps = ladder.select(*keys, F.col("_value").cast("int").alias("_cell"), "_below", "_ties", "_mixed", "_n")
    rows = df.withColumn("_cell", _coarse(value, CELLS)).join(F.broadcast(steps), [*keys, "_cell"], "left")
    spread_by = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    dealt = F.lit(4_000 * CELLS) + F.pmod(F.xxhash64(*spread_by), F.lit(BUCKETS)).cast("int")  # beyond every cell
    rows = rows.withColumn("_cell", F.when(F.col("_mixed"), F.col("_cell")).otherwise(dealt))
    w = Window.partitionBy(*keys, "_cell").orderBy(value)
    inside = F.when(F.col("_mixed"), F.rank().over(w) + F.count(F.lit(1)).over(w)).otherwise(F.col("_ties") + 1)
    return rows.withColumn(out, (F.col("_below") + inside / 2.0) / F.col("_n")).drop("_cell", "_below", "_ties", "_mixed", "_n")


def _coarse(value: str, per_e: int = 64) -> Column:
    """A whole number that never falls as the value rises: ``per_e`` steps per factor e, zero and both signs apart."""
    v = F.col(value).cast("double")
    size = F.floor(F.log(F.abs(v)) * per_e).cast("int") + 800 * per_e  # log of the least double is above -746
    edge = F.when(F.isnan(v), F.lit(3_000 * per_e)).when(F.abs(v) == F.lit(float("inf")), F.signum(v).cast("int") * 2_000 * per_e)
    return edge.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size)


def value_steps(df: DataFrame, groups: Sequence[str], value: str) -> tuple[DataFrame, int]:
    """One written row per distinct (group, value) with its count ``n_ties``, null among them, and how many rows that is."""
    return freeze_counted(df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n_ties")))


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: dict[str, float],
    small: bool | None = None,
    steps: DataFrame | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per entry of ``probs``.

    The input is read once, into counts per distinct value (``steps``, if the caller has them). If those are
    more than a task should hold, coarse buckets are counted first, and only values in a bucket with a wanted
    rank are put in order.
    """
    groups = list(groups)
    if steps is None:
        steps, n = value_steps(df, groups, value)
    else:
        n = steps.count() if small is None else 0
    if small is None:
        small = n <= rows_per_task(df.sparkSession)
    named, steps = steps.select(*groups), steps.where(F.col(value).isNotNull())
    wants = [(i, side, p) for i, p in enumerate(probs.values()) for side in ("lo", "hi")]

    def at(n: Column, side: str, p: float) -> Column:
        position = F.lit(float(p)) * (n - 1)
        return (F.floor(position) if side == "lo" else F.ceil(position)).cast("bigint")

    if small:
        all_of_group = Window.partitionBy(*groups)
        earlier = all_of_group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        ladder = steps.withColumn("_n", F.sum("n_ties").over(all_of_group)).withColumn("_below", F.coalesce(F.sum("n_ties").over(earlier), F.lit(0)))
        offset = F.lit(0)
    else:
        coarse = steps.withColumn("_bucket", _coarse(value))
        # at most some 200,000 buckets per group, usually a few hundred
        counts = coarse.groupBy(*groups, "_bucket").agg(F.sum("n_ties").alias("_k"))
        order = Window.partitionBy(*groups).orderBy("_bucket")
        counts = counts.withColumn("_n", F.sum("_k").over(Window.partitionBy(*groups)))
        counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        holds = reduce(lambda a, b: a | b, [(F.col("_before") <= at(F.col("_n"), s, p)) & (at(F.col("_n"), s, p) < F.col("_before") + F.col("_k")) for _, s, p in wants])
        wanted = counts.where(holds).select(*groups, "_bucket", "_n", "_before")
        picked, m = freeze_counted(null_safe_join(coarse, wanted, [*groups, "_bucket"], "inner"))
        ladder = running_total(picked, [*groups, "_bucket"], [value], "n_ties", "_below", small=m <= rows_per_task(df.sparkSession))
        offset = F.col("_before")
    below = F.col("_below") + offset
    picks = [
        F.max(F.when((below <= at(F.col("_n"), s, p)) & (at(F.col("_n"), s, p) < below + F.col("n_ties")), F.col(value))).alias(f"_{s}{i}")
        for i, s, p in wants
    ]
    results = []
    for i, (name, p) in enumerate(probs.items()):
        part = F.lit(float(p)) * (F.col("_n") - 1)
        results.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (part - F.floor(part))).alias(name))
    found = ladder.groupBy(*groups).agg(F.max("_n").alias("_n"), *picks).select(*groups, *results)
    if not groups:
        return found
    # groups whose values are all null still get a (null) row
    return null_safe_join(named.distinct(), found, groups)


def medians(df: DataFrame, groups: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """Exact medians of several numeric columns per group (``{column: out}``), from one count of (group, metric, value)."""
    names = list(columns)
    cells = F.array(*[F.struct(F.lit(i).alias("_metric"), F.col(c).cast("double").alias("_value")) for i, c in enumerate(names)])
    mids = quantiles(df.select(*groups, F.inline(cells)), [*groups, "_metric"], "_value", {"_mid": 0.5})
    return mids.groupBy(*groups).agg(*[F.max(F.when(F.col("_metric") == i, F.col("_mid"))).alias(columns[c]) for i, c in enumerate(names)])


def top_k(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, out: str | None = None) -> DataFrame:
    """The first ``k`` rows of each group. ``order`` must end in a unique key.

    Spark pushes the rank limit below the shuffle, so each map task sends at most k rows per group.
    That rewrite has a ceiling on k; past it the sliced rank is used.
    """
    ceiling = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    name = out or "_rank"
    if k <= ceiling:
        ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    else:
        ranked = row_rank(df, groups, order, out=name)
    kept = ranked.where(F.col(name) <= k)
    return kept if out else kept.drop(name)


def top_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of the whole table in a total order: every task keeps n, the driver's side merges those."""
    return df.orderBy(*order).limit(n)


def first_per(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per group, the first in ``order``; map tasks send at most one row per group."""
    return top_k(df, groups, [F.col(o) if isinstance(o, str) else o for o in order], 1)


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row."""
    return (
        df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")
    )
