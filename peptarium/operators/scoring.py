"""Composite scoring under a preset: transforms, weighted fold, pass bonus, selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.functions.numeric import logistic, num
from peptarium.operators.ordering import average_rank, beside, fits_one_task, key_load, lookup, medians, null_safe_join, row_rank, running_total, top_k, with_rank, with_ranks
from peptarium.operators.predicates import Condition, all_of, gate, gates, require_columns
from peptarium.plans.presets import Metric, PassBonus, Preset
from peptarium.session import freeze_counted, rows_per_task

# name -> (value, metric, stats) -> score; stats maps min, max, avg, sd, median to columns
TRANSFORMS: dict[str, Callable[[Column, Metric, dict[str, Column]], Column]] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def register_transform(name: str, fn: Callable[[Column, Metric, dict[str, Column]], Column], needs: Sequence[str] = ()) -> None:
    """Add a transform usable from presets. ``needs`` lists the scope statistics it reads."""
    TRANSFORMS[name] = fn
    NEEDS[name] = tuple(needs)


def _minmax(x: Column, m: Metric, s: dict[str, Column]) -> Column:
    z = F.when(s["max"] > s["min"], (x - s["min"]) / (s["max"] - s["min"])).otherwise(x * 0.0)
    return z if m.better == "high" else F.lit(1.0) - z


def _zscore(x: Column, m: Metric, s: dict[str, Column]) -> Column:
    z = F.when(s["sd"] > 0, (x - s["avg"]) / s["sd"]).otherwise(x * 0.0)
    return z if m.better == "high" else -z


def _sigmoid(x: Column, m: Metric, s: dict[str, Column]) -> Column:
    midpoint = s["median"] if m.midpoint is None else m.midpoint
    return logistic(x, midpoint, m.k, 1.0 if m.better == "low" else -1.0)


def _identity(x: Column, m: Metric, s: dict[str, Column]) -> Column:
    return x if m.better == "high" else -x


register_transform("minmax", _minmax, ("min", "max"))
register_transform("zscore", _zscore, ("avg", "sd"))
register_transform("sigmoid", _sigmoid, ("median",))
register_transform("identity", _identity)

_AGGREGATES = {"min": F.min, "max": F.max, "avg": F.avg, "sd": F.stddev_pop}


def _needs(m: Metric) -> tuple[str, ...]:
    if m.transform == "sigmoid" and m.midpoint is not None:
        return ()
    return NEEDS[m.transform]


def transform_metrics(
    df: DataFrame, metrics: Sequence[Metric], scope: Sequence[str], small: bool | None = None, ranks: dict[str, str] | None = None
) -> DataFrame:
    """Add ``score_<column>`` for each metric, computed inside ``scope`` (empty = the whole table).

    ``ranks`` names columns that already hold the percentile of a metric (``{column: percentile}``).
    """
    ranks = ranks or {}
    unknown = [m.transform for m in metrics if m.transform != "percentile" and m.transform not in TRANSFORMS]
    if unknown:
        raise ValueError(f"unknown transform: {unknown[0]!r}")
    ranked = [m for m in metrics if m.transform == "percentile"]
    shaped = [m for m in metrics if m.transform != "percentile"]
    if small is None:
        # pure column expressions need no size check, and ranks check the size of their own counts
        small = fits_one_task(df) if any(_needs(m) for m in shaped) else None
    x = {m.column: f"_x_{m.column}" for m in metrics}
    df = df.withColumns({x[m.column]: num(m.column) for m in metrics})

    stats: list[Column] = []
    for m in shaped:
        stats += [_AGGREGATES[s](x[m.column]).alias(f"_{s}_{m.column}") for s in _needs(m) if s != "median"]
    middle = {x[m.column]: f"_median_{m.column}" for m in shaped if "median" in _needs(m)}
    if stats or middle:
        table = df.groupBy(*scope).agg(F.count(F.lit(1)).alias("_rows"), *stats)
        if middle:
            mids = medians(df, scope, middle)
            table = null_safe_join(table, mids, scope) if scope else beside(table, mids)
        if scope:
            df = lookup(df, table, scope, weight="_rows", small=small)
        else:
            df = beside(df, table.drop("_rows"))
    for m in shaped:
        named = {s: F.col(f"_{s}_{m.column}") for s in _needs(m)}
        df = df.withColumn(f"score_{m.column}", TRANSFORMS[m.transform](F.col(x[m.column]), m, named))
    df = df.drop(*[c for c in df.columns if any(c == f"_{s}_{m.column}" for m in shaped for s in _needs(m))])

    fresh = [m for m in ranked if m.column not in ranks]
    if fresh:
        df = with_ranks(df, {x[m.column]: f"_pct_{m.column}" for m in fresh}, scope, pct=True, small=small)
    for m in ranked:
        pct = F.col(ranks.get(m.column, f"_pct_{m.column}"))
        oriented = pct if m.better == "high" else F.lit(1.0) - pct
        if scope:  # a row without a scope value belongs to no population
            oriented = F.when(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in scope]), oriented)
        df = df.withColumn(f"score_{m.column}", oriented).drop(f"_pct_{m.column}")
    return df.drop(*x.values())


def pass_indicator(bonus: PassBonus) -> Column:
    """Soft AND of the criteria: a product of steep sigmoids, 0 for a missing value."""
    parts = [F.coalesce(logistic(num(c), t, bonus.k, clip=700.0), F.lit(0.0)) for c, t in bonus.criteria]
    return reduce(lambda a, b: a * b, parts, F.lit(1.0))


def score(df: DataFrame, preset: Preset, ranks: dict[str, str] | None = None) -> DataFrame:
    """Gate, transform and fold into ``composite``. Keeps every gated row. ``ranks`` as in ``transform_metrics``."""
    require_columns(df, [c for c, _, _ in preset.prefilter])
    df = gates(df, [Condition(*f) for f in preset.prefilter])
    if preset.gate:
        df = gate(df, *preset.gate)
    present = [m for m in preset.metrics if m.column in df.columns]
    if not present:
        raise ValueError("no scoring metric of the preset is present")
    scope = [preset.antigen_col] if preset.scope == "per_antigen" and preset.antigen_col in df.columns else []
    df = transform_metrics(df, present, scope, ranks=ranks)
    total = sum(m.weight for m in present)
    terms = [F.lit(m.weight / total) * F.coalesce(F.col(f"score_{m.column}"), F.lit(0.0)) for m in present]
    df = df.withColumn("composite", reduce(lambda a, b: a + b, terms, F.lit(0.0)))
    if preset.bonus:
        require_columns(df, [c for c, _ in preset.bonus.criteria])
        df = df.withColumn("pass_indicator", pass_indicator(preset.bonus))
        df = df.withColumn("composite", F.col("composite") + F.lit(preset.bonus.gain) * F.col("pass_indicator"))
    return df


def best_first(key: Sequence[str], composite: str = "composite") -> list[Column]:
    return [F.col(composite).desc(), *[F.col(k).asc() for k in key]]


def select_topk(df: DataFrame, preset: Preset, key: Sequence[str]) -> DataFrame:
    """Top k of each group by composite; the whole table's top k when the group column is absent."""
    if not (preset.group and preset.topk):
        return df
    if preset.group not in df.columns:
        return df.orderBy(*best_first(key)).limit(preset.topk)
    return top_k(df, [preset.group], best_first(key), preset.topk)


def score_and_select(df: DataFrame, preset: Preset, key: Sequence[str]) -> DataFrame:
    return select_topk(score(df, preset), preset, key)


def rank_in_group(df: DataFrame, groups: Sequence[str], key: Sequence[str], composite: str = "composite") -> DataFrame:
    """Full ranking, nothing dropped: ``rank_in_group`` 1..n with ``key`` breaking ties."""
    return row_rank(df, groups, best_first(key, composite))


def select_dedup_topk(df: DataFrame, dedupe: str, group: str, key: Sequence[str], k: int, composite: str = "composite") -> DataFrame:
    """Best row per ``dedupe`` value, then the top k of each group, with ``rank_in_group``."""
    best = top_k(df, [dedupe], best_first(key, composite), 1)
    return top_k(best, [group], best_first(key, composite), k, out="rank_in_group")


def row_wise(preset: Preset) -> bool:
    """Whether no score of the preset depends on other rows, percentiles aside."""
    return all(m.transform == "percentile" or not _needs(m) for m in preset.metrics)


def select_all(df: DataFrame, presets: dict[str, Preset], key: Sequence[str], group: str, keep: Sequence[str]) -> DataFrame:
    """The selections of several presets, tagged by ``world``: (world, group, keep).

    Presets that take the same top k of ``group`` share one pass: percentiles are ranked together, rows are dealt
    by group once, scored there, and each preset ranks them in place. That holds a group in one task, so groups
    of more rows than that, and presets whose scores need statistics of the rows they keep, go one by one.
    """
    first = next(iter(presets.values()))
    gated = lambda p: bool(p.gate or p.prefilter)
    percentiles = lambda p: [m.column for m in p.metrics if m.transform == "percentile" and m.column in df.columns]
    alike = group in df.columns and all(
        p.group == group and p.topk and p.topk == first.topk and row_wise(p) and (not percentiles(p) or not gated(p) and p.scope == "pooled") for p in presets.values()
    )
    if not alike or key_load(df, [group])[1] > rows_per_task(df.sparkSession):
        picks = [score_and_select(df, p, key).select(F.lit(name).alias("world"), group, *keep) for name, p in presets.items()]
        return reduce(DataFrame.unionByName, picks)
    ranks = {c: f"_rank_{c}" for p in presets.values() for c in percentiles(p)}
    dealt = df.withColumns({f"_of_{c}": num(c) for c in ranks})
    if ranks:
        dealt = with_ranks(dealt, {f"_of_{c}": r for c, r in ranks.items()}, pct=True)
    dealt = dealt.repartition(F.col(group))
    columns = dealt.columns
    for name, p in presets.items():
        require_columns(df, [c for c, _, _ in p.prefilter] + ([p.gate[0]] if p.gate else []))
        held = all_of([Condition(*f) for f in p.prefilter] + ([Condition(p.gate[0], "<=", p.gate[1])] if p.gate else []))
        scored = score(dealt, replace(p, gate=None, prefilter=()), ranks)
        dealt = scored.withColumn(f"_c_{name}", F.when(held, F.col("composite"))).select(*columns, f"_c_{name}")
        columns = dealt.columns
    worlds = []
    for name in presets:
        place = F.row_number().over(Window.partitionBy(group).orderBy(*best_first(key, f"_c_{name}")))
        dealt = dealt.withColumn(f"_n_{name}", place)  # rows a preset does not keep come last
        worlds.append(F.when(F.col(f"_c_{name}").isNotNull() & (F.col(f"_n_{name}") <= first.topk), F.lit(name)))
    return dealt.select(F.explode(F.array_compact(F.array(*worlds))).alias("world"), group, *keep)


def recut(df: DataFrame, depth: int) -> DataFrame:
    return df.where(F.col("rank_in_group") <= depth)


def swap_term(
    df: DataFrame, old_term: str, value: str, weight: float, method: str = "average", out: str = "composite_swapped", population: DataFrame | None = None
) -> DataFrame:
    """Replace one weighted term of a stored composite by the percentile of another metric (lower is better).

    ``population`` is a table with the same rows that is cheaper to read, such as the one that was scored.
    """
    ranked = with_rank(df, value, out="_pct", method=method, pct=True, population=population)
    fresh = F.lit(weight) * (F.lit(1.0) - F.col("_pct"))
    return ranked.withColumn(out, F.col("composite") - F.col(old_term) + fresh).drop("_pct")


def calibrate_ties(df: DataFrame, value: str, stored: str, weight: float) -> DataFrame:
    """Which tie method reproduces a stored score: one row per method with its largest error.

    Rows of one value share their ranks, so the least and the greatest stored score of a value hold its largest error.
    """
    target = F.col(stored) / F.lit(weight)
    steps = df.where(F.col(value).isNotNull()).groupBy(value)
    steps, distinct = freeze_counted(steps.agg(F.count(F.lit(1)).alias("n_ties"), F.min(target).alias("_lo"), F.max(target).alias("_hi")))
    small = distinct <= rows_per_task(df.sparkSession)
    ladder = running_total(steps, [], [F.col(value)], "n_ties", "below", small=small)
    ladder = running_total(ladder, [], [F.col(value)], out="_dense", small=small)
    ladder = beside(ladder, steps.agg(F.sum("n_ties").alias("_n")))
    n, before, ties = F.col("_n"), F.col("below"), F.col("n_ties")
    ranks = {"average": average_rank() / n, "min": (before + 1.0) / n, "max": (before + ties).cast("double") / n, "dense": (F.col("_dense") + 1.0) / F.lit(distinct)}
    worst = lambda r: F.max(F.greatest(F.abs(F.lit(1.0) - r - F.col("_lo")), F.abs(F.lit(1.0) - r - F.col("_hi"))))
    return ladder.agg(*[worst(r).alias(m) for m, r in ranks.items()]).unpivot([], list(ranks), "method", "max_error")


def compare_presets(df: DataFrame, first: Preset, second: Preset, key: Sequence[str], value: str, group: str = "id") -> DataFrame:
    """Selections of two presets side by side per group: sizes, how many are new, min/median/max of ``value``."""
    picks = {}
    for name, preset in (("a", first), ("b", second)):
        picks[name] = score_and_select(df, preset, key).select(group, *key, num(value).alias("value"))
    both = reduce(DataFrame.unionByName, [p.withColumn("side", F.lit(s)) for s, p in picks.items()])
    # a selection holds at most k rows per group, so the plain median is bounded
    per_side = both.groupBy(group).agg(
        *[
            agg(F.when(F.col("side") == s, F.col("value"))).alias(f"{s}_{label}")
            for s in ("a", "b")
            for label, agg in (("min", F.min), ("median", lambda c: F.percentile(c, 0.5)), ("max", F.max))
        ],
        *[F.count(F.when(F.col("side") == s, F.lit(1))).alias(f"n_{s}") for s in ("a", "b")],
    )
    fresh = picks["b"].join(picks["a"], [group, *key], "left_anti").groupBy(group).agg(F.count(F.lit(1)).alias("n_new"))
    return per_side.join(fresh, group, "left").fillna(0, ["n_new"])
