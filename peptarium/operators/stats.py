"""Summaries, correlations, AUC, shortlist validation, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.functions.numeric import num
from peptarium.operators.ordering import (
    average_rank,
    beside,
    first_per,
    lookup,
    medians,
    null_safe_join,
    quantiles,
    row_rank,
    running_total,
    value_ladder,
    value_steps,
    with_ranks,
)
from peptarium.operators.predicates import FOUR_FILTER, Condition, all_of
from peptarium.operators.scoring import best_first, select_all
from peptarium.plans.presets import SCORED, Preset
from peptarium.session import freeze, rows_per_task


def n_rows() -> Column:
    return F.count(F.lit(1))


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def valid_row(conditions: Sequence[Condition]) -> Column:
    return reduce(lambda a, b: a & b, [num(c.column).isNotNull() for c in conditions])


def pass_rates(df: DataFrame, dataset: str, conditions: Sequence[Condition] = FOUR_FILTER) -> DataFrame:
    """Per data set: passes of each filter and of all together, over all rows and over valid rows."""
    named = [(c.column, c.test()) for c in conditions] + [("all_filters", all_of(conditions))]
    counted = df.groupBy(dataset).agg(
        n_rows().alias("n_all"),
        F.sum(valid_row(conditions).cast("bigint")).alias("n_valid"),
        *[F.sum(test.cast("bigint")).alias(f"_{name}") for name, test in named],
    )
    rows = F.array(*[F.struct(F.lit(name).alias("filter"), F.col(f"_{name}").alias("n_pass")) for name, _ in named])
    return counted.select(dataset, "n_all", "n_valid", F.inline(rows)).select(
        dataset,
        "filter",
        "n_all",
        "n_valid",
        "n_pass",
        rate(F.col("n_pass"), F.col("n_all")).alias("rate_all"),
        rate(F.col("n_pass"), F.col("n_valid")).alias("rate_valid"),
    )


def passes_per_group(a: DataFrame, b: DataFrame, group: str, flag: str = "is_pass") -> DataFrame:
    """Passes per id in two sets side by side, zero-filled, ids with any pass."""
    count = lambda df, name: df.groupBy(group).agg(F.sum(F.col(flag).cast("bigint")).alias(name))
    both = count(a, "passes_a").join(count(b, "passes_b"), group, "full_outer").fillna(0, ["passes_a", "passes_b"])
    return both.where((F.col("passes_a") > 0) | (F.col("passes_b") > 0))


def split_summary(df: DataFrame, group: str, medians: Sequence[str], conditions: Sequence[Condition] = FOUR_FILTER) -> DataFrame:
    """Per group: rows, valid rows, passes, both rates and the medians of some metrics."""
    counts = df.groupBy(group).agg(
        n_rows().alias("n_total"),
        F.sum(valid_row(conditions).cast("bigint")).alias("n_valid"),
        F.sum(all_of(conditions).cast("bigint")).alias("n_pass"),
    )
    counts = counts.withColumn("rate_total", rate(F.col("n_pass"), F.col("n_total")))
    counts = counts.withColumn("rate_valid", rate(F.col("n_pass"), F.col("n_valid")))
    mids = medians_wide(df, [group], medians)
    return null_safe_join(counts, mids, [group])


def medians_wide(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact median of several columns per group, in one ranked pass over (group, metric, value)."""
    numeric = df.select(*groups, *[num(c).alias(f"_n_{c}") for c in columns])
    return medians(numeric, groups, {f"_n_{c}": f"median_{c}" for c in columns})


def gate_summary(df: DataFrame, keys: Sequence[str], column: str, threshold: float, size: str, order: str) -> DataFrame:
    """Per island: designs, designs past the gate, and the first island size."""
    passed = F.coalesce(num(column) <= threshold, F.lit(False))
    return df.groupBy(*keys).agg(n_rows().alias("n_designs"), F.sum(passed.cast("bigint")).alias("n_gated"), F.min_by(size, order).alias("island_size"))


def gate_feasibility(summary: DataFrame, k: int) -> DataFrame:
    """How many islands have k gated designs, none, or fewer than k."""
    n = F.col("n_gated")
    count = lambda c: F.sum(c.cast("bigint"))
    return summary.agg(n_rows().alias("n_islands"), count(n >= k).alias("n_enough"), count(n == 0).alias("n_empty"), count(n < k).alias("n_short"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(n_rows().alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col(column).asc()).limit(top) if top else counts


def metric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, median, min, max and non-null count per metric."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), num(c).alias("value")) for c in columns])))
    base = long.groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max")
    )
    mids = quantiles(long.where(F.col("value").isNotNull()), ["metric"], "value", {"median": 0.5})
    return base.join(mids, "metric", "left")


# ---------------------------------------------------------------- correlation


def _paired(df: DataFrame, x: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    rows = df.select(*keep, num(x).alias("_x"), num(y).alias("_y"))
    return rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())


def _ranked_pair(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    ranked = with_ranks(rows, {"_x": "_rx", "_y": "_ry"}, groups, many_groups=bool(groups))
    return ranked.withColumn("_x", F.col("_rx")).withColumn("_y", F.col("_ry"))


def safe_corr(x: str = "_x", y: str = "_y") -> Column:
    """Pearson, null instead of NaN when a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, F.corr(x, y))


def corr(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    rows = _paired(df, x, y)
    if method == "spearman":
        rows = _ranked_pair(rows, [])
    return rows.agg(n_rows().alias("n"), safe_corr().alias("r"))


def corr_by_group(df: DataFrame, group: str, x: str, y: str, min_n: int = 12, method: str = "pearson") -> DataFrame:
    rows = _paired(df, x, y, [group]).where(F.col(group).isNotNull())
    if method == "spearman":
        rows = _ranked_pair(rows, [group])
    return rows.groupBy(group).agg(n_rows().alias("n"), safe_corr().alias("r")).where(F.col("n") >= min_n)


def within_corr(df: DataFrame, group: str, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Fixed-effect correlation: both sides demeaned per group, then pooled. Reports r, n and its t.

    Pearson needs no second pass: the pooled cross products of demeaned values are the sums of
    the groups' own co-moments.
    """
    rows = _paired(df, x, y, [group]).where(F.col(group).isNotNull())
    if method == "pearson":
        per = rows.groupBy(group).agg(
            n_rows().alias("n"),
            (n_rows() * F.covar_pop("_x", "_y")).alias("sxy"),
            (n_rows() * F.var_pop("_x")).alias("sxx"),
            (n_rows() * F.var_pop("_y")).alias("syy"),
        )
        out = per.agg(F.sum("n").alias("n"), (F.sum("sxy") / F.sqrt(F.sum("sxx") * F.sum("syy"))).alias("r"))
    else:
        means = rows.groupBy(group).agg(n_rows().alias("_rows"), F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
        centred = lookup(rows, means, [group], weight="_rows")
        # rounding folds values that differ only by summation order into one tie
        centred = centred.select(F.round(F.col("_x") - F.col("_mx"), 9).alias("_x"), F.round(F.col("_y") - F.col("_my"), 9).alias("_y"))
        out = _ranked_pair(centred, []).agg(n_rows().alias("n"), safe_corr().alias("r"))
    return out.withColumn("t", F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r"))))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    rows = _paired(df, x, y)
    return rows.agg(
        n_rows().alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_r2("_y", "_x").alias("r2"),
    )


def auc(df: DataFrame, score: str, label: str, groups: Sequence[str] = ()) -> DataFrame:
    """Mann-Whitney AUC where a lower score means positive; ties count half; null for an empty class.

    Scores are counted per distinct value first, so only the ladder of values is ever ordered.
    """
    rows = df.select(*groups, num(score).alias("_s"), F.col(label).cast("boolean").alias("_l"))
    rows = rows.where(F.col("_s").isNotNull() & F.col("_l").isNotNull())
    steps, n = value_steps(rows, [*groups, "_l"], "_s")
    return _auc_of(steps, groups, n <= rows_per_task(df.sparkSession))


def _auc_of(steps: DataFrame, groups: Sequence[str], small: bool) -> DataFrame:
    """The AUC from counts ``n_ties`` per (group, ``_l``, ``_s``)."""
    groups = list(groups)
    ladder = steps.groupBy(*groups, "_s").agg(F.sum("n_ties").alias("n_ties"), F.sum(F.when(F.col("_l"), F.col("n_ties")).otherwise(0)).alias("_pos"))
    ladder = running_total(ladder, groups, [F.col("_s").desc()], "n_ties", "below", small=small)
    table = ladder.groupBy(*groups).agg(
        F.sum("_pos").alias("n_pos"), F.sum(F.col("n_ties") - F.col("_pos")).alias("n_neg"), F.sum(F.col("_pos") * average_rank()).alias("_ranks")
    )
    p, n = F.col("n_pos"), F.col("n_neg")
    return table.select(*groups, "n_pos", "n_neg", F.when((p > 0) & (n > 0), (F.col("_ranks") - p * (p + 1) / 2.0) / (p * n)).alias("auc"))


def sweep_report(df: DataFrame, cell: Sequence[str], score: str, label: str) -> DataFrame:
    """AUC and both class medians per parameter cell."""
    classes = df.select(*cell, num(score).alias("_s"), F.col(label).cast("boolean").alias("_l")).where(F.col("_s").isNotNull() & F.col("_l").isNotNull())
    steps, n = value_steps(classes, [*cell, "_l"], "_s")  # the only time the input is read
    small = n <= rows_per_task(df.sparkSession)
    ranks = _auc_of(steps, cell, small)
    mids = quantiles(steps, [*cell, "_l"], "_s", {"_m": 0.5}, small, steps)
    mids = mids.groupBy(*cell).agg(F.max(F.when(F.col("_l"), F.col("_m"))).alias("med_free"), F.max(F.when(~F.col("_l"), F.col("_m"))).alias("med_clash"))
    return null_safe_join(ranks, mids, list(cell))


def set_pr(predicted: DataFrame, true: DataFrame, cell: Sequence[str], member: Sequence[str], design: Sequence[str]) -> DataFrame:
    """Micro-averaged precision and recall of residue sets per cell, and the correlation of set sizes.

    ``predicted`` is (cell, design, member), ``true`` is (design, member); both distinct.
    """
    key = [*design, *member]
    hits = predicted.join(true.withColumn("_t", F.lit(1)), key, "left")
    sizes = hits.groupBy(*cell, *design).agg(n_rows().alias("n_pred"), F.sum(F.coalesce("_t", F.lit(0))).alias("tp"))
    truth = true.groupBy(*design).agg(n_rows().alias("n_true"))
    # a design counts in every cell; where it has no prediction it only adds to the totals of the true sizes
    everyone = predicted.select(*design).distinct().join(truth, list(design), "full_outer").agg(
        n_rows().alias("n_designs"), F.coalesce(F.sum("n_true"), F.lit(0)).alias("_y"), F.sum(F.col("n_true").cast("double") * F.col("n_true")).alias("_yy")
    )
    met = sizes.join(truth, list(design), "left").withColumn("_x", F.col("n_pred").cast("double"))
    sums = met.groupBy(*cell).agg(
        F.sum("tp").alias("tp"),
        F.sum("n_pred").alias("_px"),
        F.sum(F.col("_x") * F.col("_x")).alias("_xx"),
        F.sum(F.col("_x") * F.coalesce("n_true", F.lit(0))).alias("_xy"),
    )
    full = beside(sums, everyone)
    n = F.col("n_designs").cast("double")
    mx, my = F.col("_px") / n, F.col("_y") / n
    vx, vy = F.col("_xx") / n - mx * mx, F.coalesce("_yy", F.lit(0.0)) / n - my * my
    spread = F.when((vx > 1e-12 * mx * mx) & (vy > 1e-12 * my * my), F.sqrt(vx * vy))
    out = full.select(
        *cell,
        "tp",
        (F.col("_px") - F.col("tp")).alias("fp"),
        (F.col("_y") - F.col("tp")).alias("fn"),
        "n_designs",
        ((F.col("_xy") / n - mx * my) / spread).alias("pearson_r"),
    )
    return out.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))


def pr_at(df: DataFrame, score: str, label: str, fracs: Sequence[float], key: Sequence[str]) -> DataFrame:
    """Precision and recall when the lowest fraction by score is kept; ``key`` makes ties stable."""
    rows = df.select(*key, num(score).alias("_s"), F.col(label).cast("int").alias("_l")).where(F.col("_s").isNotNull())
    ranked = row_rank(rows, [], [F.col("_s").asc(), *[F.col(k) for k in key]], out="_r")
    total = rows.agg(n_rows().alias("_n"), F.sum("_l").alias("_pos"))
    cut = F.greatest(F.lit(1), F.rint(F.col("_f") * F.col("_n")).cast("bigint"))
    wanted = beside(ranked.select("_r", "_l"), total).select("_r", "_l", "_n", "_pos", F.explode(F.array(*[F.lit(float(f)) for f in fracs])).alias("_f"))
    kept = wanted.where(F.col("_r") <= cut)
    out = kept.groupBy(F.col("_f").alias("frac")).agg(n_rows().alias("kept"), F.sum("_l").alias("tp"), F.max("_pos").alias("_pos"))
    return out.select("frac", "kept", "tp", (F.col("tp") / F.col("kept")).alias("precision"), rate(F.col("tp"), F.col("_pos")).alias("recall"))


def validate_shortlist(full: DataFrame, selected: DataFrame, group: str, key: Sequence[str], k: int, flag: str = "is_pass") -> DataFrame:
    """Recall (with its ceiling at k per group), capacity-adjusted recall, precision and coverage."""
    marked = full.select(group, *key, F.col(flag).cast("boolean").alias("_p")).join(
        selected.select(*key, F.lit(1).alias("_s")), list(key), "left"
    )
    picked = F.col("_s").isNotNull()
    per = marked.groupBy(group).agg(
        F.sum(F.col("_p").cast("bigint")).alias("n_true"),
        F.sum((F.col("_p") & picked).cast("bigint")).alias("kept"),
        F.sum(picked.cast("bigint")).alias("n_sel"),
    )
    has = F.col("n_true") > 0
    cap = F.least(F.col("n_true"), F.lit(k))
    totals = per.agg(
        F.sum("n_true").alias("n_truepass"),
        F.sum("n_sel").alias("n_selected"),
        F.sum("kept").alias("tp"),
        F.sum(cap).alias("_cap"),
        F.avg(F.when(has, F.col("kept") / cap)).alias("per_group_recall"),
        F.sum(has.cast("bigint")).alias("n_groups"),
        F.sum((F.col("kept") > 0).cast("bigint")).alias("n_groups_kept"),
    )
    return totals.select(
        "n_truepass",
        "n_selected",
        "tp",
        rate(F.col("tp"), F.col("n_truepass")).alias("recall"),
        rate(F.col("_cap"), F.col("n_truepass")).alias("ceiling"),
        "per_group_recall",
        rate(F.col("tp"), F.col("n_selected")).alias("precision"),
        rate(F.col("n_groups_kept"), F.col("n_groups")).alias("coverage"),
        "n_groups_kept",
        "n_groups",
    )


def capture_curve(df: DataFrame, group: str, ks: Sequence[int], key: Sequence[str], flag: str = "is_pass", composite: str = "composite") -> DataFrame:
    """Per k: share of passer groups that keep a passer in their top k, and mean capacity-adjusted recall."""
    ranked = row_rank(df.select(group, *key, composite, F.col(flag).cast("boolean").alias("_p")), [group], best_first(key, composite), out="_r")
    passers = ranked.where("_p")
    kept = [F.sum((F.col("_r") <= k).cast("bigint")).alias(f"_k{k}") for k in ks]
    per = passers.groupBy(group).agg(n_rows().alias("n"), *kept)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_k{k}").alias("kept")) for k in ks])
    long = per.select(group, "n", F.inline(rows))
    return long.groupBy("k").agg(
        n_rows().alias("n_groups"),
        F.avg((F.col("kept") > 0).cast("double")).alias("coverage"),
        F.avg(F.col("kept") / F.least(F.col("n"), F.col("k"))).alias("recall"),
    )


def global_capture(df: DataFrame, fracs: Sequence[float], flag: str = "is_pass", composite: str = "composite") -> DataFrame:
    """Passers inside the top x% of the whole table by composite (average-rank percentile)."""
    rows = df.select(composite, F.col(flag).cast("boolean").alias("_p"))
    ladder = value_ladder(rows, [], composite, [F.sum(F.col("_p").cast("bigint")).alias("_pos")])
    pct = average_rank() / F.col("n")
    totals = ladder.agg(
        F.sum("_pos").alias("n_pass"), *[F.sum(F.when(pct >= 1.0 - f, F.col("_pos")).otherwise(0)).alias(f"_f{i}") for i, f in enumerate(fracs)]
    )
    rows = F.array(*[F.struct(F.lit(float(f)).alias("frac"), F.col(f"_f{i}").alias("captured")) for i, f in enumerate(fracs)])
    return totals.select("n_pass", F.inline(rows)).select("frac", "n_pass", "captured", rate(F.col("captured"), F.col("n_pass")).alias("share"))


# ---------------------------------------------------------------- bands and histograms


def band_report(
    df: DataFrame, truth: str, before: str, after: str, thresholds: Sequence[float] = (1, 5, 10)
) -> DataFrame:
    """Flags at each threshold before and after carving, within bands of the true clash count."""
    t, b, a = num(truth), num(before), F.coalesce(num(after), num(before))
    rows = df.select(t.alias("_t"), b.alias("_b"), a.alias("_a")).where(F.col("_t").isNotNull() & F.col("_b").isNotNull())
    bands = {"clash_free": F.col("_t") == 0, "clash_le3": F.col("_t") <= 3, "clash_ge10": F.col("_t") >= 10, "all": F.lit(True)}
    member = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in bands.items()]))
    cells = rows.select("_t", "_b", "_a", F.explode(member).alias("band"))
    flags = [f for t in thresholds for f in (
        F.sum((F.col("_b") >= t).cast("bigint")).alias(f"before_ge{t:g}"),
        F.sum((F.col("_a") >= t).cast("bigint")).alias(f"after_ge{t:g}"),
    )]
    return cells.groupBy("band").agg(
        n_rows().alias("n"),
        F.avg("_b").alias("mean_before"),
        F.avg("_a").alias("mean_after"),
        F.sum((F.col("_a") < F.col("_b")).cast("bigint")).alias("n_carved"),
        F.when(F.sum("_b") != 0, F.lit(1.0) - F.sum("_a") / F.sum("_b")).alias("reduction"),
        *flags,
    )


# Lower edges of the true-clash bands.
SELECTIVITY_EDGES = (0, 1, 4, 7, 11, 16, 26)


def selectivity(df: DataFrame, truth: str, before: str, after: str, threshold: float, min_n: int = 20) -> DataFrame:
    """Share flagged before and after per band of true clash; null where a band has too few rows."""
    rows = df.select(num(truth).alias("_t"), num(before).alias("_b"), num(after).alias("_a")).where(F.col("_t") >= 0)
    band = F.coalesce(*[F.when(F.col("_t") >= e, F.lit(i)) for i, e in reversed(list(enumerate(SELECTIVITY_EDGES)))])
    flagged = lambda c: F.when(n_rows() >= min_n, F.avg(F.coalesce(F.col(c) >= threshold, F.lit(False)).cast("double")))
    return rows.groupBy(band.alias("band")).agg(n_rows().alias("n"), flagged("_b").alias("share_before"), flagged("_a").alias("share_after"))


def clip_limits(
    df: DataFrame, column: str, low: float | None, high: float, fixed_low: float = 0.0, steps: DataFrame | None = None
) -> tuple[float, float]:
    """Exact percentile limits of a histogram axis (two numbers, so they may come to the driver)."""
    probs = {"hi": high} | ({"lo": low} if low is not None else {})
    rows = df.select(num(column).alias("_v")).where(F.col("_v").isNotNull())
    if steps is not None:
        steps = steps.groupBy(F.col(column).alias("_v")).agg(F.sum("n_ties").alias("n_ties"))
    found = quantiles(rows, [], "_v", probs, steps=steps).first()
    return (found["lo"] if low is not None else fixed_low), found["hi"]


def counted_values(df: DataFrame, column: str, groups: Sequence[str] = ()) -> DataFrame:
    """Counts ``n_ties`` per (group, value), written once: limits, bins and totals all come from them."""
    return value_steps(df.select(*groups, num(column).alias(column)), groups, column)[0]


def histogram(
    df: DataFrame, column: str, lo: float, hi: float, bins: int, groups: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """Density over ``bins`` equal bins of [lo, hi]; values outside are clipped to the edges.

    ``weight`` names a column that says how many rows each row stands for. Null groups are a group.
    """
    width = (hi - lo) / bins
    v = F.greatest(F.lit(lo), F.least(F.lit(hi), num(column)))
    # the upper edge belongs to the last bin
    index = F.least(F.floor((v - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
    rows = df.where(num(column).isNotNull())
    n = F.sum(weight) if weight else n_rows()
    counts = rows.groupBy(*groups, index.cast("int").alias("bin")).agg(n.alias("n"))
    # at most ``bins`` rows per group
    joined = counts.withColumn("_total", F.sum("n").over(Window.partitionBy(*groups)))
    return joined.select(
        *groups, "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("edge"), "n", (F.col("n") / (F.col("_total") * F.lit(width))).alias("density")
    )


def count_bins(lo: float, hi: float) -> tuple[float, float, int]:
    """Integer-aligned bins of width 2 for count metrics: (lo, hi, bins)."""
    import math

    low, top = math.floor(lo), math.ceil(hi)
    bins = max(1, math.ceil((top - low) / 2))
    return float(low), float(low + 2 * bins), bins


# ---------------------------------------------------------------- selections, categories, read-outs


def world_table(df: DataFrame, presets: dict[str, Preset], key: Sequence[str], group: str = "id") -> DataFrame:
    """Medians of the scored metrics over each preset's selection, per id and pooled (null id)."""
    # a selection is at most k rows per id, written once; the pooled median still goes through the exact ladder
    both = freeze(select_all(df, presets, key, group, [num(c).alias(c) for c in SCORED]))
    scoped = both.select("world", F.explode(F.array(F.col(group).cast("string"), F.lit("*"))).alias("scope"), *SCORED)
    n = scoped.groupBy("world", "scope").agg(n_rows().alias("n"))
    return null_safe_join(n, medians_wide(scoped, ["world", "scope"], SCORED), ["world", "scope"])


def axis_coverage(pool: DataFrame, sample: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sampled range over pool range per axis."""

    def spans(df: DataFrame, name: str) -> DataFrame:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("axis"), num(c).alias("v")) for c in columns])))
        return long.groupBy("axis").agg((F.max("v") - F.min("v")).alias(name))

    return spans(pool, "pool_span").join(spans(sample, "sample_span"), "axis").withColumn(
        "coverage", F.col("sample_span") / (F.col("pool_span") + F.lit(1e-9))
    )


def best_per(df: DataFrame, groups: Sequence[str], metric: str, key: Sequence[str]) -> DataFrame:
    """The row with the lowest metric of each group, first by key on a tie."""
    return first_per(df.where(num(metric).isNotNull()), groups, [num(metric).asc(), *[F.col(k) for k in key]])


# Per-residue structure codes.
HELIX_CODES, STRAND_CODES = "HGI", "EB"


def ss_composition(codes: DataFrame, key: Sequence[str], code: str = "code") -> DataFrame:
    """Helix, strand and loop fractions of each key's residue codes and the dominant class."""
    helix, strand = F.col(code).isin(list(HELIX_CODES)), F.col(code).isin(list(STRAND_CODES))
    counts = codes.groupBy(*key).agg(n_rows().alias("n_residues"), F.sum(helix.cast("bigint")).alias("n_helix"), F.sum(strand.cast("bigint")).alias("n_strand"))
    counts = counts.withColumn("n_loop", F.col("n_residues") - F.col("n_helix") - F.col("n_strand"))
    counts = counts.withColumns({f"frac_{c}": F.col(f"n_{c}") / F.col("n_residues") for c in ("helix", "strand", "loop")})
    h, s, loop = F.col("n_helix"), F.col("n_strand"), F.col("n_loop")
    dominant = F.when((h >= s) & (h >= loop), "helix").when(s >= loop, "strand").otherwise("loop")
    return counts.withColumn("dominant_ss", dominant)


def ss_vs_pass(composition: DataFrame, rates: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(mean pass rate by dominant class, correlation of each fraction with the pass rate)."""
    joined = composition.join(rates, list(key))
    by_class = joined.groupBy("dominant_ss").agg(n_rows().alias("n_epitopes"), F.avg("pass_rate").alias("mean_pass_rate"), F.sum("n_passing").alias("total_passing"))
    fractions = ("frac_helix", "frac_strand", "frac_loop")
    long = joined.select("pass_rate", F.inline(F.array(*[F.struct(F.lit(c).alias("fraction"), F.col(c).alias("v")) for c in fractions])))
    return by_class, long.groupBy("fraction").agg(n_rows().alias("n"), safe_corr("v", "pass_rate").alias("r"))


def tile_summary(tiles: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per target: its length columns and the number of tiles (0 for a target too short to tile)."""
    counts = tiles.groupBy(*key).agg(n_rows().alias("tiles"))
    return targets.join(counts, list(key), "left").fillna(0, ["tiles"])


def readout_summary(df: DataFrame, ab: str, enrichment: str, flag: str) -> DataFrame:
    """Per antibody: members, passers, median enrichment and share above baseline."""
    rows = df.where(F.col(ab).isNotNull()).withColumn("_e", num(enrichment))
    counts = rows.groupBy(ab).agg(
        n_rows().alias("n"),
        F.sum(F.col(flag).cast("bigint")).alias("n_pass"),
        F.avg(F.when(F.col("_e").isNotNull(), (F.col("_e") > 0).cast("double"))).alias("frac_above"),
    )
    mids = quantiles(rows.where(F.col("_e").isNotNull()), [ab], "_e", {"med_enrich": 0.5})
    return counts.join(mids, ab, "left")


def score_filter_corr(df: DataFrame, composite: str, metrics: Sequence[str], flag: str = "is_pass") -> DataFrame:
    """Spearman of the composite with each filter metric, on all rows and on passers."""
    parts = []
    for subset, rows in (("all", df), ("passers", df.where(F.col(flag)))):
        for m in metrics:
            parts.append(corr(rows, composite, m, "spearman").select(F.lit(subset).alias("subset"), F.lit(m).alias("metric"), "n", "r"))
    return reduce(DataFrame.unionByName, parts)


def ratio_report(df: DataFrame, ratios: Sequence[str], truth: str, flag: str) -> DataFrame:
    """Per ratio metric: correlation with the truth and its mean over passing and failing rows."""
    long = df.select(
        num(truth).alias("_y"),
        F.col(flag).alias("_p"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), num(c).alias("_x")) for c in ratios])),
    ).where(F.col("_x").isNotNull())
    paired = F.col("_y").isNotNull()
    return long.groupBy("metric").agg(
        F.sum(paired.cast("bigint")).alias("n"),
        F.corr(F.when(paired, F.col("_x")), F.col("_y")).alias("r"),
        F.avg(F.when(F.col("_p"), F.col("_x"))).alias("passing_mean"),
        F.avg(F.when(~F.col("_p"), F.col("_x"))).alias("failing_mean"),
    )
