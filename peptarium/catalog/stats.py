"""Aggregation, correlation, validation and histogram queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from peptarium.catalog import REGISTRY
from peptarium.catalog.views import NEAR_SQL, POOL_SQL, READOUT_SQL, near_pass, pool, r6, readout, table
from peptarium.operators import sampling, stats
from peptarium.operators.predicates import four_filter
from peptarium.sources.tables import assay_columns, assay_map

NEAR = near_pass()
VALID_SQL = "overall_rmsd IS NOT NULL AND epitope_chunk_rmsd IS NOT NULL AND mean_pae IS NOT NULL AND af3_n_clash_res IS NOT NULL"
FILTER_SQL = {
    "overall_rmsd": "overall_rmsd <= 2",
    "epitope_chunk_rmsd": "epitope_chunk_rmsd <= 1",
    "mean_pae": "mean_pae < 5",
    "af3_n_clash_res": "af3_n_clash_res <= 12",
    "all_filters": NEAR_SQL,
}


@REGISTRY.add(
    "a1_pass_rates",
    f"WITH {POOL_SQL} "
    + " UNION ALL ".join(
        f"""SELECT antigen, '{n}' AS "filter", count(*) AS n_all, count(*) FILTER ({VALID_SQL}) AS n_valid, count(*) FILTER ({e}) AS n_pass,
  round(count(*) FILTER ({e}) / count(*), 6) AS rate_all, round(count(*) FILTER ({e}) / count(*) FILTER ({VALID_SQL}), 6) AS rate_valid FROM pool GROUP BY antigen"""
        for n, e in FILTER_SQL.items()
    ),
)
def pass_rates(spark, sf):
    return r6(stats.pass_rates(pool(spark, sf), "antigen", NEAR))


@REGISTRY.add(
    "a2_passes_per_group",
    f"""WITH {POOL_SQL}, g AS (SELECT id, count(*) FILTER (antigen = 'A' AND {NEAR_SQL}) AS passes_a, count(*) FILTER (antigen = 'R' AND {NEAR_SQL}) AS passes_b FROM pool GROUP BY id)
SELECT * FROM g WHERE passes_a > 0 OR passes_b > 0""",
)
def passes_per_group(spark, sf):
    rows = four_filter(pool(spark, sf), NEAR)
    return stats.passes_per_group(rows.where("antigen = 'A'"), rows.where("antigen = 'R'"), "id")


@REGISTRY.add(
    "a3_split_summary",
    f"""WITH {POOL_SQL} SELECT island_index, count(*) AS n_total, count(*) FILTER ({VALID_SQL}) AS n_valid, count(*) FILTER ({NEAR_SQL}) AS n_pass,
  round(count(*) FILTER ({NEAR_SQL}) / count(*), 6) AS rate_total,
  CASE WHEN count(*) FILTER ({VALID_SQL}) > 0 THEN round(count(*) FILTER ({NEAR_SQL}) / count(*) FILTER ({VALID_SQL}), 6) END AS rate_valid,
  round(quantile_cont(epitope_pae, 0.5), 7) AS median_epitope_pae, round(quantile_cont(mean_pae, 0.5), 7) AS median_mean_pae FROM pool GROUP BY island_index""",
)
def split_summary(spark, sf):
    out = stats.split_summary(pool(spark, sf), "island_index", ["epitope_pae", "mean_pae"], NEAR)
    return r6(out, 7).withColumns({c: F.round(c, 6) for c in ("rate_total", "rate_valid")})


HOLED_SQL = "CASE WHEN island_index % 3 <> 0 THEN island_index % 3 END"


def _holed(spark, sf):
    """The pool with a group column that is null for a third of the rows."""
    return pool(spark, sf).withColumn("grp", F.when(F.col("island_index") % 3 != 0, F.col("island_index") % 3))


@REGISTRY.add(
    "a3_split_summary_null_group",
    f"""WITH {POOL_SQL}, h AS (SELECT *, {HOLED_SQL} AS grp FROM pool) SELECT grp, count(*) AS n_total, count(*) FILTER ({VALID_SQL}) AS n_valid,
  count(*) FILTER ({NEAR_SQL}) AS n_pass, round(quantile_cont(epitope_pae, 0.5), 7) AS median_epitope_pae FROM h GROUP BY grp""",
)
def split_summary_null_group(spark, sf):
    out = stats.split_summary(_holed(spark, sf), "grp", ["epitope_pae"], NEAR)
    return r6(out.select("grp", "n_total", "n_valid", "n_pass", "median_epitope_pae"), 7)


GATE_SQL = f"""{POOL_SQL}, g AS (SELECT id, island_index, count(*) AS n_designs, count(*) FILTER (epitope_pae <= 0.5) AS n_gated,
  min_by(af3_n_clash_res, key) AS island_size FROM pool GROUP BY id, island_index)"""


@REGISTRY.add("a4_gate_summary", f"WITH {POOL_SQL}, s AS (SELECT id, island_index, count(*) AS n_designs, count(*) FILTER (epitope_pae <= 0.5) AS n_gated, min_by(cylinder_ca_clashes, key) AS island_size FROM pool GROUP BY id, island_index) SELECT * FROM s")
def gate_summary(spark, sf):
    return stats.gate_summary(pool(spark, sf), ["id", "island_index"], "epitope_pae", 0.5, "cylinder_ca_clashes", "key")


@REGISTRY.add(
    "a4_gate_feasibility",
    f"""WITH {POOL_SQL}, s AS (SELECT count(*) FILTER (epitope_pae <= 0.5) AS n FROM pool GROUP BY id, island_index)
SELECT count(*) AS n_islands, count(*) FILTER (n >= 3) AS n_enough, count(*) FILTER (n = 0) AS n_empty, count(*) FILTER (n < 3) AS n_short FROM s""",
)
def gate_feasibility(spark, sf):
    return stats.gate_feasibility(gate_summary(spark, sf), 3)


@REGISTRY.add("a5_value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return stats.value_counts(table(spark, sf, "events"), "event_type")


@REGISTRY.add("a5_top_values", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, l_suppkey LIMIT 5")
def top_values(spark, sf):
    return stats.value_counts(table(spark, sf, "lineitem"), "l_suppkey", 5)


@REGISTRY.add(
    "a6_metric_summary",
    f"WITH {POOL_SQL}, k AS (SELECT * FROM pool WHERE lower(status) = 'ok') "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.5), 6) AS median FROM k"
        for c in ("af3_n_clash_res", "epitope_chunk_rmsd", "epitope_pae", "mean_pae")
    ),
)
def metric_summary(spark, sf):
    from peptarium.operators.predicates import status_ok

    return r6(stats.metric_summary(status_ok(pool(spark, sf)), ["af3_n_clash_res", "epitope_chunk_rmsd", "epitope_pae", "mean_pae"]))


def avg_rank_sql(col: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"(rank() OVER ({p}ORDER BY {col}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{col}) - 1) / 2.0)"


PAIR_SQL = f"{POOL_SQL}, v AS (SELECT id, af3_n_clash_res AS x, epitope_pae AS y FROM pool WHERE af3_n_clash_res IS NOT NULL AND epitope_pae IS NOT NULL)"


@REGISTRY.add("a7_pearson", f"WITH {PAIR_SQL} SELECT count(*) AS n, round(corr(x, y), 6) AS r FROM v")
def pearson(spark, sf):
    return r6(stats.corr(pool(spark, sf), "af3_n_clash_res", "epitope_pae"))


@REGISTRY.add("a7_spearman", f"WITH {PAIR_SQL}, k AS (SELECT {avg_rank_sql('x')} AS a, {avg_rank_sql('y')} AS b FROM v) SELECT count(*) AS n, round(corr(a, b), 6) AS r FROM k")
def spearman(spark, sf):
    return r6(stats.corr(pool(spark, sf), "af3_n_clash_res", "epitope_pae", "spearman"))


@REGISTRY.add("a8_corr_by_group", f"WITH {PAIR_SQL} SELECT id, count(*) AS n, round(corr(x, y), 6) AS r FROM v GROUP BY id HAVING count(*) >= 12")
def corr_by_group(spark, sf):
    return r6(stats.corr_by_group(pool(spark, sf), "id", "af3_n_clash_res", "epitope_pae"))


@REGISTRY.add(
    "a8_spearman_by_group",
    f"WITH {PAIR_SQL}, k AS (SELECT id, {avg_rank_sql('x', 'id')} AS a, {avg_rank_sql('y', 'id')} AS b FROM v) SELECT id, count(*) AS n, round(corr(a, b), 6) AS r FROM k GROUP BY id HAVING count(*) >= 12",
)
def spearman_by_group(spark, sf):
    return r6(stats.corr_by_group(pool(spark, sf), "id", "af3_n_clash_res", "epitope_pae", method="spearman"))


@REGISTRY.add(
    "a9_within_corr",
    f"""WITH {PAIR_SQL}, d AS (SELECT x - avg(x) OVER (PARTITION BY id) AS a, y - avg(y) OVER (PARTITION BY id) AS b FROM v),
r AS (SELECT count(*) AS n, corr(a, b) AS r FROM d) SELECT n, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t FROM r""",
)
def within_corr(spark, sf):
    return r6(stats.within_corr(pool(spark, sf), "id", "af3_n_clash_res", "epitope_pae"))


@REGISTRY.add(
    "a9_within_spearman",
    f"""WITH {PAIR_SQL}, d AS (SELECT round(x - avg(x) OVER (PARTITION BY id), 9) AS x, round(y - avg(y) OVER (PARTITION BY id), 9) AS y FROM v),
k AS (SELECT {avg_rank_sql('x')} AS a, {avg_rank_sql('y')} AS b FROM d), r AS (SELECT count(*) AS n, corr(a, b) AS r FROM k)
SELECT n, round(r, 5) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 3) AS t FROM r""",
)
def within_spearman(spark, sf):
    out = stats.within_corr(pool(spark, sf), "id", "af3_n_clash_res", "epitope_pae", "spearman")
    return out.withColumns({"r": F.round("r", 5), "t": F.round("t", 3)})


@REGISTRY.add(
    "a10_trend",
    f"WITH {PAIR_SQL} SELECT count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2 FROM v",
)
def trend(spark, sf):
    return r6(stats.trend(pool(spark, sf), "af3_n_clash_res", "epitope_pae"))


AUC_RANKS = "(rank() OVER ({p}ORDER BY s DESC) + (count(*) OVER (PARTITION BY {g}s) - 1) / 2.0)"


@REGISTRY.add(
    "a11_auc",
    f"""WITH {POOL_SQL}, v AS (SELECT af3_n_clash_res AS s, label AS l FROM pool WHERE af3_n_clash_res IS NOT NULL),
k AS (SELECT l, {AUC_RANKS.format(p='', g='')} AS r FROM v)
SELECT count(*) FILTER (l) AS n_pos, count(*) FILTER (NOT l) AS n_neg,
  round((sum(r) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2.0) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 6) AS auc FROM k""",
)
def auc(spark, sf):
    return r6(stats.auc(pool(spark, sf), "af3_n_clash_res", "label"))


@REGISTRY.add(
    "a11_auc_null_group",
    f"""WITH {POOL_SQL}, v AS (SELECT {HOLED_SQL} AS grp, af3_n_clash_res AS s, label AS l FROM pool WHERE af3_n_clash_res IS NOT NULL),
k AS (SELECT *, {AUC_RANKS.format(p='PARTITION BY grp ', g='grp, ')} AS r FROM v)
SELECT grp, count(*) FILTER (l) AS n_pos, count(*) FILTER (NOT l) AS n_neg,
  round((sum(r) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2.0) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 6) AS auc FROM k GROUP BY grp""",
)
def auc_null_group(spark, sf):
    return r6(stats.auc(_holed(spark, sf), "af3_n_clash_res", "label", ["grp"]))


@REGISTRY.add(
    "a12_sweep_report",
    f"""WITH {POOL_SQL}, v AS (SELECT island_index, epitope_pae AS s, label AS l FROM pool WHERE epitope_pae IS NOT NULL),
k AS (SELECT *, {AUC_RANKS.format(p='PARTITION BY island_index ', g='island_index, ')} AS r FROM v)
SELECT island_index, count(*) FILTER (l) AS n_pos, count(*) FILTER (NOT l) AS n_neg,
  round((sum(r) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2.0) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 7) AS auc,
  round(quantile_cont(s, 0.5) FILTER (l), 7) AS med_free, round(quantile_cont(s, 0.5) FILTER (NOT l), 7) AS med_clash FROM k GROUP BY island_index""",
)
def sweep_report(spark, sf):
    return r6(stats.sweep_report(pool(spark, sf), ["island_index"], "epitope_pae", "label"), 7)


@REGISTRY.add(
    "a13_set_precision_recall",
    """WITH p AS (SELECT DISTINCT q AS cell, l_suppkey, l_partkey FROM lineitem, (SELECT unnest([10, 25, 50]) AS q) WHERE l_quantity <= q),
t AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_discount >= 0.05),
d AS (SELECT cell, l_suppkey FROM (SELECT DISTINCT cell FROM p), (SELECT l_suppkey FROM p UNION SELECT l_suppkey FROM t)),
tp AS (SELECT cell, l_suppkey, count(*) AS np, count(t.l_partkey) AS tp FROM p LEFT JOIN t USING (l_suppkey, l_partkey) GROUP BY cell, l_suppkey),
nt AS (SELECT l_suppkey, count(*) AS nt FROM t GROUP BY l_suppkey),
f AS (SELECT cell, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp, coalesce(nt, 0) AS nt FROM d LEFT JOIN tp USING (cell, l_suppkey) LEFT JOIN nt USING (l_suppkey))
SELECT cell, sum(tp)::BIGINT AS tp, sum(np - tp)::BIGINT AS fp, sum(nt - tp)::BIGINT AS fn, count(*) AS n_designs, round(corr(np, nt), 6) AS pearson_r,
  round(sum(tp) / sum(np), 6) AS "precision", round(sum(tp) / sum(nt), 6) AS recall FROM f GROUP BY cell""",
)
def set_precision_recall(spark, sf):
    li = table(spark, sf, "lineitem")
    cells = li.withColumn("cell", F.explode(F.array(F.lit(10), F.lit(25), F.lit(50)))).where("l_quantity <= cell")
    predicted = cells.select("cell", "l_suppkey", "l_partkey").distinct()
    true = li.where("l_discount >= 0.05").select("l_suppkey", "l_partkey").distinct()
    return r6(stats.set_pr(predicted, true, ["cell"], ["l_partkey"], ["l_suppkey"]))


@REGISTRY.add(
    "a14_precision_at_fraction",
    f"""WITH {POOL_SQL}, v AS (SELECT label::INT AS l, row_number() OVER (ORDER BY epitope_chunk_rmsd, key) AS rn, count(*) OVER () AS n, sum(label::INT) OVER () AS pos FROM pool),
k AS (SELECT * FROM v, (SELECT unnest([0.01::DOUBLE, 0.1, 0.25]) AS frac) WHERE rn <= greatest(1, round_even(frac * n, 0)))
SELECT frac, count(*) AS kept, sum(l)::BIGINT AS tp, round(sum(l) / count(*), 6) AS "precision", round(sum(l) / max(pos), 6) AS recall FROM k GROUP BY frac""",
)
def precision_at_fraction(spark, sf):
    return r6(stats.pr_at(pool(spark, sf), "epitope_chunk_rmsd", "label", [0.01, 0.1, 0.25], ["key"]))


BAND_FLAGS = ", ".join(f"count(*) FILTER (b >= {t}) AS before_ge{t}, count(*) FILTER (a >= {t}) AS after_ge{t}" for t in (1, 5, 10))


@REGISTRY.add(
    "a17_band_report",
    f"""WITH {POOL_SQL}, v AS (SELECT af3_n_clash_res - 1 AS t, cylinder_ca_clashes AS b, coalesce(cylinder_native_aware, cylinder_ca_clashes) AS a FROM pool WHERE af3_n_clash_res IS NOT NULL),
k AS (SELECT 'clash_free' AS band, * FROM v WHERE t = 0 UNION ALL SELECT 'clash_le3', * FROM v WHERE t <= 3 UNION ALL SELECT 'clash_ge10', * FROM v WHERE t >= 10 UNION ALL SELECT 'all', * FROM v)
SELECT band, count(*) AS n, round(avg(b), 6) AS mean_before, round(avg(a), 6) AS mean_after, count(*) FILTER (a < b) AS n_carved, round(1.0 - sum(a) / sum(b), 6) AS reduction,
  {BAND_FLAGS} FROM k GROUP BY band""",
)
def band_report(spark, sf):
    rows = pool(spark, sf).withColumn("truth", F.col("af3_n_clash_res") - 1)
    return r6(stats.band_report(rows, "truth", "cylinder_ca_clashes", "cylinder_native_aware"))


@REGISTRY.add(
    "a18_selectivity",
    f"""WITH {POOL_SQL}, v AS (SELECT CASE WHEN t >= 26 THEN 6 WHEN t >= 16 THEN 5 WHEN t >= 11 THEN 4 WHEN t >= 7 THEN 3 WHEN t >= 4 THEN 2 WHEN t >= 1 THEN 1 ELSE 0 END AS band, b, a
  FROM (SELECT af3_n_clash_res - 1 AS t, epitope_chunk_rmsd * 10 AS b, epitope_chunk_rmsd * 8 AS a FROM pool) WHERE t IS NOT NULL)
SELECT band, count(*) AS n, CASE WHEN count(*) >= 1500 THEN round(avg((b >= 10)::INT), 6) END AS share_before, CASE WHEN count(*) >= 1500 THEN round(avg((a >= 10)::INT), 6) END AS share_after FROM v GROUP BY band""",
)
def selectivity(spark, sf):
    rows = pool(spark, sf).select((F.col("af3_n_clash_res") - 1).alias("t"), (F.col("epitope_chunk_rmsd") * 10).alias("b"), (F.col("epitope_chunk_rmsd") * 8).alias("a"))
    return r6(stats.selectivity(rows, "t", "b", "a", 10, min_n=1500))


@REGISTRY.add(
    "a19_histogram",
    f"""WITH {POOL_SQL}, lim AS (SELECT quantile_cont(mean_pae, 0.005) AS lo, quantile_cont(mean_pae, 0.995) AS hi FROM pool),
b AS (SELECT antigen, CAST(least(floor((greatest(lo, least(hi, mean_pae)) - lo) / ((hi - lo) / 25)), 24) AS INT) AS bin, lo, (hi - lo) / 25 AS w FROM pool, lim),
t AS (SELECT antigen, count(*) AS total FROM pool GROUP BY antigen)
SELECT antigen, bin, round(any_value(lo) + bin * any_value(w), 6) AS edge, count(*) AS n, round(count(*) / (any_value(total) * any_value(w)), 6) AS density FROM b JOIN t USING (antigen) GROUP BY antigen, bin""",
)
def histogram(spark, sf):
    rows = pool(spark, sf)
    values = stats.counted_values(rows, "mean_pae", ["antigen"])
    lo, hi = stats.clip_limits(values, "mean_pae", 0.005, 0.995, steps=values)
    return r6(stats.histogram(values, "mean_pae", lo, hi, 25, ["antigen"], "n_ties"))


@REGISTRY.add(
    "a19_count_histogram",
    f"""WITH {POOL_SQL}, lim AS (SELECT quantile_cont(af3_n_clash_res, 0.995) AS hi FROM pool),
b AS (SELECT CAST(least(floor(least(ceil(hi / 2) * 2, af3_n_clash_res) / 2), ceil(hi / 2) - 1) AS INT) AS bin FROM pool, lim WHERE af3_n_clash_res IS NOT NULL)
SELECT bin, bin * 2.0::DOUBLE AS edge, count(*) AS n, round(count(*) / (sum(count(*)) OVER () * 2.0), 6) AS density FROM b GROUP BY bin""",
)
def count_histogram(spark, sf):
    rows = pool(spark, sf)
    values = stats.counted_values(rows, "af3_n_clash_res")
    lo, hi, bins = stats.count_bins(*stats.clip_limits(values, "af3_n_clash_res", None, 0.995, steps=values))
    return r6(stats.histogram(values, "af3_n_clash_res", lo, hi, bins, weight="n_ties"))


@REGISTRY.add(
    "a21_axis_coverage",
    f"""WITH {POOL_SQL}, s AS (SELECT * FROM pool WHERE epitope_pae < 4 AND overall_rmsd > 0.5)
SELECT 'epitope_pae' AS axis, round(max(p.epitope_pae) - min(p.epitope_pae), 6) AS pool_span, round((SELECT max(epitope_pae) - min(epitope_pae) FROM s), 6) AS sample_span,
  round((SELECT max(epitope_pae) - min(epitope_pae) FROM s) / (max(p.epitope_pae) - min(p.epitope_pae) + 1e-9), 6) AS coverage FROM pool p
UNION ALL SELECT 'overall_rmsd', round(max(p.overall_rmsd) - min(p.overall_rmsd), 6), round((SELECT max(overall_rmsd) - min(overall_rmsd) FROM s), 6),
  round((SELECT max(overall_rmsd) - min(overall_rmsd) FROM s) / (max(p.overall_rmsd) - min(p.overall_rmsd) + 1e-9), 6) FROM pool p""",
)
def axis_coverage(spark, sf):
    rows = pool(spark, sf)
    return r6(stats.axis_coverage(rows, rows.where("epitope_pae < 4 AND overall_rmsd > 0.5"), ["epitope_pae", "overall_rmsd"]))


@REGISTRY.add(
    "a22_best_per_group",
    f"WITH {POOL_SQL}, r AS (SELECT id, key, epitope_pae, row_number() OVER (PARTITION BY id ORDER BY epitope_pae, key) AS rn FROM pool WHERE epitope_pae IS NOT NULL) SELECT id, key, epitope_pae FROM r WHERE rn = 1",
)
def best_per_group(spark, sf):
    return stats.best_per(pool(spark, sf), ["id"], "epitope_pae", ["key"]).select("id", "key", "epitope_pae")


SS_SQL = f"""{POOL_SQL}, c AS (SELECT id, substr('HGIEBTS', island_index, 1) AS code FROM pool),
g AS (SELECT id, count(*) AS n_residues, count(*) FILTER (code IN ('H', 'G', 'I')) AS n_helix, count(*) FILTER (code IN ('E', 'B')) AS n_strand FROM c GROUP BY id),
ss AS (SELECT *, n_residues - n_helix - n_strand AS n_loop FROM g),
f AS (SELECT id, n_residues, n_helix, n_strand, n_loop, n_helix / n_residues AS frac_helix, n_strand / n_residues AS frac_strand, n_loop / n_residues AS frac_loop,
  CASE WHEN n_helix >= n_strand AND n_helix >= n_loop THEN 'helix' WHEN n_strand >= n_loop THEN 'strand' ELSE 'loop' END AS dominant_ss FROM ss),
q AS (SELECT id, count(*) FILTER ({NEAR_SQL}) AS n_passing, count(*) FILTER ({NEAR_SQL}) / count(*) AS pass_rate FROM pool GROUP BY id)"""


def _ss(spark, sf):
    rows = pool(spark, sf)
    codes = rows.select("id", F.substring(F.lit("HGIEBTS"), F.col("island_index"), F.lit(1)).alias("code"))
    flagged = four_filter(rows, NEAR).groupBy("id").agg(F.sum(F.col("is_pass").cast("bigint")).alias("n_passing"), F.avg(F.col("is_pass").cast("double")).alias("pass_rate"))
    return stats.ss_composition(codes, ["id"]), flagged


@REGISTRY.add("a23_ss_composition", f"WITH {SS_SQL} SELECT id, n_residues, n_helix, n_strand, n_loop, round(frac_helix, 6) AS frac_helix, round(frac_strand, 6) AS frac_strand, round(frac_loop, 6) AS frac_loop, dominant_ss FROM f")
def ss_composition(spark, sf):
    return r6(_ss(spark, sf)[0])


@REGISTRY.add("a23_ss_by_class", f"WITH {SS_SQL} SELECT dominant_ss, count(*) AS n_epitopes, round(avg(pass_rate), 6) AS mean_pass_rate, sum(n_passing)::BIGINT AS total_passing FROM f JOIN q USING (id) GROUP BY dominant_ss")
def ss_by_class(spark, sf):
    return r6(stats.ss_vs_pass(*_ss(spark, sf), ["id"])[0])


@REGISTRY.add(
    "a23_ss_correlation",
    f"WITH {SS_SQL} " + " UNION ALL ".join(f"SELECT 'frac_{c}' AS fraction, count(*) AS n, round(corr(frac_{c}, pass_rate), 6) AS r FROM f JOIN q USING (id)" for c in ("helix", "strand", "loop")),
)
def ss_correlation(spark, sf):
    return r6(stats.ss_vs_pass(*_ss(spark, sf), ["id"])[1])


@REGISTRY.add(
    "s12_assay_columns",
    f"""WITH {READOUT_SQL} SELECT library_member, 'clik' AS ab, "Xclik_1X" AS signal, "NoAb_1" AS baseline FROM readout
UNION ALL SELECT library_member, 'errr', "Xerrr_1X", "NoAb_1" FROM readout""",
)
def assay_long(spark, sf):
    from peptarium.operators.joins import long_readout

    wide = readout(spark, sf)
    signals, baseline = assay_columns(wide)
    return long_readout(wide, "library_member", {ab: (c, baseline) for ab, c in signals.items()})


COGNATE_SQL = f"""{READOUT_SQL}, c AS (SELECT *, split_part("Target", '_', 1) AS ab, CASE split_part("Target", '_', 1) WHEN 'clik' THEN "Xclik_1X" WHEN 'errr' THEN "Xerrr_1X" END AS sig FROM readout),
e AS (SELECT library_member, CASE WHEN ab <> 'none' THEN ab END AS cognate_ab, sig, CASE WHEN ab <> 'none' THEN "NoAb_1" END AS base, library_member % 4 = 0 AS is_pass FROM c),
en AS (SELECT *, log10(1 + sig) - log10(1 + base) AS enr FROM e)"""


@REGISTRY.add(
    "j6_cognate_readout",
    f"""WITH {COGNATE_SQL} SELECT library_member, cognate_ab, sig AS cognate_ab_signal, base AS cognate_noab, round(log10(1 + sig), 6) AS cognate_log_ab,
  round(log10(1 + base), 6) AS cognate_log_noab, round(enr, 6) AS cognate_log_enrichment FROM en""",
)
def cognate(spark, sf):
    from peptarium.operators.joins import cognate_readout

    wide = readout(spark, sf)
    out = cognate_readout(wide, assay_map(wide))
    return r6(out.select("library_member", *[c for c in out.columns if c.startswith("cognate")]))


@REGISTRY.add(
    "a25_readout_summary",
    f"""WITH {COGNATE_SQL} SELECT cognate_ab, count(*) AS n, count(*) FILTER (is_pass) AS n_pass, round(quantile_cont(enr, 0.5), 6) AS med_enrich,
  round(avg((enr > 0)::INT), 6) AS frac_above FROM en WHERE cognate_ab IS NOT NULL GROUP BY cognate_ab""",
)
def readout_summary(spark, sf):
    from peptarium.operators.joins import cognate_readout

    wide = readout(spark, sf)
    rows = cognate_readout(wide, assay_map(wide)).withColumn("is_pass", F.col("library_member") % 4 == 0)
    return r6(stats.readout_summary(rows, "cognate_ab", "cognate_log_enrichment", "is_pass"))


@REGISTRY.add(
    "n19_log_readouts",
    f'WITH {READOUT_SQL} SELECT library_member, round(log10(1 + "Xclik_1X"), 6) AS log_signal, round(log10(1 + "Xclik_1X") - log10(1 + "NoAb_1"), 6) AS enrichment FROM readout',
)
def log_readouts(spark, sf):
    from peptarium.functions.numeric import log10_1p, log_enrichment

    return r6(readout(spark, sf).select("library_member", log10_1p("Xclik_1X").alias("log_signal"), log_enrichment("Xclik_1X", "NoAb_1").alias("enrichment")))


def _sub_spearman(name: str, where: str, metric: str) -> str:
    return f"""SELECT '{name}' AS subset, '{metric}' AS metric, count(*) AS n, round(corr(a, b), 6) AS r FROM (
  SELECT {avg_rank_sql('cylinder_native_aware')} AS a, {avg_rank_sql(metric)} AS b FROM pool WHERE {where} AND {metric} IS NOT NULL)"""


@REGISTRY.add(
    "a26_score_filter_corr",
    f"WITH {POOL_SQL} " + " UNION ALL ".join(_sub_spearman(n, w, m) for n, w in (("all", "true"), ("passers", NEAR_SQL)) for m in ("mean_pae", "af3_n_clash_res")),
)
def score_filter_corr(spark, sf):
    return r6(stats.score_filter_corr(four_filter(pool(spark, sf), NEAR), "cylinder_native_aware", ["mean_pae", "af3_n_clash_res"]))


@REGISTRY.add(
    "a27_ratio_report",
    f"WITH {POOL_SQL}, v AS (SELECT *, {NEAR_SQL} AS p FROM pool) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS metric, count(*) FILTER (af3_n_clash_res IS NOT NULL) AS n, round(corr({c}, af3_n_clash_res), 6) AS r, round(avg({c}) FILTER (p), 6) AS passing_mean, round(avg({c}) FILTER (NOT p), 6) AS failing_mean FROM v WHERE {c} IS NOT NULL"
        for c in ("epitope_pae", "scaffold_pae")
    ),
)
def ratio_report(spark, sf):
    return r6(stats.ratio_report(four_filter(pool(spark, sf), NEAR), ["epitope_pae", "scaffold_pae"], "af3_n_clash_res", "is_pass"))


# ---------------------------------------------------------------- sampling


@REGISTRY.add(
    "d2_quotas",
    """WITH g AS (SELECT l_suppkey, count(*) AS group_size FROM lineitem GROUP BY l_suppkey), r AS (SELECT *, row_number() OVER (ORDER BY l_suppkey) AS i, count(*) OVER () AS n FROM g)
SELECT l_suppkey, group_size, least(5017 // n + CASE WHEN i <= 5017 % n THEN 1 ELSE 0 END, group_size)::BIGINT AS quota FROM r""",
)
def even_quotas(spark, sf):
    return sampling.quotas(table(spark, sf, "lineitem"), "l_suppkey", 5017)


AXES = ["epitope_chunk_rmsd", "overall_rmsd", "epitope_pae"]


def fps_sql(rows: str, name: str, axes: list[str], picks: int) -> str:
    """CTEs ending in ``name`` (antigen, key, fps_order): greedy max-min picks per antigen, one CTE per pick."""
    usable = " AND ".join(f"{a} IS NOT NULL" for a in axes)
    pct = ", ".join(
        f"(rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0) / count(*) OVER () AS p{i}" for i, a in enumerate(axes)
    )
    dims = range(len(axes))
    gap = lambda other: " + ".join(f"(r.p{i} - {other}{i}) * (r.p{i} - {other}{i})" for i in dims)
    pick = lambda level, order: (
        f"{name}_k{level} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY antigen ORDER BY {order}, key) AS rn FROM {name}_m{level}) WHERE rn = 1)"
    )
    p_list = ", ".join(f"r.p{i}" for i in dims)
    parts = [
        f"{name}_r AS MATERIALIZED (SELECT antigen, key, {pct} FROM {rows} WHERE {usable})",
        f"{name}_c AS (SELECT antigen, {', '.join(f'avg(p{i}) AS c{i}' for i in dims)} FROM {name}_r GROUP BY antigen)",
        f"{name}_m0 AS (SELECT r.antigen, r.key, {p_list}, {gap('c.c')} AS far FROM {name}_r r JOIN {name}_c c USING (antigen))",
        pick(0, "far"),
    ]
    for n in range(1, picks):
        old = f"{gap('k.p')}" if n == 1 else f"least(r.far, {gap('k.p')})"
        parts.append(
            f"{name}_m{n} AS MATERIALIZED (SELECT r.antigen, r.key, {p_list}, {old} AS far FROM {name}_m{n - 1} r JOIN {name}_k{n - 1} k ON r.antigen = k.antigen AND r.key <> k.key)"
        )
        parts.append(pick(n, "far DESC"))
    union = " UNION ALL ".join(f"SELECT antigen, key, {n} AS fps_order FROM {name}_k{n}" for n in range(picks))
    return ", ".join([*parts, f"{name} AS ({union})"])


@REGISTRY.add(
    "d1_farthest_point_sample",
    f"WITH {POOL_SQL}, {fps_sql('pool', 'f', [*AXES, 'af3_n_clash_res'], 20)} SELECT antigen, key, fps_order FROM f",
)
def farthest_points(spark, sf):
    return sampling.sample_half(pool(spark, sf), "antigen", [*AXES, "af3_n_clash_res"], 60, "key")


@REGISTRY.add(
    "d3_titration",
    f"""WITH {POOL_SQL}, {fps_sql('pool', 'f', [*AXES, 'af3_n_clash_res'], 10)}, rest AS (SELECT * FROM pool WHERE key NOT IN (SELECT key FROM f)),
{fps_sql('rest', 'h', [*AXES, 'cylinder_native_aware'], 10)}
SELECT antigen, key, fps_order, 'af3_n_clash_res' AS access_sampled FROM f UNION ALL SELECT antigen, key, fps_order, 'cylinder_native_aware' FROM h""",
)
def titration(spark, sf):
    return sampling.titration(pool(spark, sf), "antigen", AXES, "af3_n_clash_res", "cylinder_native_aware", 60, "key")


@REGISTRY.add(
    "d4_span_sample",
    f"""WITH {POOL_SQL}, b AS (SELECT key, CAST(least(floor((mean_pae - 1.0) / (10.0 / 25)), 24) AS INT) AS bin FROM pool WHERE mean_pae >= 1.0 AND mean_pae < 11.0),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY ('0x' || substr(md5(key || '|3'), 1, 15))::BIGINT, key) AS rn FROM b)
SELECT key, bin FROM r WHERE rn <= 40""",
)
def span_sample(spark, sf):
    return sampling.span_sample(pool(spark, sf), "mean_pae", 1000, 1.0, 11.0, ["key"], seed=3).select("key", "bin")
