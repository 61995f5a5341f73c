"""Scoring, ranking and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from peptarium.catalog import REGISTRY
from peptarium.catalog.views import NEAR_SQL, POOL_SQL, near_pass, pool, r6
from peptarium.operators import scoring, stats
from peptarium.operators.numbering import number_members, quote_names, runs
from peptarium.operators.predicates import four_filter
from peptarium.plans.flows import cut_component
from peptarium.plans.presets import CLASH, EPITOPE_PAE, EPITOPE_RMSD, OVERALL_RMSD, PRESETS, Metric, Preset, comparison_presets

KEY = ["key"]


def pct_sql(col: str, part: str = "", better: str = "low") -> str:
    """Average-rank percentile, null for a null value."""
    over = f"PARTITION BY {part + ', ' if part else ''}({col} IS NULL)"
    scope = f"PARTITION BY {part}" if part else ""
    r = (
        f"(rank() OVER ({over} ORDER BY {col}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{col}) - 1) / 2.0)"
        f" / count({col}) OVER ({scope})"
    )
    return f"CASE WHEN {col} IS NOT NULL THEN {'1.0 - ' if better == 'low' else ''}{r} END"


def sig_sql(col: str, mid: float, k: float, sign: float = 1.0) -> str:
    return f"1.0 / (1.0 + exp({sign * k} * ({col} - {mid})))"


def bonus_sql() -> str:
    parts = [
        f"coalesce(1.0 / (1.0 + exp(CASE WHEN {c} IS NOT NULL THEN greatest(-700.0, least(700.0, 12.0 * ({c} - {t}))) END)), 0.0)"
        for c, t in (("epitope_chunk_rmsd", 1.0), ("overall_rmsd", 2.0), ("mean_pae", 5.0), ("af3_n_clash_res", 0.5))
    ]
    return " * ".join(parts)


SOFT = {CLASH: (0.45, 6.0, 0.5), EPITOPE_RMSD: (0.25, 1.0, 4.0), OVERALL_RMSD: (0.20, 2.0, 4.0), EPITOPE_PAE: (0.10, 2.5, 1.2)}
SOFT_SQL = " + ".join(f"{w} * coalesce({sig_sql(c, m, k)}, 0.0)" for c, (w, m, k) in SOFT.items())
SOFT_BONUS_SQL = f"{SOFT_SQL} + 2.0 * ({bonus_sql()})"
RANKED = {CLASH: 0.35, EPITOPE_RMSD: 0.35, OVERALL_RMSD: 0.15, EPITOPE_PAE: 0.15}


def ranked_sql(part: str = "", weights=RANKED) -> str:
    return " + ".join(f"{w} * coalesce({pct_sql(c, part)}, 0.0)" for c, w in weights.items())


def one_metric(transform: str, better: str = "low", scope: str = "pooled", **dials) -> Preset:
    return Preset((Metric("epitope_pae", 1.0, better, transform, **dials),), scope=scope, group=None, topk=None)


def transformed(preset: Preset):
    return lambda spark, sf: r6(scoring.score(pool(spark, sf), preset).select("key", "score_epitope_pae", "composite"))


def transformed_sql(expr: str) -> str:
    return f"""WITH {POOL_SQL}, s AS (SELECT key, {expr} AS v FROM pool)
SELECT key, round(v, 6) AS score_epitope_pae, round(coalesce(v, 0.0), 6) AS composite FROM s"""


X = "epitope_pae"
REGISTRY.add("w1_percentile_pooled", transformed_sql(pct_sql(X)))(transformed(one_metric("percentile")))
REGISTRY.add("w1_percentile_high", transformed_sql(pct_sql(X, better="high")))(transformed(one_metric("percentile", "high")))
REGISTRY.add("w6_percentile_per_antigen", transformed_sql(pct_sql(X, "antigen")))(transformed(one_metric("percentile", scope="per_antigen")))
REGISTRY.add(
    "w2_minmax", transformed_sql(f"1.0 - ({X} - min({X}) OVER ()) / (max({X}) OVER () - min({X}) OVER ())")
)(transformed(one_metric("minmax")))
REGISTRY.add(
    "w3_zscore_per_antigen", transformed_sql(f"-({X} - avg({X}) OVER (PARTITION BY antigen)) / stddev_pop({X}) OVER (PARTITION BY antigen)")
)(transformed(one_metric("zscore", scope="per_antigen")))
REGISTRY.add(
    "w4_sigmoid_median", transformed_sql(f"1.0 / (1.0 + exp(1.5 * ({X} - quantile_cont({X}, 0.5) OVER (PARTITION BY antigen))))")
)(transformed(one_metric("sigmoid", scope="per_antigen", k=1.5)))
REGISTRY.add("w4_sigmoid_fixed", transformed_sql(sig_sql(X, 2.5, 1.2, -1.0)))(transformed(one_metric("sigmoid", "high", midpoint=2.5, k=1.2)))
REGISTRY.add("w5_identity", transformed_sql(f"-{X}"))(transformed(one_metric("identity")))


@REGISTRY.add("w7_composite_pooled", f"WITH {POOL_SQL} SELECT key, round({ranked_sql()}, 8) AS composite FROM pool")
def composite_pooled(spark, sf):
    return r6(scoring.score(pool(spark, sf), PRESETS["antibody"]).select("key", "composite"), 8)


@REGISTRY.add(
    "w7_composite_missing_metric",
    f"WITH {POOL_SQL} SELECT key, round({' + '.join(f'{w / 0.85} * coalesce({pct_sql(c)}, 0.0)' for c, w in RANKED.items() if c != OVERALL_RMSD)}, 8) AS composite FROM pool",
)
def composite_missing_metric(spark, sf):
    return r6(scoring.score(pool(spark, sf).drop(OVERALL_RMSD), PRESETS["antibody"]).select("key", "composite"), 8)


@REGISTRY.add(
    "w8_pass_bonus",
    f"WITH {POOL_SQL} SELECT key, round({bonus_sql()}, 6) AS pass_indicator, round({SOFT_BONUS_SQL}, 6) AS composite FROM pool",
)
def pass_bonus(spark, sf):
    return r6(scoring.score(pool(spark, sf), PRESETS["antibody_softgate"]).select("key", "pass_indicator", "composite"))


W12 = {"cylinder_native_aware": 0.35, EPITOPE_RMSD: 0.35, OVERALL_RMSD: 0.15, EPITOPE_PAE: 0.15}


def topk_sql(composite: str, k: int, group: str = "id", where: str = "true") -> str:
    return f"""WITH {POOL_SQL}, s AS (SELECT key, id, antigen, {composite} AS composite FROM pool WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY composite DESC, key) AS rn FROM s)
SELECT key, id, round(composite, 8) AS composite FROM r WHERE rn <= {k}"""


for preset_name, expression in (
    ("twelvemer", ranked_sql("antigen", W12)),
    ("antibody", ranked_sql()),
    ("antibody_softgate", SOFT_BONUS_SQL),
):

    def preset_select(spark, sf, name=preset_name):
        picked = scoring.score_and_select(pool(spark, sf), PRESETS[name], KEY)
        return r6(picked.select("key", "id", "composite"), 8)

    REGISTRY.add(f"w9_preset_{preset_name}", topk_sql(expression, 5))(preset_select)

def soft_sql(dials) -> str:
    return " + ".join(f"{w} * coalesce({sig_sql(c, m, k)}, 0.0)" for c, (w, m, k) in dials.items())


STEEP_SQL = soft_sql({CLASH: (0.45, 6.0, 0.5), EPITOPE_RMSD: (0.25, 1.0, 4.0), OVERALL_RMSD: (0.20, 2.0, 4.0), EPITOPE_PAE: (0.10, 5.0, 1.2)})
WORLD_SQL = {
    "percentile": ranked_sql(),
    "sigmoid_035": soft_sql({CLASH: (0.35, 6.0, 0.5), EPITOPE_RMSD: (0.35, 1.0, 4.0), OVERALL_RMSD: (0.15, 2.0, 2.0), EPITOPE_PAE: (0.15, 5.0, 1.0)}),
    "sigmoid_050": soft_sql({CLASH: (0.50, 6.0, 0.5), EPITOPE_RMSD: (0.25, 1.0, 4.0), OVERALL_RMSD: (0.15, 2.0, 2.0), EPITOPE_PAE: (0.10, 5.0, 1.0)}),
    "softgate": STEEP_SQL,
    "softgate_bonus": f"{STEEP_SQL} + 2.0 * ({bonus_sql()})",
    "sigmoid_percentile_clash": f"0.35 * coalesce({pct_sql(CLASH)}, 0.0) + "
    + " + ".join(
        f"{w} * coalesce({sig_sql(c, m, k)}, 0.0)"
        for c, (w, m, k) in {EPITOPE_RMSD: (0.35, 1.0, 4.0), OVERALL_RMSD: (0.15, 2.0, 2.0), EPITOPE_PAE: (0.15, 5.0, 1.0)}.items()
    ),
    "hard_floor": f"0.6 * coalesce({sig_sql(CLASH, 6.0, 0.5)}, 0.0) + 0.4 * coalesce({sig_sql(EPITOPE_RMSD, 1.0, 4.0)}, 0.0)",
}


def floor_of(world: str) -> str:
    return "overall_rmsd <= 3.0 AND epitope_pae < 8.0" if world == "hard_floor" else "true"


def world_sql(world: str) -> str:
    """The selection of one preset, as a subquery of pool."""
    return f"""SELECT '{world}' AS world, * EXCLUDE (c, rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, key) AS rn
  FROM (SELECT *, {WORLD_SQL[world]} AS c FROM pool WHERE {floor_of(world)})) WHERE rn <= 10"""


for world in WORLD_SQL:

    def world_select(spark, sf, name=world):
        return r6(scoring.score_and_select(pool(spark, sf), comparison_presets()[name], KEY).select("key", "id", "composite"), 8)

    REGISTRY.add(f"w10_world_{world}", topk_sql(WORLD_SQL[world], 10, where=floor_of(world)))(world_select)


@REGISTRY.add("w11_topk_per_group", topk_sql(SOFT_BONUS_SQL, 5, "antigen"))
def topk_per_group(spark, sf):
    scored = scoring.score(pool(spark, sf), PRESETS["antibody_softgate"])
    return r6(scoring.top_k(scored, ["antigen"], scoring.best_first(KEY), 5).select("key", "id", "composite"), 8)


@REGISTRY.add(
    "w11_topk_global",
    f"WITH {POOL_SQL}, s AS (SELECT key, {SOFT_BONUS_SQL} AS composite FROM pool) SELECT key, round(composite, 8) AS composite FROM s ORDER BY s.composite DESC, key LIMIT 5",
)
def topk_global(spark, sf):
    rows = pool(spark, sf).drop("id")
    return r6(scoring.score_and_select(rows, PRESETS["antibody_softgate"], KEY).select("key", "composite"), 8)


@REGISTRY.add(
    "w12_rank_in_group",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, island_index, {SOFT_BONUS_SQL} AS composite FROM pool)
SELECT key, id, island_index, row_number() OVER (PARTITION BY id, island_index ORDER BY composite DESC, key) AS rank_in_group FROM s""",
)
def rank_in_group(spark, sf):
    scored = scoring.score(pool(spark, sf), PRESETS["antibody_softgate"].without_select())
    return scoring.rank_in_group(scored, ["id", "island_index"], KEY).select("key", "id", "island_index", "rank_in_group")


@REGISTRY.add(
    "w13_dedup_topk",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, split_part(key, '-', 1) AS token, {SOFT_BONUS_SQL} AS composite FROM pool),
d AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY composite DESC, key) AS a FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY composite DESC, key) AS rank_in_group FROM d WHERE a = 1)
SELECT key, id, CAST(rank_in_group AS INTEGER) AS rank_in_group FROM r WHERE rank_in_group <= 10""",
)
def dedup_topk(spark, sf):
    scored = scoring.score(pool(spark, sf), PRESETS["antibody_softgate"]).withColumn("token", F.element_at(F.split("key", "-"), 1))
    return scoring.select_dedup_topk(scored, "token", "id", KEY, 10).select("key", "id", "rank_in_group")


@REGISTRY.add(
    "w14_recut",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, {SOFT_BONUS_SQL} AS composite FROM pool),
r AS (SELECT key, id, row_number() OVER (PARTITION BY id ORDER BY composite DESC, key) AS rank_in_group FROM s)
SELECT * FROM r WHERE rank_in_group <= 3""",
)
def recut(spark, sf):
    scored = scoring.score(pool(spark, sf), PRESETS["antibody_softgate"])
    return scoring.recut(scoring.rank_in_group(scored, ["id"], KEY), 3).select("key", "id", "rank_in_group")


@REGISTRY.add(
    "w15_swap_term",
    f"""WITH {POOL_SQL}, s AS (SELECT *, {ranked_sql()} AS composite, 0.35 * ({pct_sql("cylinder_ca_clashes")}) AS old FROM pool)
SELECT key, round(composite - old + 0.35 * ({pct_sql("cylinder_native_aware")}), 8) AS composite_swapped FROM s""",
)
def swap_term(spark, sf):
    rows = pool(spark, sf)
    # the old term comes first: its few values are looked up without a shuffle, the score's price ranks are not
    stored = scoring.transform_metrics(rows, [Metric("cylinder_ca_clashes", 0.35)], [])
    stored = stored.withColumn("old_term", F.lit(0.35) * F.col("score_cylinder_ca_clashes"))
    scored = scoring.score(stored, PRESETS["antibody"])
    return r6(scoring.swap_term(scored, "old_term", "cylinder_native_aware", 0.35, population=rows).select("key", "composite_swapped"), 8)


@REGISTRY.add(
    "w15_calibrate_ties",
    f"""WITH {POOL_SQL}, s AS (SELECT l.*, 0.35 * (1.0 - rank() OVER (ORDER BY cylinder_ca_clashes) / CAST(count(*) OVER () AS DOUBLE)) AS stored FROM pool l),
p AS (SELECT stored / 0.35 AS target, count(*) OVER () AS n, rank() OVER (ORDER BY cylinder_ca_clashes) AS lo,
  count(*) OVER (PARTITION BY cylinder_ca_clashes) AS ties, dense_rank() OVER (ORDER BY cylinder_ca_clashes) AS dr,
  (SELECT count(DISTINCT cylinder_ca_clashes) FROM pool) AS nd FROM s)
SELECT method, round(max(abs(1.0 - r - target)), 6) AS max_error FROM (
  SELECT target, unnest(['average', 'min', 'max', 'dense']) AS method,
    unnest([(lo + (ties - 1) / 2.0) / n, lo / CAST(n AS DOUBLE), (lo + ties - 1) / CAST(n AS DOUBLE), dr / CAST(nd AS DOUBLE)]) AS r FROM p) GROUP BY method""",
)
def calibrate_ties(spark, sf):
    from peptarium.operators.ordering import with_rank

    rows = with_rank(pool(spark, sf), "cylinder_ca_clashes", out="_p", method="min", pct=True)
    rows = rows.withColumn("stored", F.lit(0.35) * (F.lit(1.0) - F.col("_p")))
    return r6(scoring.calibrate_ties(rows, "cylinder_ca_clashes", "stored", 0.35))


@REGISTRY.add(
    "w16_compare_presets",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, af3_n_clash_res AS v, {ranked_sql()} AS ca, {SOFT_BONUS_SQL} AS cb FROM pool),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ca DESC, key) AS ra, row_number() OVER (PARTITION BY id ORDER BY cb DESC, key) AS rb FROM s)
SELECT id, min(v) FILTER (ra <= 5) AS a_min, round(quantile_cont(v, 0.5) FILTER (ra <= 5), 6) AS a_median, max(v) FILTER (ra <= 5) AS a_max,
  min(v) FILTER (rb <= 5) AS b_min, round(quantile_cont(v, 0.5) FILTER (rb <= 5), 6) AS b_median, max(v) FILTER (rb <= 5) AS b_max,
  count(*) FILTER (ra <= 5) AS n_a, count(*) FILTER (rb <= 5) AS n_b, count(*) FILTER (rb <= 5 AND ra > 5) AS n_new FROM r GROUP BY id""",
)
def compare_presets(spark, sf):
    return r6(scoring.compare_presets(pool(spark, sf), PRESETS["antibody"], PRESETS["antibody_softgate"], KEY, CLASH))


@REGISTRY.add(
    "w17_number_members",
    "SELECT o_orderkey, 'LIB_' || row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS library_member FROM orders",
)
def number(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return number_members(o, ["o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "library_member")


@REGISTRY.add(
    "w18_quote_names",
    "SELECT o_orderkey, 'LIB_' || CASE WHEN length(o_orderkey::VARCHAR) >= 7 THEN o_orderkey::VARCHAR ELSE lpad(o_orderkey::VARCHAR, 7, '0') END AS name FROM orders",
)
def quote(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey")
    named = o.withColumn("library_member", F.concat(F.lit("LIB_"), F.col("o_orderkey").cast("string")))
    return quote_names(named, 7).select("o_orderkey", "name")


@REGISTRY.add(
    "w19_runs",
    """WITH d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
g AS (SELECT *, l_partkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS run FROM d)
SELECT l_suppkey, min(l_partkey) AS run_start, max(l_partkey) AS run_end, count(*) AS run_size FROM g GROUP BY l_suppkey, run""",
)
def neighbour_runs(spark, sf):
    return runs(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_suppkey"], "l_partkey")


@REGISTRY.add(
    "f1_score_and_rank",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, {SOFT_BONUS_SQL} AS composite FROM pool WHERE NOT (id::VARCHAR LIKE '7%')),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY composite DESC, key) AS rank_in_group FROM s)
SELECT key, id, round(composite, 8) AS composite, rank_in_group FROM r WHERE rank_in_group <= 5""",
)
def score_and_rank(spark, sf):
    cut = cut_component(pool(spark, sf), PRESETS["antibody_softgate"], ["id"], KEY, 5, exclude=["7"])
    return r6(cut.select("key", "id", "composite", "rank_in_group"), 8)


@REGISTRY.add(
    "a20_world_table",
    f"""WITH {POOL_SQL}, w AS ({' UNION ALL '.join(world_sql(w) for w in WORLD_SQL)}),
z AS (SELECT *, unnest([id::VARCHAR, '*']) AS scope FROM w)
SELECT world, scope, count(*) AS n, round(quantile_cont(af3_n_clash_res, 0.5), 7) AS median_af3_n_clash_res,
  round(quantile_cont(epitope_chunk_rmsd, 0.5), 7) AS median_epitope_chunk_rmsd, round(quantile_cont(overall_rmsd, 0.5), 7) AS median_overall_rmsd,
  round(quantile_cont(epitope_pae, 0.5), 7) AS median_epitope_pae FROM z GROUP BY world, scope""",
)
def world_table(spark, sf):
    return r6(stats.world_table(pool(spark, sf), comparison_presets(), KEY), 7)


@REGISTRY.add(
    "a15_validate_shortlist",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, {NEAR_SQL} AS p, {SOFT_SQL} AS composite FROM pool),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY composite DESC, key) <= 5 AS picked FROM s),
g AS (SELECT id, count(*) FILTER (p) AS nt, count(*) FILTER (p AND picked) AS kept, count(*) FILTER (picked) AS ns FROM r GROUP BY id)
SELECT sum(nt)::BIGINT AS n_truepass, sum(ns)::BIGINT AS n_selected, sum(kept)::BIGINT AS tp, round(sum(kept) / sum(nt), 6) AS recall,
  round(sum(least(nt, 5)) / sum(nt), 6) AS ceiling, round(avg(CASE WHEN nt > 0 THEN kept / least(nt, 5) END), 6) AS per_group_recall,
  round(sum(kept) / sum(ns), 6) AS "precision", round(count(*) FILTER (kept > 0) / count(*) FILTER (nt > 0), 6) AS coverage,
  count(*) FILTER (kept > 0) AS n_groups_kept, count(*) FILTER (nt > 0) AS n_groups FROM g""",
)
def validate_shortlist(spark, sf):
    preset = Preset(PRESETS["antibody_softgate"].metrics, group="id", topk=5)
    full = four_filter(scoring.score(pool(spark, sf), preset), near_pass())
    return r6(stats.validate_shortlist(full, scoring.select_topk(full, preset, KEY), "id", KEY, 5))


@REGISTRY.add(
    "a16_capture_curve",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, {NEAR_SQL} AS p, {SOFT_SQL} AS composite FROM pool),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY composite DESC, key) AS rn FROM s),
g AS (SELECT id, k, count(*) AS n, count(*) FILTER (rn <= k) AS kept FROM r, (SELECT unnest([1, 5, 10, 20, 50]) AS k) WHERE p GROUP BY id, k)
SELECT k, count(*) AS n_groups, round(avg(CASE WHEN kept > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(kept / least(n, k)), 6) AS recall FROM g GROUP BY k""",
)
def capture_curve(spark, sf):
    preset = Preset(PRESETS["antibody_softgate"].metrics)
    full = four_filter(scoring.score(pool(spark, sf), preset), near_pass())
    return r6(stats.capture_curve(full, "id", [1, 5, 10, 20, 50], KEY))


@REGISTRY.add(
    "a16_global_capture",
    f"""WITH {POOL_SQL}, s AS (SELECT {NEAR_SQL} AS p, round({SOFT_SQL}, 9) AS composite FROM pool),
r AS (SELECT p, (rank() OVER (ORDER BY composite) + (count(*) OVER (PARTITION BY composite) - 1) / 2.0) / count(*) OVER () AS o FROM s)
SELECT frac, count(*) FILTER (p) AS n_pass, count(*) FILTER (p AND o >= 1.0 - frac) AS captured,
  round(count(*) FILTER (p AND o >= 1.0 - frac) / count(*) FILTER (p), 6) AS share
FROM r, (SELECT unnest([0.01::DOUBLE, 0.02, 0.05, 0.1, 0.2]) AS frac) GROUP BY frac""",
)
def global_capture(spark, sf):
    preset = Preset(PRESETS["antibody_softgate"].metrics)
    full = four_filter(scoring.score(pool(spark, sf), preset), near_pass()).withColumn("composite", F.round("composite", 9))
    return r6(stats.global_capture(full, [0.01, 0.02, 0.05, 0.1, 0.2]))
