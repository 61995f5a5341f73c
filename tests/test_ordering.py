"""Ranks, prefix sums and quantiles: the sliced path must equal pandas, hot groups and heavy ties included."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peptarium.operators import ordering as O
from peptarium.operators import stats as S


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 700
    group = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.normal(size=n) * 10, 1))
    return pd.DataFrame({"k": np.arange(n), "g": group, "v": value})


@pytest.fixture(params=["one_task", "sliced"])
def session(request, spark):
    return request.getfixturevalue("sliced") if request.param == "sliced" else spark


@pytest.mark.parametrize("method", ["average", "min", "max", "dense"])
def test_rank_methods_match_pandas(session, rows, method):
    got = O.with_rank(session.createDataFrame(rows), "v", ["g"], "r", method, pct=True).toPandas().sort_values("k")
    want = rows.groupby("g")["v"].rank(method=method, pct=True)
    assert np.allclose(got["r"].to_numpy(), want.to_numpy())


def test_pooled_rank_and_null(session, rows):
    frame = rows.copy()
    frame.loc[::9, "v"] = None
    df = session.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = O.with_rank(df, "v", out="r", pct=True).toPandas().sort_values("k")
    want = frame["v"].rank(pct=True)
    assert np.allclose(got["r"].to_numpy(float), want.to_numpy(), equal_nan=True)


def test_row_rank_is_contiguous_in_hot_group(session, rows):
    got = O.row_rank(session.createDataFrame(rows), ["g"], [F.col("v").desc(), F.col("k")]).toPandas()
    want = rows.sort_values(["v", "k"], ascending=[False, True])
    want["want"] = want.groupby("g").cumcount() + 1
    both = got.merge(want[["k", "want"]], on="k")
    assert (both["rank_in_group"] == both["want"]).all()


def test_running_total_over_whole_table(session, rows):
    got = O.running_total(session.createDataFrame(rows), [], [F.col("v"), F.col("k")]).toPandas().sort_values(["v", "k"])
    assert got["before"].tolist() == list(range(len(rows)))


def test_quantiles_match_numpy(session, rows):
    got = O.quantiles(session.createDataFrame(rows), ["g"], "v", {"p10": 0.1, "mid": 0.5, "p995": 0.995}).toPandas().set_index("g")
    for g, part in rows.groupby("g"):
        assert np.allclose(got.loc[g, ["p10", "mid", "p995"]].to_numpy(float), np.quantile(part["v"], [0.1, 0.5, 0.995]))


def test_quantiles_of_whole_table(session, rows):
    got = O.quantiles(session.createDataFrame(rows), [], "v", {"mid": 0.5}).first()
    assert got["mid"] == pytest.approx(rows["v"].median())


def test_lookup_splits_hot_keys_without_loss(session, rows):
    df = session.createDataFrame(rows)
    names = session.createDataFrame([("hot", 1), ("a", 2), ("b", 3)], "g string, id int")
    got = O.lookup(df, names, ["g"])
    assert got.count() == len(rows)
    assert got.where("id = 1").count() == (rows["g"] == "hot").sum()
    assert O.lookup(df, names, ["g"], "inner").count() == (rows["g"] != "c").sum()


def test_top_k_beyond_the_pushdown_ceiling(spark, rows):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "3")
    try:
        got = O.top_k(spark.createDataFrame(rows), ["g"], [F.col("v"), F.col("k")], 5)
        assert got.groupBy("g").count().toPandas()["count"].tolist() == [5] * rows["g"].nunique()
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_top_k_limits_before_the_shuffle(spark, rows):
    plan = O.top_k(spark.createDataFrame(rows), ["g"], [F.col("v"), F.col("k")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.fixture
def holed(rows):
    frame = rows.copy().astype({"g": object})
    frame.loc[::3, "g"] = None
    return frame


def with_nulls(session, frame):
    return session.createDataFrame([tuple(r) for r in frame.itertuples(index=False)], "k bigint, g string, v double")


def test_null_groups_keep_their_quantiles_and_sizes(session, holed):
    df = with_nulls(session, holed)
    got = {r["g"]: r["mid"] for r in O.quantiles(df, ["g"], "v", {"mid": 0.5}).collect()}
    want = {None if pd.isna(g) else g: part["v"].median() for g, part in holed.groupby("g", dropna=False)}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    ladder = O.value_ladder(df, ["g"], "v").groupBy("g").agg(F.max("n").alias("n"), F.sum("n_ties").alias("t")).collect()
    assert all(r["n"] == r["t"] for r in ladder) and len(ladder) == len(want)


def test_null_groups_in_statistics(session, holed):
    df = with_nulls(session, holed).withColumn("label", F.col("k") % 3 == 1)
    for table in (S.auc(df, "v", "label", ["g"]), S.sweep_report(df, ["g"], "v", "label")):
        found = {r["g"]: r for r in table.collect()}
        assert None in found and len(found) == holed["g"].nunique() + 1
    mids = {r["g"]: r["med_free"] for r in S.sweep_report(df, ["g"], "v", "label").collect()}
    part = holed[holed["g"].isna() & (holed["k"] % 3 == 1)]
    assert (mids[None] is None) == part.empty and (part.empty or mids[None] == pytest.approx(part["v"].median()))


def test_lookup_deals_null_keys_and_takes_maps(session, holed):
    df = with_nulls(session, holed).withColumn("m", F.create_map("k", "v"))
    names = session.createDataFrame([("hot", 1), ("a", 2), (None, 9)], "g string, id int")
    got = O.lookup(df, names, ["g"])
    assert got.count() == len(holed) and got.where("g is null and id is not null").count() == 0
    safe = O.lookup(df, names, ["g"], null_safe=True)
    assert safe.where("g is null and id = 9").count() == holed["g"].isna().sum() and safe.count() == len(holed)


@pytest.mark.parametrize("steps", [100_000, 30, 0])
@pytest.mark.parametrize("groups", [[], ["g"]])
def test_ranks_of_several_metrics_match_pandas(session, rows, groups, steps, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_STEPS", steps)
    frame = rows.assign(w=rows["k"] % 5, u=-rows["v"], extra="x")
    frame.loc[::7, "v"] = None
    df = session.createDataFrame(frame).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = O.with_ranks(df, {"v": "rv", "w": "rw", "u": "ru"}, groups, pct=True)
    assert got.columns.count("k") == 1 and set(got.columns) == {*frame.columns, "rv", "rw", "ru"}
    got = got.toPandas().sort_values("k")
    for c in "vwu":
        want = frame.groupby(groups)[c].rank(pct=True) if groups else frame[c].rank(pct=True)
        assert np.allclose(got[f"r{c}"].to_numpy(float), want.to_numpy(), equal_nan=True)


@pytest.mark.parametrize(("kind", "metrics"), [("double", "u"), ("double", "vuw"), ("float", "v"), ("bigint", "v")])
def test_ranks_dealt_by_cell_equal_ranks_by_value(session, kind, metrics):
    rng = np.random.default_rng(11)
    n = 900
    v = np.where(rng.random(n) < 0.3, 5_000.0, 4_000 + np.round(rng.random(n) * 40, 1))  # many values a cell, and a frequent one
    u = np.concatenate([-np.round(rng.lognormal(9, 0.02, 300), 1), np.zeros(100), rng.lognormal(9, 0.02, 500)])
    frame = [(i, None if i % 11 == 0 else "ab"[i % 2], None if i % 7 == 0 else float(x), float(y), float(i % 6)) for i, (x, y) in enumerate(zip(v, u))]
    odd = [(n + i, "a", x, x, x) for i, x in enumerate([-0.0, 0.0, 1e-300, -1e-300])]
    if kind != "bigint":
        odd += [(n + 10 + i, "a", x, x, x) for i, x in enumerate([float("nan"), float("nan"), float("inf"), float("-inf"), 1e30, -1e30])]
    df = session.createDataFrame(frame + odd, "k bigint, g string, v double, u double, w double").withColumn("note", F.create_map("k", "g"))
    df = df.withColumns({c: F.col(c).cast(kind) for c in "vuw"}).localCheckpoint()
    names = {m: f"r{m}" for m in metrics}
    for groups, pct in (([], False), (["g"], True)):
        got, want = (sorted(map(tuple, O.with_ranks(df, names, groups, pct, many_groups=many).select("k", *names.values()).collect())) for many in (False, True))
        assert got == want and len(got) == len(frame + odd)


def test_wide_rows_move_once_for_any_number_of_metrics(sliced, rows, monkeypatch):
    monkeypatch.setattr(O, "BROADCAST_STEPS", 0)
    df = sliced.createDataFrame(rows.assign(a=rows["v"] * 2, b=rows["v"] * 3, note="wide"))
    for metrics in ({"v": "rv", "a": "ra"}, {"v": "rv", "a": "ra", "b": "rb"}):
        plan = O.with_ranks(df, metrics, ["g"])._jdf.queryExecution().optimizedPlan().toString()
        # the wide rows meet all their ranks by row, once; the other joins are of narrow rows
        assert plan.count("Join LeftOuter, (_row#") == 1 and plan.splitlines()[1].startswith("+- Join LeftOuter, (_row#")
        assert not any("note#" in line and "Join" in line for line in plan.splitlines())


@pytest.mark.parametrize("scale", [1e-300, 1.0, 1e300])
def test_quantiles_over_all_magnitudes(session, scale):
    rng = np.random.default_rng(8)
    v = np.concatenate([rng.normal(size=150), np.zeros(20), np.full(30, 0.25), rng.lognormal(0, 5, 60)]) * scale
    frame = pd.DataFrame({"v": v, "g": np.arange(len(v)) % 2})
    df = session.createDataFrame(frame)
    probs = {"q0": 0.0, "q3": 0.037, "q5": 0.5, "q9": 0.995, "q1": 1.0}
    for g, row in {r["g"]: r for r in O.quantiles(df, ["g"], "v", probs).collect()}.items():
        want = np.quantile(frame[frame.g == g]["v"], list(probs.values()))
        assert np.allclose([row[n] for n in probs], want, rtol=1e-9, atol=0)


def test_input_is_read_once_for_quantiles(spark, rows):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows).mapInArrow(count, "k bigint, g string, v double")
    O.quantiles(df, ["g"], "v", {"m": 0.5}).collect()
    assert seen.value == len(rows)
