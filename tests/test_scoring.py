import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peptarium.operators import scoring as S
from peptarium.operators import stats
from peptarium.operators.predicates import Condition, all_of, four_filter, gate, gates, resolve_aliases
from peptarium.plans.presets import PRESETS, Metric, Preset


def scores(spark, values, **dials):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, m double")
    out = S.score(df, Preset((Metric("m", 1.0, **dials),), group=None, topk=None))
    return [r["score_m"] for r in out.orderBy("k").collect()]


def test_percentile_is_oriented(spark):
    low = scores(spark, [1.0, 2.0, 3.0, 4.0])
    assert low == pytest.approx([0.75, 0.5, 0.25, 0.0])
    assert scores(spark, [1.0, 2.0, 3.0, 4.0], better="high") == pytest.approx([0.25, 0.5, 0.75, 1.0])


def test_minmax_bounds_and_constant_column(spark):
    assert scores(spark, [0.0, 5.0, 10.0], transform="minmax", better="high") == pytest.approx([0.0, 0.5, 1.0])
    assert scores(spark, [3.0, 3.0], transform="minmax") == pytest.approx([1.0, 1.0])


def test_zscore_constant_column_is_zero(spark):
    assert scores(spark, [3.0, 3.0], transform="zscore") == pytest.approx([0.0, 0.0])


def test_sigmoid_is_monotone_and_bounded(spark):
    got = scores(spark, [float(i) for i in range(11)], transform="sigmoid", k=1.0)
    assert all(a > b for a, b in zip(got, got[1:])) and 0 < min(got) and max(got) < 1
    assert got[5] == pytest.approx(0.5)


def test_unknown_transform_is_an_error(spark):
    with pytest.raises(ValueError, match="unknown transform"):
        scores(spark, [1.0], transform="nope")


def test_registered_transform(spark):
    S.register_transform("halved", lambda x, m, s: x / s["max"], ("max",))
    assert scores(spark, [1.0, 4.0], transform="halved") == pytest.approx([0.25, 1.0])


FIXTURE = [
    ("d1", "e1", "A", 0.5, 1.0, 1.0, 2.0),
    ("d2", "e1", "A", 0.9, 2.0, 1.5, 4.0),
    ("d3", "e1", "A", 1.5, 3.0, 2.0, 6.0),
    ("d4", "e2", "B", 0.7, 1.5, 1.2, 1.0),
    ("d5", "e2", "B", 9.0, 9.0, 9.0, 9.0),
]
SCHEMA = "key string, id string, antigen string, epitope_chunk_rmsd double, epitope_pae double, overall_rmsd double, cylinder_native_aware double"


def test_gate_score_select_end_to_end(spark):
    from dataclasses import replace

    df = spark.createDataFrame(FIXTURE, SCHEMA)
    preset = replace(PRESETS["twelvemer"], gate=("epitope_chunk_rmsd", 2.5), topk=1)
    got = S.score_and_select(df, preset, ["key"]).toPandas().set_index("id")
    assert got.loc["e1", "key"] == "d1" and got.loc["e2", "key"] == "d4"
    assert len(got) == 2


def test_absent_metric_renormalises_weights(spark):
    df = spark.createDataFrame([(f"d{i}", "a", float(i), float(i)) for i in range(4)], "key string, antigen string, epitope_chunk_rmsd double, epitope_pae double")
    preset = Preset((Metric("epitope_chunk_rmsd", 0.35), Metric("epitope_pae", 0.15), Metric("gone", 0.5)), group=None, topk=None)
    assert S.score(df, preset).agg(F.max("composite")).first()[0] == pytest.approx(0.75)


def test_no_metric_present_is_an_error(spark):
    with pytest.raises(ValueError, match="no scoring metric"):
        S.score(spark.createDataFrame([(1,)], "a int"), PRESETS["antibody"])


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("c", 3.0)], "key string, m double")
    out = S.score(df, Preset((Metric("m", 1.0),), group=None, topk=None)).toPandas().set_index("key")
    assert pd.isna(out.loc["b", "score_m"]) and out.loc["b", "composite"] == 0.0 and out.loc["a", "composite"] == 0.5


def test_null_antigen_scores_null(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", None, 1.0)], "key string, antigen string, m double")
    out = S.score(df, Preset((Metric("m", 1.0, transform="minmax"), Metric("m", 1.0)), scope="per_antigen", group=None, topk=None))
    assert out.where("key = 'b'").first()["composite"] == 0.0


def test_pass_bonus_lifts_every_passer_above_the_rest(spark):
    rows = [("pass", 0.0, 0.5, 1.0, 3.0, 3.0), ("near", 1.0, 0.1, 0.1, 0.1, 0.1), ("null", None, 0.1, 0.1, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "key string, af3_n_clash_res double, epitope_chunk_rmsd double, overall_rmsd double, epitope_pae double, mean_pae double")
    out = S.score(df, PRESETS["antibody_softgate"]).toPandas().set_index("key")
    assert out.loc["pass", "composite"] > out.loc["near", "composite"]
    assert out.loc["null", "pass_indicator"] == 0.0


def test_four_filter_null_policy(spark):
    df = spark.createDataFrame([(1.0, 0.5, 1.0, 0.0), (1.0, 0.5, 1.0, None), (1.0, 0.5, 5.0, 0.0)], "overall_rmsd double, epitope_chunk_rmsd double, mean_pae double, af3_n_clash_res double")
    assert [r["is_pass"] for r in four_filter(df).collect()] == [True, False, False]


def test_gates(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "m string")
    assert gate(df, "m", 2).count() == 1
    assert gates(df, [Condition("m", ">", 0), Condition("absent", "<", 0)]).count() == 2
    with pytest.raises(ValueError):
        gate(df, "absent", 1)
    assert df.where(all_of([])).count() == 3
    assert resolve_aliases(df, {"t": (("a", "m"), 0.5), "u": (("b",), 0.5)}) == {"t": ("m", 1.0)}


def test_auc_empty_class_is_null(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True)], "s double, l boolean")
    assert stats.auc(df, "s", "l").first()["auc"] is None


def test_auc_matches_pair_counting(sliced):
    rng = np.random.default_rng(0)
    s, l = np.round(rng.normal(size=300), 1), rng.random(300) < 0.4
    df = sliced.createDataFrame(pd.DataFrame({"s": s, "l": l}))
    pos, neg = s[l], s[~l]
    want = ((pos[:, None] < neg[None]).sum() + 0.5 * (pos[:, None] == neg[None]).sum()) / (len(pos) * len(neg))
    assert stats.auc(df, "s", "l").first()["auc"] == pytest.approx(want)


def test_within_corr_matches_demeaning(spark):
    rng = np.random.default_rng(1)
    f = pd.DataFrame({"g": rng.integers(0, 5, 200), "x": rng.normal(size=200)})
    f["y"] = f["x"] * 0.3 + f["g"] * 2 + rng.normal(size=200)
    d = f - f.groupby("g").transform("mean").assign(g=0)
    got = stats.within_corr(spark.createDataFrame(f), "g", "x", "y").first()
    assert got["r"] == pytest.approx(np.corrcoef(d["x"], d["y"])[0, 1])


def test_gate_reaches_the_file_scan(spark, tmp_path):
    rows = [(1.0,), (float("nan"),), (None,), (9.0,)]
    spark.createDataFrame(rows, "m double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = gate(df, "m", 2)
    assert "LessThanOrEqual(m,2.0)" in kept._jdf.queryExecution().toString()
    assert [r["m"] for r in kept.collect()] == [1.0]
    assert [r["m"] for r in gates(df, [Condition("m", ">", 2)]).collect()] == [9.0]
