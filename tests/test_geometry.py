import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peptarium.operators import geometry as G
from peptarium.operators import spatial as R

KEY = ["design_id"]


def cloud(spark, points, epitope, design=1):
    rows = [(design, i, *map(float, p), i in epitope) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "design_id int, res_idx int, x double, y double, z double, is_epitope boolean")


EPITOPE = [(0, 0, 0), (3, 0, 0), (0, 3, 0), (3, 3, 0)]


def frame(spark, body=(1, 1, -30)):
    return G.plane_frame(cloud(spark, [*EPITOPE, body], {0, 1, 2, 3}), KEY)


def test_normal_points_away_from_the_body(spark):
    f = frame(spark).first()
    assert f["nz"] == pytest.approx(1.0) and f["basez"] == pytest.approx(-4.0)
    assert frame(spark, (1, 1, 30)).first()["nz"] == pytest.approx(-1.0)


def test_points_in_and_out_of_the_cylinder(spark):
    probes = cloud(spark, [(1, 1, 10), (1, 1, 50), (1, 1, -10), (21, 1, 10)], set())
    inside = G.in_cylinder(probes, frame(spark), KEY).orderBy("res_idx").collect()
    assert [r["inside"] for r in inside] == [True, False, False, False]


def test_native_count_and_carve(spark):
    scaffold = cloud(spark, [(1, 1, 8), (2, 1, 12), (0, 1, 20)], set())
    native = cloud(spark, [(1, 1, 8), (0, 0, 12), (1, 1, 5), (40, 0, 8)], {2})
    got = G.cylinder_counts(scaffold, native, frame(spark), KEY, carve_dist=1.0).first()
    assert (got["cylinder_ca_clashes"], got["cylinder_native_aware"], got["native_in_cylinder"]) == (3, 2, 2)


def random_pairs(rng, n, noise):
    p = rng.normal(size=(n, 3)) * 8
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    if np.linalg.det(q) < 0:
        q[:, 0] *= -1
    return p, p @ q.T + [5.0, -2.0, 1.0] + rng.normal(size=(n, 3)) * noise


def kabsch(p, q):
    a, b = p - p.mean(0), q - q.mean(0)
    u, _, vt = np.linalg.svd(a.T @ b)
    d = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))])
    r = vt.T @ d @ u.T
    return r, float(np.sqrt((((r @ a.T).T - b) ** 2).sum(1).mean()))


def test_rmsd_and_transform_match_numpy(spark):
    rng = np.random.default_rng(0)
    frames, want = [], {}
    for design in range(12):
        p, q = random_pairs(rng, 4 + design, 0.0 if design == 0 else 0.5 * design)
        if design == 5:
            q = q * [1, 1, -1]  # best orthogonal fit is a reflection: the proper rotation must win
        want[design] = kabsch(p, q)
        frames.append(pd.DataFrame(np.hstack([p, q]), columns=["px", "py", "pz", "qx", "qy", "qz"]).assign(design_id=design))
    pairs = spark.createDataFrame(pd.concat(frames))
    for row in G.kabsch_rmsd(pairs, KEY).collect():
        assert row["rmsd"] == pytest.approx(want[row["design_id"]][1], abs=1e-5)
    for row in G.kabsch_transform(pairs, KEY).collect():
        r = np.array([[row[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.allclose(r, want[row["design_id"]][0], atol=1e-9)


def test_transform_recovers_points(spark):
    p, q = random_pairs(np.random.default_rng(4), 8, 0.0)
    pairs = spark.createDataFrame(pd.DataFrame(np.hstack([p, q]), columns=["px", "py", "pz", "qx", "qy", "qz"]).assign(design_id=1))
    points = pairs.select("design_id", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), "qx", "qy", "qz")
    moved = G.apply_transform(points, G.kabsch_transform(pairs, KEY), KEY).toPandas()
    assert np.allclose(moved[["x", "y", "z"]], moved[["qx", "qy", "qz"]], atol=1e-9)


def test_too_few_pairs_give_no_rmsd(spark):
    pairs = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)] * 2, "design_id int, px double, py double, pz double, qx double, qy double, qz double")
    assert G.kabsch_rmsd(pairs, KEY).first()["rmsd"] is None
    assert G.kabsch_transform(pairs, KEY).count() == 0


@pytest.mark.parametrize("r", [0.7, 2.0, 5.0])
def test_distance_joins_match_brute_force(sliced, r):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(90, 3)) * 3, rng.normal(size=(70, 3)) * 3
    b[0] = a[0] + [r, 0, 0]  # a partner at the radius itself
    points, targets = cloud(sliced, a, set()), cloud(sliced, b, set())
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    near = {x["res_idx"] for x in R.within_radius(points, targets, r, KEY).collect()}
    assert near == set(np.flatnonzero((d < r).any(1)).tolist())
    left = {x["res_idx"] for x in R.carve(points, targets, r, KEY).collect()}
    assert left == set(np.flatnonzero((((a[:, None] - b[None]) ** 2).sum(-1) > r * r).all(1)).tolist())
    shortest = {x["res_idx"]: x["min_dist"] for x in R.min_distance(points, targets, r, KEY).collect()}
    inside = np.flatnonzero(d.min(1) <= r)
    assert set(inside.tolist()) <= set(shortest) | {0}
    assert all(shortest[i] == pytest.approx(d[i].min()) for i in shortest)


def near_keys(df):
    return sorted((r["design_id"], r["res_idx"]) for r in df.select("design_id", "res_idx").collect())


@pytest.mark.parametrize("dense", ["points", "targets", "both"])
@pytest.mark.parametrize("more", ["points", "targets"])
def test_dense_cells_are_cut_and_the_smaller_side_is_copied(sliced, dense, more):
    rng = np.random.default_rng(11)
    size = {"points": 150, "targets": 150} | {more: 400}
    spots = {}
    for side in ("points", "targets"):
        xyz = rng.uniform(-20, 20, (size[side], 3))
        if dense in (side, "both"):
            xyz[:120] = rng.uniform(0.1, 0.9, (120, 3))  # one cell
        spots[side] = xyz
    points, targets = cloud(sliced, spots["points"], set()), cloud(sliced, spots["targets"], set())
    copied, cut = R.layout(points, targets, 1.0, KEY)
    assert copied == {"points": "targets", "targets": "points"}[more] and cut.count() > 0
    left, right, _ = R.sides(points, targets, 1.0, KEY)
    for side in (left, right):  # 40 rows a task
        assert side.groupBy(*KEY, *R._CELL, *R._PARTS).count().agg(F.max("count")).first()[0] <= 80
    d = np.sqrt(((spots["points"][:, None] - spots["targets"][None]) ** 2).sum(-1))
    assert near_keys(R.near_points(points, targets, 1.0, KEY)) == [(1, i) for i in np.flatnonzero((d < 1).any(1)).tolist()]
    assert near_keys(R.carve(points, targets, 1.0, KEY)) == [(1, i) for i in np.flatnonzero((d > 1).all(1)).tolist()]
    got = {r["res_idx"]: r["min_dist"] for r in R.min_distance(points, targets, 1.0, KEY).collect()}
    assert got == {i: pytest.approx(d[i].min()) for i in np.flatnonzero(d.min(1) <= 1).tolist()}
    met = R.hits(points, targets.withColumnRenamed("res_idx", "t"), 1.0, KEY, ["res_idx"], ["t"]).collect()
    assert sorted((r["res_idx"], r["t"]) for r in met) == [tuple(x) for x in np.argwhere(d < 1).tolist()]


@pytest.mark.parametrize("copied", [None, "points", "targets"])
def test_repeated_points_and_null_places_keep_their_rows(spark, copied):
    rows = [(1, 0, 0.0, 0.0, 0.0)] * 3 + [(1, 1, 9.0, 9.0, 9.0), (1, 2, None, 0.0, 0.0), (None, 3, 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, "design_id int, res_idx int, x double, y double, z double")
    targets = spark.createDataFrame([(1, 0.5, 0.0, 0.0)] * 5 + [(None, 0.0, 0.0, 0.0)], "design_id int, x double, y double, z double")
    near = sorted((r["design_id"], r["res_idx"]) for r in R.near_points(points, targets, 1.0, KEY, copied).collect())
    assert near == [(1, 0)] * 3
    assert sorted(r["res_idx"] for r in R.carve(points, targets, 1.0, KEY, copied).collect()) == [1, 2, 3]


def test_natives_are_not_copied_per_design(spark):
    """The native side of the plan is read once per id, not joined to designs before it is indexed."""
    rng = np.random.default_rng(3)
    seq, n = "ACDEFGHIKLMN", 5
    table = lambda pts, **kw: pd.DataFrame(pts, columns=list("xyz")).assign(res_idx=range(len(pts)), atom_name="CA", element="C", **kw)
    atoms = [rng.normal(size=(12, 3)) * 6 for _ in range(n)]
    design = spark.createDataFrame(pd.concat([table(a, design_id=k) for k, a in enumerate(atoms)]))
    native = spark.createDataFrame(pd.concat([table(atoms[0][:6], id="t", chain="A"), table(atoms[0][8:9] + 0.5, id="t", chain="H")]))
    designs = spark.createDataFrame([(k, "t", seq, seq, [0, 1, 2, 3], [0, 1, 2, 3]) for k in range(n)], "design_id int, id string, design_seq string, predicted_seq string, design_epi array<int>, native_epi array<int>")
    pae = spark.createDataFrame([(k, np.ones((12, 12)).tolist()) for k in range(n)], "design_id int, pae array<array<double>>")
    got = {r["design_id"]: r for r in G.extract_metrics(designs, design, design, native, pae, clash_cutoff=2.0).collect()}
    for k, a in enumerate(atoms):
        r, _ = kabsch(a[:4], atoms[0][:4])
        moved = (a - a[:4].mean(0)) @ r.T + atoms[0][:4].mean(0)
        far = np.sqrt(((moved[4:] - (atoms[0][8] + 0.5)) ** 2).sum(1))
        assert got[k]["af3_n_clash_res"] == (far < 2.0).sum()


def test_distance_join_never_crosses_groups(spark):
    one, two = cloud(spark, [(0, 0, 0)], set(), 1), cloud(spark, [(0, 0, 0)], set(), 2)
    assert R.within_radius(one, two, 1.0, KEY).count() == 0
    assert R.count_within_radius(one, two, 1.0, KEY).first()["n_clash_res"] == 0


def test_cone_sweep_matches_numpy(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(80, 3)) * 8
    p = cloud(spark, pts, set(range(8)))
    f = G.plane_frame(p, KEY)
    got = G.cone_sweep(p, f, KEY, 60.0, 2, 5, 6.0, 15.0).first()
    row = f.first()
    n, c = np.array([row["nx"], row["ny"], row["nz"]]), np.array([row["cx"], row["cy"], row["cz"]])
    helper = np.array([1.0, 0, 0]) if abs(n[0]) < 0.9 else np.array([0, 1.0, 0])
    u = np.cross(n, helper)
    u /= np.linalg.norm(u)
    v = np.cross(n, u)
    counts = []
    for w in G.cone_directions(60.0, 2, 5):
        d = w[0] * n + w[1] * u + w[2] * v
        rel = pts[8:] - (c - 4.0 * d)
        proj = rel @ d
        dist = np.linalg.norm(rel - np.outer(proj, d), axis=1)
        counts.append(((proj >= 0) & (proj <= 15) & (dist <= 6)).sum())
    assert got["cone_normal_clash"] == counts[0] and got["cone_min_clash"] == min(counts)
    assert got["cone_p10_clash"] == pytest.approx(np.percentile(counts, 10))
    assert got["cone_mean_clash"] == pytest.approx(np.mean(counts))


def test_probe_panel_opposite_approach_and_own_probe(spark):
    f = frame(spark).withColumn("own", F.lit("p2"))
    design = cloud(spark, [*EPITOPE, (1, 1, -30), (1.5, 1.5, 6)], {0, 1, 2, 3})
    rows = [("p1", 0.0, 0.0, -6.0, 0.0, 0.0, -1.0), ("p2", 9.0, 9.0, 9.0, 1.0, 0.0, 0.0)]
    probes = spark.createDataFrame(rows, "probe string, x double, y double, z double, ax double, ay double, az double")
    got = G.probe_panel(design, f, probes, KEY, 4, 1.0, own="own").first()
    # p1 approaches from below; turned over, its atom lands on the design point at z = 6
    assert (got["n_probes"], got["probe_min_clash"]) == (1, 1)


def test_pae_blocks_skip_nulls(spark):
    df = spark.createDataFrame([([[1.0, 2.0, None], [3.0, 4.0, 5.0], [float("nan"), 7.0, 8.0]], [0, 1])], "pae array<array<double>>, epitope_resindices array<int>")
    got = G.pae_blocks(df).first()
    assert got["mean_pae"] == pytest.approx(30 / 7) and got["epitope_pae"] == 2.5 and got["scaffold_pae"] == 8.0


def test_local_frame_and_smoothing(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(50, 3)) * [9, 4, 1]
    p = cloud(spark, pts, set()).select("x", "y", "z")
    local = G.to_local(p, G.principal_frame(p)).toPandas().to_numpy()
    spread = local.var(0)
    assert spread[0] > spread[1] > spread[2] and np.allclose(local.mean(0), 0, atol=1e-9)
    smooth = G.smooth_density(G.voxel_density(p, 2.0), 2.0, 2.0)
    assert smooth.agg(F.sum("density")).first()[0] == pytest.approx(50.0)


def test_metric_row_clash_and_cylinder(spark):
    rng = np.random.default_rng(9)
    seq = "ACDEFGHIKLMN"
    atoms = rng.normal(size=(12, 3)) * 6
    table = lambda pts, **kw: pd.DataFrame(pts, columns=list("xyz")).assign(res_idx=range(len(pts)), atom_name="CA", element="C", **kw)
    design = spark.createDataFrame(table(atoms, design_id=1))
    native_a, ab = atoms[:6], atoms[8:9] + 0.5  # the native frame is the design's own, the antibody sits on residue 8
    native = spark.createDataFrame(pd.concat([table(native_a, id="t", chain="A"), table(ab, id="t", chain="H")]))
    designs = spark.createDataFrame([(1, "t", seq, seq, [0, 1, 2, 3], [0, 1, 2, 3])], "design_id int, id string, design_seq string, predicted_seq string, design_epi array<int>, native_epi array<int>")
    pae = spark.createDataFrame([(1, np.ones((12, 12)).tolist())], "design_id int, pae array<array<double>>")
    got = G.extract_metrics(designs, design, design, native, pae, clash_cutoff=1.0).first()
    assert got["status"] == "ok" and got["af3_clash_status"] == "ok"
    assert got["overall_rmsd"] == pytest.approx(0.0, abs=1e-5) and got["mean_pae"] == 1.0
    assert got["af3_n_clash_res"] == 1 and got["af3_has_clash"]
    # scaffold residues 4 and 5 coincide with native atoms, so carving may only remove those
    assert 0 <= got["cylinder_ca_clashes"] - got["cylinder_native_aware"] <= 2
