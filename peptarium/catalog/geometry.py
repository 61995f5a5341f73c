"""Geometry and distance-join queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from peptarium.catalog import REGISTRY
from peptarium.catalog.views import CONTIGS_SQL, MIRROR_SQL, POINTS_SQL, contigs, mirrored, points, r6, table
from peptarium.operators import geometry as G
from peptarium.operators import spatial as R
from peptarium.operators.numbering import runs

KEY = ["design_id"]
BOTH = f"{POINTS_SQL}, {MIRROR_SQL}"


# ---------------------------------------------------------------- shared SQL: 3x3 algebra


def eig_sql(source: str, out: str, xx="xx", yy="yy", zz="zz", xy="xy", xz="xz", yz="yz") -> str:
    """CTE ``out``: columns of ``source`` plus eigenvalues l1 >= l2 >= l3 of a symmetric 3x3 matrix."""
    return f"""{out}_m AS (SELECT *, ({xx} + {yy} + {zz}) / 3.0 AS em FROM {source}),
{out}_a AS (SELECT *, {xx} - em AS ea, {yy} - em AS eb, {zz} - em AS ec FROM {out}_m),
{out}_p AS (SELECT *, sqrt((ea*ea + eb*eb + ec*ec + 2.0 * ({xy}*{xy} + {xz}*{xz} + {yz}*{yz})) / 6.0) AS ep,
  ea * (eb*ec - {yz}*{yz}) - {xy} * ({xy}*ec - {yz}*{xz}) + {xz} * ({xy}*{yz} - eb*{xz}) AS ed FROM {out}_a),
{out}_t AS (SELECT *, acos(greatest(-1.0, least(1.0, CASE WHEN ep > 0 THEN ed / (2.0*ep*ep*ep) ELSE 0.0 END))) / 3.0 AS et FROM {out}_p),
{out}_l AS (SELECT *, em + 2.0*ep*cos(et) AS l1, em + 2.0*ep*cos(et + {2 * math.pi / 3}) AS l3 FROM {out}_t),
{out} AS (SELECT *, 3.0*em - l1 - l3 AS l2 FROM {out}_l)"""


def rmsd_sql(pairs: str, out: str) -> str:
    """CTE ``out`` (design_id, n, rmsd) from a CTE of paired points (design_id, px..pz, qx..qz)."""
    h = ", ".join(f"n * covar_pop({p}, {q}) AS h{i}{j}" for i, p in enumerate(("px", "py", "pz")) for j, q in enumerate(("qx", "qy", "qz")))
    h = h.replace("n *", "count(*) *")
    e0 = " + ".join(f"var_pop({c})" for c in ("px", "py", "pz", "qx", "qy", "qz"))
    g = ", ".join(f"h0{a}*h0{b} + h1{a}*h1{b} + h2{a}*h2{b} AS {n}" for n, a, b in (("xx", 0, 0), ("yy", 1, 1), ("zz", 2, 2), ("xy", 0, 1), ("xz", 0, 2), ("yz", 1, 2)))
    return f"""{out}_s AS (SELECT design_id, count(*) AS n, count(*) * ({e0}) AS e0, {h} FROM {pairs} GROUP BY design_id),
{out}_g AS (SELECT design_id, n, e0, h00*(h11*h22 - h12*h21) - h01*(h10*h22 - h12*h20) + h02*(h10*h21 - h11*h20) AS dt, {g} FROM {out}_s),
{eig_sql(out + '_g', out + '_e')},
{out} AS (SELECT design_id, n, CASE WHEN n >= 3 THEN sqrt(greatest(0.0, (e0 - 2.0*(sqrt(greatest(l1, 0.0)) + sqrt(greatest(l2, 0.0)) + sign(dt)*sqrt(greatest(l3, 0.0)))) / n)) END AS rmsd FROM {out}_e)"""


def frame_sql(source: str, out: str, offset: float = G.OFFSET, surface: bool = False) -> str:
    """CTE ``out``: plane frame per design by cross products of (C - l3 I), independent of any solver."""
    reach = (
        f"(SELECT max((p.x - f.cx)*f.nx + (p.y - f.cy)*f.ny + (p.z - f.cz)*f.nz) FROM {source} p WHERE p.design_id = f.design_id AND p.is_epitope)" if surface else "0.0"
    )
    return f"""{out}_c AS (SELECT design_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz
  FROM {source} WHERE is_epitope GROUP BY design_id HAVING count(*) >= 3),
{eig_sql(out + '_c', out + '_e')},
{out}_x AS (SELECT *, [(xy)*yz - xz*(yy-l3), xz*xy - (xx-l3)*yz, (xx-l3)*(yy-l3) - xy*xy] AS k1, [xy*(zz-l3) - xz*yz, xz*xz - (xx-l3)*(zz-l3), (xx-l3)*yz - xy*xz] AS k2,
  [(yy-l3)*(zz-l3) - yz*yz, yz*xz - xy*(zz-l3), xy*yz - (yy-l3)*xz] AS k3 FROM {out}_e),
{out}_n AS (SELECT *, k1[1]*k1[1]+k1[2]*k1[2]+k1[3]*k1[3] AS s1, k2[1]*k2[1]+k2[2]*k2[2]+k2[3]*k2[3] AS s2, k3[1]*k3[1]+k3[2]*k3[2]+k3[3]*k3[3] AS s3 FROM {out}_x),
{out}_v AS (SELECT *, CASE WHEN s1 >= s2 AND s1 >= s3 THEN list_transform(k1, lambda v: v / sqrt(s1)) WHEN s2 >= s3 THEN list_transform(k2, lambda v: v / sqrt(s2)) ELSE list_transform(k3, lambda v: v / sqrt(s3)) END AS v FROM {out}_n),
{out}_b AS (SELECT design_id, avg(x) AS bx, avg(y) AS byy, avg(z) AS bz FROM {source} GROUP BY design_id),
{out}_f AS (SELECT design_id, cx, cy, cz, sg*v[1] AS nx, sg*v[2] AS ny, sg*v[3] AS nz FROM (SELECT a.*, CASE WHEN v[1]*(bx-cx) + v[2]*(byy-cy) + v[3]*(bz-cz) > 0 THEN -1.0 ELSE 1.0 END AS sg FROM {out}_v a JOIN {out}_b USING (design_id))),
{out}_r AS (SELECT f.*, {reach} AS reach FROM {out}_f f),
{out} AS (SELECT *, cx + (reach + {offset})*nx AS px, cy + (reach + {offset})*ny AS py, cz + (reach + {offset})*nz AS pz FROM {out}_r)"""


def placed_sql(source: str, frame: str, out: str) -> str:
    """CTE ``out``: points with their distance along and from the axis of the frame."""
    return f"""{out}_h AS (SELECT s.*, f.nx, f.ny, f.nz, s.x - f.px AS vx, s.y - f.py AS vy, s.z - f.pz AS vz, (s.x - f.px)*f.nx + (s.y - f.py)*f.ny + (s.z - f.pz)*f.nz AS proj FROM {source} s JOIN {frame} f USING (design_id)),
{out} AS (SELECT *, sqrt((vx - proj*nx)*(vx - proj*nx) + (vy - proj*ny)*(vy - proj*ny) + (vz - proj*nz)*(vz - proj*nz)) AS dist FROM {out}_h)"""


PAIRS = f"{BOTH}, pairs AS (SELECT design_id, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, p.is_epitope, res_idx FROM points p JOIN mirror q USING (design_id, res_idx))"


def _pairs(spark, sf):
    name = lambda s: [F.col(x).alias(s + x) for x in "xyz"]
    p = points(spark, sf).select("design_id", "res_idx", "is_epitope", *name("p"))
    return p.join(mirrored(spark, sf).select("design_id", "res_idx", *name("q")), ["design_id", "res_idx"])


# ---------------------------------------------------------------- superposition


@REGISTRY.add("g1_superposed_rmsd", f"WITH {PAIRS}, {rmsd_sql('pairs', 'r')} SELECT design_id, n AS n_pairs, round(rmsd, 3) AS rmsd FROM r")
def superposed_rmsd(spark, sf):
    return r6(G.kabsch_rmsd(_pairs(spark, sf), KEY), 3)


@REGISTRY.add("g2_transform_residual", f"WITH {PAIRS}, {rmsd_sql('pairs', 'r')} SELECT design_id, round(rmsd, 3) AS residual FROM r")
def transform_residual(spark, sf):
    """Moving p by the fitted transform must leave exactly the superposed RMSD to q."""
    pairs = _pairs(spark, sf)
    transform = G.kabsch_transform(pairs, KEY)
    moved = G.apply_transform(pairs.withColumnsRenamed({"px": "x", "py": "y", "pz": "z"}), transform, KEY)
    d2 = sum(((F.col(x) - F.col(f"q{x}")) * (F.col(x) - F.col(f"q{x}")) for x in "xyz"), F.lit(0.0))
    return r6(moved.groupBy(*KEY).agg(F.sqrt(F.avg(d2)).alias("residual")), 3)


ATOM_CASE = "CASE res_idx % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'CA' WHEN 2 THEN 'C' ELSE 'CB' END"


@REGISTRY.add(
    "g3_rmsd_variants",
    f"""WITH {PAIRS}, b AS (SELECT * FROM pairs WHERE res_idx % 4 < 3), be AS (SELECT * FROM b WHERE is_epitope), bs AS (SELECT * FROM b WHERE NOT is_epitope), ca AS (SELECT * FROM pairs WHERE res_idx % 4 = 1),
{rmsd_sql('b', 'r1')}, {rmsd_sql('be', 'r2')}, {rmsd_sql('bs', 'r3')}, {rmsd_sql('ca', 'r4')}
SELECT design_id, round(r1.rmsd, 3) AS backbone, round(r2.rmsd, 3) AS epitope, round(r3.rmsd, 3) AS scaffold, round(r4.rmsd, 3) AS ca FROM r1 JOIN r2 USING (design_id) JOIN r3 USING (design_id) JOIN r4 USING (design_id)""",
)
def rmsd_variants(spark, sf):
    atom = F.element_at(F.array(*[F.lit(a) for a in ("N", "CA", "C", "CB")]), F.col("res_idx") % 4 + 1)
    a, b = points(spark, sf).withColumn("atom_name", atom), mirrored(spark, sf).withColumn("atom_name", atom)
    out = G.rmsd_variant(a, b, KEY, out="backbone").drop("n_pairs")
    for part, atoms in (("epitope", G.BACKBONE), ("scaffold", G.BACKBONE), ("ca", ("CA",))):
        other = G.rmsd_variant(a, b, KEY, atoms, "all" if part == "ca" else part, out=part).drop("n_pairs")
        out = out.join(other, KEY)
    return r6(out, 3)


# ---------------------------------------------------------------- frames, cylinders, cones


@REGISTRY.add(
    "g4_plane_frame",
    f"WITH {POINTS_SQL}, {frame_sql('points', 'f')} SELECT design_id, round(cx, 3) AS cx, round(nx, 3) + 0.0 AS nx, round(ny, 3) + 0.0 AS ny, round(nz, 3) + 0.0 AS nz, round(px, 3) + 0.0 AS basex FROM f",
)
def plane_frame(spark, sf):
    f = G.plane_frame(points(spark, sf), KEY)
    return f.select("design_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("cx", "nx", "ny", "nz", "basex")])


@REGISTRY.add("g4_plane_frame_surface", f"WITH {POINTS_SQL}, {frame_sql('points', 'f', surface=True)} SELECT design_id, round(reach, 3) AS reach, round(pz, 3) + 0.0 AS basez FROM f")
def plane_frame_surface(spark, sf):
    f = G.plane_frame(points(spark, sf), KEY, from_surface=True)
    return f.select("design_id", F.round("reach", 3).alias("reach"), (F.round("basez", 3) + 0.0).alias("basez"))


SMALL_R, SMALL_H = 5.0, 12.0


@REGISTRY.add(
    "g5_in_cylinder",
    f"WITH {POINTS_SQL}, {frame_sql('points', 'f')}, {placed_sql('points', 'f', 'c')} SELECT design_id, res_idx::INTEGER AS res_idx, round(dist, 3) AS dist, proj >= 0 AND proj <= {SMALL_H} AND dist <= {SMALL_R} AS inside FROM c",
)
def in_cylinder(spark, sf):
    p = points(spark, sf)
    out = G.in_cylinder(p, G.plane_frame(p, KEY), KEY, SMALL_R, SMALL_H)
    return out.select("design_id", "res_idx", F.round("dist", 3).alias("dist"), "inside")


@REGISTRY.add(
    "g6_cylinder_counts",
    f"""WITH {BOTH}, {frame_sql('points', 'f')}, {placed_sql('points', 'f', 'c')}, {placed_sql('mirror', 'f', 'm')},
s AS (SELECT * FROM c WHERE proj >= 0 AND proj <= {SMALL_H} AND dist <= {SMALL_R} AND NOT is_epitope),
k AS (SELECT s.design_id, s.res_idx, min((s.x-q.x)*(s.x-q.x) + (s.y-q.y)*(s.y-q.y) + (s.z-q.z)*(s.z-q.z)) AS d2 FROM s JOIN mirror q USING (design_id) GROUP BY 1, 2),
a AS (SELECT design_id, count(*) AS plain, count(*) FILTER (d2 > 4.0) AS aware FROM k GROUP BY 1),
t AS (SELECT design_id, count(*) AS n FROM m WHERE proj >= 0 AND proj <= {SMALL_H} AND dist <= {SMALL_R} AND NOT is_epitope GROUP BY 1)
SELECT design_id, coalesce(plain, 0) AS cylinder_ca_clashes, coalesce(aware, 0) AS cylinder_native_aware, coalesce(t.n, 0) AS native_in_cylinder FROM f LEFT JOIN a USING (design_id) LEFT JOIN t USING (design_id)""",
)
def cylinder_counts(spark, sf):
    p = points(spark, sf)
    return G.cylinder_counts(p, mirrored(spark, sf), G.plane_frame(p, KEY), KEY, SMALL_R, SMALL_H, 2.0)


@REGISTRY.add(
    "g7_cylinder_weighted",
    f"""WITH {POINTS_SQL}, {frame_sql('points', 'f')}, {placed_sql('points', 'f', 'c')}, s AS (SELECT design_id, count(*) AS n, sum(pow(1.0 - dist / {SMALL_R}, 1.5)) AS w FROM c
WHERE proj >= 0 AND proj <= {SMALL_H} AND dist <= {SMALL_R} AND NOT is_epitope GROUP BY 1)
SELECT design_id, coalesce(n, 0) AS n_inside, round(coalesce(w, 0.0), 4) AS depth_sum FROM f LEFT JOIN s USING (design_id)""",
)
def cylinder_weighted(spark, sf):
    p = points(spark, sf)
    return r6(G.cylinder_weighted(p, G.plane_frame(p, KEY), KEY, SMALL_R, SMALL_H, 1.5), 4)


@REGISTRY.add(
    "g7_cylinder_allatom",
    f"""WITH {POINTS_SQL}, {frame_sql('points', 'f', surface=True)}, {placed_sql('points', 'f', 'c')}, s AS (SELECT design_id, res_idx // 3 AS r, max((res_idx % 3 = 1)::INT) AS ca FROM c
WHERE proj >= 0 AND proj <= {SMALL_H} AND dist <= {SMALL_R} AND NOT is_epitope GROUP BY 1, 2), g AS (SELECT design_id, sum(ca)::BIGINT AS ca, count(*) AS n FROM s GROUP BY 1)
SELECT design_id, coalesce(ca, 0) AS ca_clashes, coalesce(n, 0) AS allatom_clashes FROM f LEFT JOIN g USING (design_id)""",
)
def cylinder_allatom(spark, sf):
    p = points(spark, sf)
    atoms = p.withColumn("atom_name", F.when(F.col("res_idx") % 3 == 1, "CA").otherwise("CB")).withColumn("res_idx", F.floor(F.col("res_idx") / 3))
    return G.cylinder_allatom(atoms, G.plane_frame(p, KEY, from_surface=True), KEY, SMALL_R, SMALL_H)


def cone_sql(max_deg: float, rings: int, n_az: int, offset: float = G.OFFSET) -> str:
    rows = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for i, (a, b, c) in enumerate(G.cone_directions(max_deg, rings, n_az)))
    return f"""uu AS (SELECT *, CASE WHEN abs(nx) < 0.9 THEN [0.0, nz, -ny] ELSE [-nz, 0.0, nx] END AS u0 FROM f),
uv AS (SELECT *, list_transform(u0, lambda t: t / sqrt(u0[1]*u0[1] + u0[2]*u0[2] + u0[3]*u0[3])) AS u FROM uu),
vv AS (SELECT *, [ny*u[3] - nz*u[2], nz*u[1] - nx*u[3], nx*u[2] - ny*u[1]] AS v FROM uv),
dd AS (SELECT design_id, dir, cx, cy, cz, w0*nx + w1*u[1] + w2*v[1] AS dx, w0*ny + w1*u[2] + w2*v[2] AS dy, w0*nz + w1*u[3] + w2*v[3] AS dz FROM vv, (VALUES {rows}) t(dir, w0, w1, w2)),
df AS (SELECT design_id, dir, dx AS nx, dy AS ny, dz AS nz, cx + ({offset})*dx AS px, cy + ({offset})*dy AS py, cz + ({offset})*dz AS pz FROM dd)"""


@REGISTRY.add(
    "g8_cone_sweep",
    f"""WITH {POINTS_SQL}, {frame_sql('points', 'f')}, {cone_sql(60.0, 3, 6)},
h AS (SELECT s.design_id, dir, s.x - px AS vx, s.y - py AS vy, s.z - pz AS vz, nx, ny, nz, (s.x - px)*nx + (s.y - py)*ny + (s.z - pz)*nz AS proj FROM points s JOIN df USING (design_id) WHERE NOT is_epitope),
n AS (SELECT design_id, dir, count(*) FILTER (proj >= 0 AND proj <= {SMALL_H} AND sqrt((vx - proj*nx)*(vx - proj*nx) + (vy - proj*ny)*(vy - proj*ny) + (vz - proj*nz)*(vz - proj*nz)) <= {SMALL_R}) AS n FROM h GROUP BY 1, 2)
SELECT design_id, max(n) FILTER (dir = 0)::DOUBLE AS cone_normal_clash, min(n)::DOUBLE AS cone_min_clash, round(quantile_cont(n, 0.1), 6) AS cone_p10_clash, round(avg(n), 6) AS cone_mean_clash,
  round(avg((n = 0)::INT), 6) AS cone_clear_frac FROM n GROUP BY design_id""",
)
def cone_sweep(spark, sf):
    p = points(spark, sf)
    return r6(G.cone_sweep(p, G.plane_frame(p, KEY), KEY, 60.0, 3, 6, SMALL_R, SMALL_H))


GRID = ((-6.0, -2.0), (4.0, 6.0), (8.0, 14.0), (1.0, 3.0))
GRID_SQL = "SELECT o, r, h, c FROM (SELECT unnest([-6.0::DOUBLE, -2.0]) AS o), (SELECT unnest([4.0::DOUBLE, 6.0]) AS r), (SELECT unnest([8.0::DOUBLE, 14.0]) AS h), (SELECT unnest([1.0::DOUBLE, 3.0]) AS c)"
SWEEP_SQL = f"""{BOTH}, {frame_sql('points', 'f', offset=0.0)}, {placed_sql('points', 'f', 'c')},
k AS (SELECT c.design_id, c.res_idx, any_value(c.proj) AS proj, any_value(c.dist) AS dist, sqrt(min((c.x-q.x)*(c.x-q.x) + (c.y-q.y)*(c.y-q.y) + (c.z-q.z)*(c.z-q.z))) AS dn FROM c JOIN mirror q USING (design_id) WHERE NOT c.is_epitope GROUP BY 1, 2),
g AS (SELECT o AS "offset", r AS radius, h AS height, g.c AS carve, design_id, count(*) FILTER (proj - o >= 0 AND proj - o <= h AND dist <= r) AS plain,
  count(*) FILTER (proj - o >= 0 AND proj - o <= h AND dist <= r AND dn > g.c) AS aware FROM k, ({GRID_SQL}) g GROUP BY ALL)"""


def _sweep(spark, sf):
    p = points(spark, sf)
    return G.grid_sweep(p, mirrored(spark, sf), G.plane_frame(p, KEY), KEY, "res_idx", G.grid_cells(*GRID), 3.0)


@REGISTRY.add("g9_grid_sweep", f"WITH {SWEEP_SQL} SELECT * FROM g")
def grid_sweep(spark, sf):
    return _sweep(spark, sf)


@REGISTRY.add(
    "g9_sweep_auc",
    f"""WITH {SWEEP_SQL}, v AS (SELECT "offset", radius, height, carve, aware AS s, design_id % 3 = 0 AS l FROM g),
ranked AS (SELECT *, rank() OVER (PARTITION BY "offset", radius, height, carve ORDER BY s DESC) + (count(*) OVER (PARTITION BY "offset", radius, height, carve, s) - 1) / 2.0 AS r FROM v)
SELECT "offset", radius, height, carve, count(*) FILTER (l) AS n_pos, count(*) FILTER (NOT l) AS n_neg,
  round((sum(r) FILTER (l) - count(*) FILTER (l) * (count(*) FILTER (l) + 1) / 2.0) / (count(*) FILTER (l) * count(*) FILTER (NOT l)), 6) AS auc,
  quantile_cont(s, 0.5) FILTER (l) AS med_free, quantile_cont(s, 0.5) FILTER (NOT l) AS med_clash FROM ranked GROUP BY 1, 2, 3, 4""",
)
def sweep_auc(spark, sf):
    from peptarium.operators import stats

    swept = _sweep(spark, sf).withColumn("free", F.col("design_id") % 3 == 0)
    return r6(stats.sweep_report(swept, ["offset", "radius", "height", "carve"], "aware", "free"))


SPINS = 4
PROBE_SQL = f"""first AS (SELECT label, min(vec_id) AS v FROM embeddings GROUP BY label),
pr AS (SELECT label AS probe, x, y, z, res_idx FROM mirror JOIN first ON design_id = v),
pc AS (SELECT probe, avg(x) FILTER (res_idx < 6) AS ex, avg(y) FILTER (res_idx < 6) AS ey, avg(z) FILTER (res_idx < 6) AS ez, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM pr GROUP BY probe),
pn AS (SELECT *, sqrt((mx-ex)*(mx-ex) + (my-ey)*(my-ey) + (mz-ez)*(mz-ez)) AS l FROM pc),
pb AS (SELECT probe, x - ex AS x, y - ey AS y, z - ez AS z, (mx-ex)/l AS ax, (my-ey)/l AS ay, (mz-ez)/l AS az FROM pr JOIN pn USING (probe))"""


def _probes(spark, sf):
    e = table(spark, sf, "embeddings")
    first = e.groupBy(F.col("label").alias("probe")).agg(F.min("vec_id").alias("design_id"))
    p = mirrored(spark, sf).join(first, "design_id")  # one reference shape per label
    head = F.when(F.col("res_idx") < 6, 1)
    centre = p.groupBy("probe").agg(*[F.avg(F.when(head == 1, F.col(x))).alias(f"e{x}") for x in "xyz"], *[F.avg(x).alias(f"m{x}") for x in "xyz"])
    length = F.sqrt(sum(((F.col(f"m{x}") - F.col(f"e{x}")) * (F.col(f"m{x}") - F.col(f"e{x}")) for x in "xyz"), F.lit(0.0)))
    centre = centre.withColumns({f"a{x}": (F.col(f"m{x}") - F.col(f"e{x}")) / length for x in "xyz"})
    return p.join(centre, "probe").select("probe", *[(F.col(x) - F.col(f"e{x}")).alias(x) for x in "xyz"], "ax", "ay", "az")


@REGISTRY.add(
    "g10_probe_panel",
    f"""WITH {BOTH}, {frame_sql('points', 'f')}, {PROBE_SQL}, own AS (SELECT vec_id AS design_id, label FROM embeddings),
j AS (SELECT f.*, b.probe, b.x AS bx, b.y AS byy, b.z AS bz, ax, ay, az, ax*f.nx + ay*f.ny + az*f.nz AS c, [ay*f.nz - az*f.ny, az*f.nx - ax*f.nz, ax*f.ny - ay*f.nx] AS w FROM f JOIN own USING (design_id) JOIN pb b ON b.probe <> own.label),
t AS (SELECT *, (w[1]*bx + w[2]*byy + w[3]*bz) / (1.0 + c) AS sc FROM j),
u AS (SELECT design_id, probe, cx, cy, cz, nx, ny, nz, bx*c + w[2]*bz - w[3]*byy + w[1]*sc AS ux, byy*c + w[3]*bx - w[1]*bz + w[2]*sc AS uy, bz*c + w[1]*byy - w[2]*bx + w[3]*sc AS uz FROM t),
s AS (SELECT design_id, probe, spin, ux*cs + (ny*uz - nz*uy)*sn + nx*(nx*ux + ny*uy + nz*uz)*(1-cs) + cx AS x, uy*cs + (nz*ux - nx*uz)*sn + ny*(nx*ux + ny*uy + nz*uz)*(1-cs) + cy AS y,
  uz*cs + (nx*uy - ny*ux)*sn + nz*(nx*ux + ny*uy + nz*uz)*(1-cs) + cz AS z FROM u, (SELECT spin, cos(2*pi()*spin/{SPINS}) AS cs, sin(2*pi()*spin/{SPINS}) AS sn FROM range({SPINS}) r(spin))),
h AS (SELECT s.design_id, probe, spin, count(DISTINCT p.res_idx) AS n FROM s LEFT JOIN points p ON p.design_id = s.design_id AND (p.x-s.x)*(p.x-s.x) + (p.y-s.y)*(p.y-s.y) + (p.z-s.z)*(p.z-s.z) < 4.0 GROUP BY 1, 2, 3),
b AS (SELECT design_id, probe, min(n) AS n FROM h GROUP BY 1, 2)
SELECT design_id, count(*) AS n_probes, min(n) AS probe_min_clash, round(avg(n), 6) AS probe_mean_clash FROM b GROUP BY design_id""",
)
def probe_panel(spark, sf):
    p = points(spark, sf)
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("design_id"), F.col("label").alias("own"))
    frames = G.plane_frame(p, KEY).join(own, KEY)
    return r6(G.probe_panel(p, frames, _probes(spark, sf), KEY, SPINS, 2.0, own="own"))


# ---------------------------------------------------------------- error matrices, frequencies, densities

PAE_SQL = """m AS (SELECT vec_id, label, i // 8 AS r, i % 8 AS c, CASE WHEN i % 11 = 10 THEN NULL ELSE CAST(embedding[i + 1] AS DOUBLE) END AS v FROM embeddings, range(64) t(i))"""


def _pae(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    cell = lambda i, j: F.when((i * 8 + j) % 11 != 10, F.get("v", i * 8 + j))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: cell(i, j)))
    epi = F.array_distinct(F.array(F.lit(0), F.lit(3), (F.col("label") % 8).cast("int")))
    return e.select("vec_id", matrix.alias("pae"), epi.alias("epitope_resindices"))


@REGISTRY.add(
    "g11_pae_blocks",
    f"""WITH {PAE_SQL}, e AS (SELECT *, r IN (0, 3, label % 8) AS re, c IN (0, 3, label % 8) AS ce FROM m)
SELECT vec_id, round(avg(v), 6) AS mean_pae, round(avg(v) FILTER (re AND ce), 6) AS epitope_pae, round(avg(v) FILTER (NOT re AND NOT ce), 6) AS scaffold_pae FROM e GROUP BY vec_id""",
)
def pae_blocks(spark, sf):
    return r6(G.pae_blocks(_pae(spark, sf)).select("vec_id", "mean_pae", "epitope_pae", "scaffold_pae"))


@REGISTRY.add(
    "g12_clash_frequency",
    f"""WITH {CONTIGS_SQL}, x AS (SELECT contig_id % 5 AS antibody, unnest(epitope_resindices) AS res_idx FROM contigs), n AS (SELECT contig_id % 5 AS antibody, count(*) AS n_designs FROM contigs GROUP BY 1)
SELECT antibody, res_idx::INTEGER AS res_idx, count(*) AS n, any_value(n_designs) AS n_designs, round(100.0 * count(*) / any_value(n_designs), 6) AS pct FROM x JOIN n USING (antibody) GROUP BY 1, 2""",
)
def clash_frequency(spark, sf):
    rows = contigs(spark, sf).withColumn("antibody", F.col("contig_id") % 5)
    return r6(G.clash_frequency(rows, "epitope_resindices", ["antibody"]))


VOXEL_SQL = f"""{POINTS_SQL}, lo AS (SELECT min(x) - 5 AS x0, min(y) - 5 AS y0, min(z) - 5 AS z0 FROM points),
v AS (SELECT floor((x - x0) / 4)::INTEGER AS ix, floor((y - y0) / 4)::INTEGER AS iy, floor((z - z0) / 4)::INTEGER AS iz, count(*) AS n FROM points, lo GROUP BY 1, 2, 3)"""


@REGISTRY.add("g13_voxel_density", f"WITH {VOXEL_SQL} SELECT * FROM v")
def voxel_density(spark, sf):
    return G.voxel_density(points(spark, sf).select("x", "y", "z"), 4.0)


def _kernel_sql() -> str:
    raw = [math.exp(-0.5 * (d / 0.5) ** 2) for d in range(-2, 3)]
    return "(VALUES " + ", ".join(f"({d}, {w / sum(raw)!r}::DOUBLE)" for d, w in zip(range(-2, 3), raw)) + ")"


@REGISTRY.add(
    "g13_smoothed_density",
    f"""WITH {VOXEL_SQL} SELECT ix + a.d AS ix, iy + b.d AS iy, iz + c.d AS iz, round(sum(n * a.w * b.w * c.w), 6) AS density
FROM v, {_kernel_sql()} a(d, w), {_kernel_sql()} b(d, w), {_kernel_sql()} c(d, w) GROUP BY 1, 2, 3""",
)
def smoothed_density(spark, sf):
    return r6(G.smooth_density(G.voxel_density(points(spark, sf).select("x", "y", "z"), 4.0), 2.0, 4.0))


# ---------------------------------------------------------------- distance joins

D2 = "(p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)"


@REGISTRY.add(
    "j15_within_radius",
    f"""WITH {BOTH}, h AS (SELECT DISTINCT p.design_id, p.res_idx FROM points p JOIN mirror q ON p.design_id = q.design_id AND {D2} < 4.0),
c AS (SELECT design_id, count(*) AS n FROM h GROUP BY 1) SELECT d.design_id, coalesce(n, 0) AS n_clash_res FROM (SELECT DISTINCT design_id FROM points) d LEFT JOIN c USING (design_id)""",
)
def within_radius(spark, sf):
    return R.count_within_radius(points(spark, sf), mirrored(spark, sf), 2.0, KEY)


@REGISTRY.add("j15_residues_within_radius", f"WITH {BOTH} SELECT DISTINCT p.design_id, p.res_idx::INTEGER AS res_idx FROM points p JOIN mirror q ON p.design_id = q.design_id AND {D2} < 4.0")
def residues_within_radius(spark, sf):
    return R.within_radius(points(spark, sf), mirrored(spark, sf), 2.0, KEY)


@REGISTRY.add(
    "j16_min_distance",
    f"WITH {BOTH}, m AS (SELECT p.design_id, p.res_idx, sqrt(min({D2})) AS d FROM points p JOIN mirror q ON p.design_id = q.design_id GROUP BY 1, 2) SELECT design_id, res_idx::INTEGER AS res_idx, round(d, 6) AS min_dist FROM m WHERE d <= 3.0",
)
def min_distance(spark, sf):
    return r6(R.min_distance(points(spark, sf), mirrored(spark, sf), 3.0, KEY))


@REGISTRY.add("j17_carve", f"WITH {BOTH} SELECT design_id, res_idx::INTEGER AS res_idx FROM points p WHERE NOT EXISTS (SELECT 1 FROM mirror q WHERE p.design_id = q.design_id AND {D2} <= 6.25)")
def carve(spark, sf):
    return R.carve(points(spark, sf), mirrored(spark, sf), 2.5, KEY).select("design_id", "res_idx")


@REGISTRY.add(
    "g14_contact_epitope",
    f"""WITH {POINTS_SQL}, m AS (SELECT p.design_id, p.res_idx, sqrt(min({D2})) AS d FROM points p JOIN points q ON p.design_id = q.design_id AND p.res_idx < 12 AND q.res_idx >= 12 GROUP BY 1, 2),
k AS (SELECT design_id, res_idx, res_idx - row_number() OVER (PARTITION BY design_id ORDER BY res_idx) AS g FROM m WHERE d <= 4.0)
SELECT design_id, min(res_idx)::INTEGER AS run_start, max(res_idx)::INTEGER AS run_end, count(*) AS run_size FROM k GROUP BY design_id, g""",
)
def contact_islands(spark, sf):
    atoms = points(spark, sf).withColumn("chain", F.when(F.col("res_idx") < 12, "A").otherwise("H")).withColumn("res_num", F.col("res_idx"))
    return runs(G.contact_epitope(atoms, "A", ["H"]).select("design_id", "res_num"), KEY, "res_num")


@REGISTRY.add(
    "g14_inserted_residues",
    f"""WITH {POINTS_SQL} SELECT p.design_id, (p.res_idx - p.res_idx % 2)::BIGINT AS res_num, CASE WHEN p.res_idx % 2 = 1 THEN 'A' ELSE '' END AS icode, round(sqrt(min({D2})), 6) AS min_dist
FROM points p JOIN points q ON p.design_id = q.design_id AND p.res_idx < 12 AND q.res_idx >= 12 GROUP BY p.design_id, p.res_idx HAVING min({D2}) <= 16.0""",
)
def inserted_contacts(spark, sf):
    odd = F.col("res_idx") % 2
    atoms = points(spark, sf).withColumns({"chain": F.when(F.col("res_idx") < 12, "A").otherwise("H"), "res_num": F.col("res_idx").cast("bigint") - odd, "icode": F.when(odd == 1, "A").otherwise("")})
    return r6(G.contact_epitope(atoms, "A", ["H"]).select("design_id", "res_num", "icode", "min_dist"))


# ---------------------------------------------------------------- whole metric row

LETTERS = "ACDEFGHIKLMNPQRSTVWYA"


def _metric_inputs(spark, sf):
    """Designs with CA atoms from the vectors; natives and antibodies per label from its first vector."""
    e = table(spark, sf, "embeddings")
    seq = F.lit(LETTERS)
    v = F.col("vec_id")
    predicted_seq = F.when(v % 20 == 1, None).when(v % 20 == 2, F.reverse(seq)).when(v % 20 == 3, seq).otherwise(F.concat(F.lit("M" * 1), seq))
    epi = F.when(v % 20 == 3, F.array(F.lit(0), F.lit(1), F.lit(30))).when(v % 20 == 4, F.array(F.lit(2), F.lit(3))).otherwise(F.array(*[F.lit(i) for i in range(6)]))
    designs = e.select(
        v.alias("design_id"), F.col("label").cast("string").alias("id"), seq.alias("design_seq"), predicted_seq.alias("predicted_seq"),
        epi.alias("design_epi"), F.transform(epi, lambda i: F.least(i, F.lit(20))).alias("native_epi"),
    )
    p = points(spark, sf)
    ca = [F.lit("CA").alias("atom_name"), F.lit("C").alias("element")]
    design_atoms = p.select("design_id", "res_idx", *ca, "x", "y", "z")
    shift = F.when(v % 20 == 3, 0).otherwise(1)
    bent = [(F.col("x") * 0.9 + F.col("y") * 0.2).alias("x"), (F.col("y") * 1.1 - F.col("z") * 0.1).alias("y"), (F.col("z") + F.col("x") * 0.15).alias("z")]
    predicted_atoms = p.withColumnRenamed("design_id", "vec_id").select(v.alias("design_id"), (F.col("res_idx") + shift).alias("res_idx"), *ca, *bent)
    first = e.groupBy(F.col("label").cast("string").alias("id")).agg(F.min("vec_id").alias("design_id"))
    chain_a = p.drop("id").join(first, "design_id").select("id", F.lit("A").alias("chain"), "res_idx", *ca, "x", "y", "z")
    chain_h = mirrored(spark, sf).join(first.where("id <> '7'"), "design_id").select("id", F.lit("H").alias("chain"), "res_idx", *ca, "x", "y", "z")
    pae = _pae(spark, sf).select(v.alias("design_id"), "pae")
    return designs, design_atoms, predicted_atoms, chain_a.unionByName(chain_h), pae


@REGISTRY.add(
    "g15_extract_metrics",
    f"""WITH {POINTS_SQL}, {PAE_SQL},
d AS (SELECT vec_id AS design_id, label::VARCHAR AS id, CASE WHEN vec_id % 20 = 1 THEN 'no_prediction' WHEN vec_id % 20 = 2 THEN 'seqmatch_fail' WHEN vec_id % 20 = 3 THEN 'epi_oob(n=21)' ELSE 'ok' END AS status FROM embeddings),
ep AS (SELECT vec_id AS design_id, CASE WHEN vec_id % 20 = 4 THEN 2 ELSE 0 END AS lo, CASE WHEN vec_id % 20 = 4 THEN 3 ELSE 5 END AS hi FROM embeddings),
pred AS (SELECT design_id, res_idx, x*0.9 + y*0.2 AS x, y*1.1 - z*0.1 AS y, z + x*0.15 AS z, res_idx BETWEEN lo AND hi AS is_epitope FROM points JOIN ep USING (design_id)),
pq AS (SELECT design_id, a.x AS px, a.y AS py, a.z AS pz, b.x AS qx, b.y AS qy, b.z AS qz, b.is_epitope FROM points a JOIN pred b USING (design_id, res_idx)),
pe AS (SELECT * FROM pq WHERE is_epitope), {rmsd_sql('pq', 'r1')}, {rmsd_sql('pe', 'r2')},
pa AS (SELECT vec_id AS design_id, avg(v) AS mean_pae, avg(v) FILTER (r - 1 BETWEEN lo AND hi AND c - 1 BETWEEN lo AND hi) AS epitope_pae,
  avg(v) FILTER (NOT r - 1 BETWEEN lo AND hi AND NOT c - 1 BETWEEN lo AND hi) AS scaffold_pae FROM m JOIN ep ON ep.design_id = vec_id GROUP BY vec_id),
{frame_sql('pred', 'f')}, {placed_sql('pred', 'f', 'cy')}, n AS (SELECT design_id, count(*) FILTER (proj >= 0 AND proj <= 40 AND dist <= 16 AND NOT is_epitope) AS plain FROM cy GROUP BY 1)
SELECT design_id, d.id, status, CASE WHEN status <> 'ok' THEN 'not_run' WHEN design_id % 20 = 4 THEN 'too_few_epitope_pairs' WHEN d.id = '7' THEN 'no_antibody_atoms' ELSE 'ok' END AS af3_clash_status,
  CASE WHEN status = 'ok' THEN 1 WHEN status LIKE 'epi%' THEN 0 END::INTEGER AS af3_window_start, CASE WHEN status = 'ok' THEN round(r1.rmsd, 3) END AS overall_rmsd,
  CASE WHEN status = 'ok' AND design_id % 20 <> 4 THEN round(r2.rmsd, 3) END AS epitope_chunk_rmsd, CASE WHEN status = 'ok' THEN round(mean_pae, 6) END AS mean_pae,
  CASE WHEN status = 'ok' THEN round(epitope_pae, 6) END AS epitope_pae, CASE WHEN status = 'ok' THEN round(scaffold_pae, 6) END AS scaffold_pae,
  CASE WHEN status = 'ok' AND design_id % 20 <> 4 THEN coalesce(plain, 0) END AS cylinder_ca_clashes
FROM d LEFT JOIN r1 USING (design_id) LEFT JOIN r2 USING (design_id) LEFT JOIN pa USING (design_id) LEFT JOIN n USING (design_id)""",
)
def extract_metrics(spark, sf):
    out = G.extract_metrics(*_metric_inputs(spark, sf))
    wanted = ("design_id", "id", "status", "af3_clash_status", "af3_window_start", "overall_rmsd", "epitope_chunk_rmsd", "mean_pae", "epitope_pae", "scaffold_pae", "cylinder_ca_clashes")
    out = out.select(*wanted)
    return r6(out).withColumns({c: F.round(c, 3) for c in ("overall_rmsd", "epitope_chunk_rmsd")})


def axis_sql(row: str, value: str) -> str:
    """The unit eigenvector of a symmetric matrix (xx..yz of ``row``) for ``value``, by the longest cross product."""
    crosses = [f"[xy*yz - xz*(yy-{value}), xz*xy - (xx-{value})*yz, (xx-{value})*(yy-{value}) - xy*xy]",
               f"[xy*(zz-{value}) - xz*yz, xz*xz - (xx-{value})*(zz-{value}), (xx-{value})*yz - xy*xz]",
               f"[(yy-{value})*(zz-{value}) - yz*yz, yz*xz - xy*(zz-{value}), xy*yz - (yy-{value})*xz]"]
    return f"SELECT *, (SELECT list_transform(k, lambda c: c / sqrt(s)) FROM (SELECT k, k[1]*k[1] + k[2]*k[2] + k[3]*k[3] AS s FROM (SELECT unnest([{', '.join(crosses)}]) AS k)) ORDER BY s DESC LIMIT 1)"


def rotation_sql(pairs: str, out: str) -> str:
    """CTE ``out``: rotation r00..r22 that carries centred p onto centred q, from eigenvectors v of H'H and u = Hv."""
    h = ", ".join(f"count(*) * covar_pop({p}, {q}) AS h{i}{j}" for i, p in enumerate(("px", "py", "pz")) for j, q in enumerate(("qx", "qy", "qz")))
    means = ", ".join(f"avg({c}) AS m{c}" for c in ("px", "py", "pz", "qx", "qy", "qz"))
    g = ", ".join(f"h0{a}*h0{b} + h1{a}*h1{b} + h2{a}*h2{b} AS {n}" for n, a, b in (("xx", 0, 0), ("yy", 1, 1), ("zz", 2, 2), ("xy", 0, 1), ("xz", 0, 2), ("yz", 1, 2)))
    cross = lambda a, b: f"[{a}[2]*{b}[3] - {a}[3]*{b}[2], {a}[3]*{b}[1] - {a}[1]*{b}[3], {a}[1]*{b}[2] - {a}[2]*{b}[1]]"
    unit = lambda v: f"list_transform({v}, lambda c: c / sqrt({v}[1]*{v}[1] + {v}[2]*{v}[2] + {v}[3]*{v}[3]))"
    apply = lambda v: "[" + ", ".join(f"h{i}0*{v}[1] + h{i}1*{v}[2] + h{i}2*{v}[3]" for i in range(3)) + "]"
    r = ", ".join(f"v1[{i}]*u1[{j}] + v2[{i}]*u2[{j}] + v3[{i}]*u3[{j}] AS r{i - 1}{j - 1}" for i in (1, 2, 3) for j in (1, 2, 3))
    return f"""{out}_s AS (SELECT design_id, count(*) AS n, {means}, {h} FROM {pairs} GROUP BY design_id HAVING count(*) >= 3),
{out}_g AS (SELECT *, {g} FROM {out}_s),
{eig_sql(out + '_g', out + '_e')},
{out}_1 AS ({axis_sql(out, 'l1')} AS v1 FROM {out}_e),
{out}_3 AS ({axis_sql(out, 'l3')} AS w3 FROM {out}_1),
{out}_v AS (SELECT *, {cross('w3', 'v1')} AS v2 FROM {out}_3),
{out}_w AS (SELECT *, {cross('v1', 'v2')} AS v3, {apply('v1')} AS a1, {apply('v2')} AS a2 FROM {out}_v),
{out}_u AS (SELECT *, {unit('a1')} AS u1, {unit('a2')} AS u2 FROM {out}_w),
{out}_x AS (SELECT *, {cross('u1', 'u2')} AS u3 FROM {out}_u),
{out} AS (SELECT design_id, n, mpx, mpy, mpz, mqx, mqy, mqz, {r} FROM {out}_x)"""


def turned_sql(at: str, back: bool = False) -> str:
    """x, y, z of row alias ``at`` moved by the rotation in row alias ``t``, or back by its transpose."""
    a, b = ("q", "p") if back else ("p", "q")
    r = lambda i, j: f"t.r{j}{i}" if back else f"t.r{i}{j}"
    return ", ".join(f"{' + '.join(f'{r(i, j)}*({at}.{y} - t.m{a}{y})' for j, y in enumerate('xyz'))} + t.m{b}{x} AS {x}" for i, x in enumerate("xyz"))


@REGISTRY.add(
    "g15_extract_metrics_clashes",
    f"""WITH {BOTH},
d AS (SELECT vec_id AS design_id, label, label::VARCHAR AS id, vec_id % 20 IN (1, 2, 3) AS out_of_run, CASE WHEN vec_id % 20 = 4 THEN 2 ELSE 0 END AS lo, CASE WHEN vec_id % 20 = 4 THEN 3 ELSE 5 END AS hi FROM embeddings),
first AS (SELECT label, min(vec_id) AS v FROM embeddings GROUP BY label),
pred AS (SELECT p.design_id, d.label, res_idx, x*0.9 + y*0.2 AS x, y*1.1 - z*0.1 AS y, z + x*0.15 AS z, res_idx BETWEEN lo AND hi AS is_epitope FROM points p JOIN d USING (design_id) WHERE NOT out_of_run),
nat AS (SELECT label, res_idx, x, y, z FROM points JOIN first ON design_id = v),
ab AS (SELECT label, x, y, z FROM mirror JOIN first ON design_id = v WHERE label <> 7),
ep AS (SELECT design_id, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz FROM pred p JOIN nat q USING (label, res_idx) WHERE is_epitope),
{rotation_sql('ep', 'rot')}, {frame_sql('pred', 'f')}, {placed_sql('pred', 'f', 'cy')},
moved AS (SELECT p.design_id, p.label, p.res_idx, {turned_sql('p')} FROM pred p JOIN rot t USING (design_id) WHERE NOT is_epitope),
hit AS (SELECT m.design_id, count(DISTINCT m.res_idx) AS n FROM moved m JOIN ab q ON m.label = q.label AND (m.x-q.x)*(m.x-q.x) + (m.y-q.y)*(m.y-q.y) + (m.z-q.z)*(m.z-q.z) < {G.CLASH_CUTOFF ** 2} GROUP BY 1),
ins AS (SELECT c.design_id, c.res_idx FROM cy c WHERE proj >= 0 AND proj <= {G.HEIGHT} AND dist <= {G.RADIUS} AND NOT is_epitope),
near AS (SELECT DISTINCT m.design_id, m.res_idx FROM moved m JOIN nat q ON m.label = q.label AND (m.x-q.x)*(m.x-q.x) + (m.y-q.y)*(m.y-q.y) + (m.z-q.z)*(m.z-q.z) <= {G.CARVE ** 2}),
aware AS (SELECT i.design_id, count(*) FILTER (k.res_idx IS NULL) AS n FROM ins i LEFT JOIN near k USING (design_id, res_idx) GROUP BY 1),
back AS (SELECT d.design_id, q.res_idx, q.res_idx BETWEEN lo AND hi AS is_epitope, {turned_sql('q', back=True)} FROM nat q JOIN d USING (label) JOIN rot t ON t.design_id = d.design_id),
{placed_sql('back', 'f', 'cb')},
nin AS (SELECT design_id, count(*) FILTER (proj >= 0 AND proj <= {G.HEIGHT} AND dist <= {G.RADIUS} AND NOT is_epitope) AS n FROM cb GROUP BY 1),
s AS (SELECT design_id, id, CASE WHEN out_of_run THEN 'not_run' WHEN rot.n IS NULL THEN 'too_few_epitope_pairs' WHEN id = '7' THEN 'no_antibody_atoms' ELSE 'ok' END AS af3_clash_status, rot.n IS NOT NULL AS aligned FROM d LEFT JOIN rot USING (design_id))
SELECT s.design_id, af3_clash_status, CASE WHEN af3_clash_status = 'ok' THEN coalesce(hit.n, 0) END AS af3_n_clash_res, CASE WHEN af3_clash_status = 'ok' THEN coalesce(hit.n, 0) > 0 END AS af3_has_clash,
  CASE WHEN aligned THEN coalesce(aware.n, 0) END AS cylinder_native_aware, CASE WHEN aligned THEN coalesce(nin.n, 0) END AS native_in_cylinder
FROM s LEFT JOIN hit USING (design_id) LEFT JOIN aware USING (design_id) LEFT JOIN nin USING (design_id)""",
)
def extract_metrics_clashes(spark, sf):
    out = G.extract_metrics(*_metric_inputs(spark, sf))
    return out.select("design_id", "af3_clash_status", "af3_n_clash_res", "af3_has_clash", "cylinder_native_aware", "native_in_cylinder")
