"""Geometry over atom tables: superposition, plane frames, cylinders, cones, error-matrix blocks.

Sums, pairings and counts are grouped aggregates. What is left per design is one 3x3 problem, solved
in column arithmetic (RMSD) or in Arrow batches (transforms and plane normals).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from peptarium.operators.ordering import beside, fits_one_task, lookup
from peptarium.operators.spatial import XYZ, carve, hits, min_distance, near_points, nearest_up_to, small_groups

# The cylinder and its carve distance.
RADIUS, HEIGHT, OFFSET, CARVE = 16.0, 40.0, -4.0, 1.0
BACKBONE = ("N", "CA", "C", "O")
CLASH_CUTOFF = 4.0

_P = ("px", "py", "pz")
_Q = ("qx", "qy", "qz")


# ---------------------------------------------------------------- superposition


def pair_sums(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per key: n, both centroids, the nine centred cross sums h<i><j>, and the centred square sum e0.

    Covariances come from Spark's own co-moment aggregates, which merge partial results stably.
    """
    n = F.count(F.lit(1))
    cross = [(n * F.covar_pop(p, q)).alias(f"h{i}{j}") for i, p in enumerate(_P) for j, q in enumerate(_Q)]
    squares = reduce(lambda a, b: a + b, [F.var_pop(c) for c in (*_P, *_Q)])
    means = [F.avg(c).alias(f"m_{c}") for c in (*_P, *_Q)]
    return pairs.groupBy(*key).agg(n.alias("n"), *means, *cross, (n * squares).alias("e0"))


def _det(h: list[list[Column]]) -> Column:
    return (
        h[0][0] * (h[1][1] * h[2][2] - h[1][2] * h[2][1])
        - h[0][1] * (h[1][0] * h[2][2] - h[1][2] * h[2][0])
        + h[0][2] * (h[1][0] * h[2][1] - h[1][1] * h[2][0])
    )


def symmetric_eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix, largest first, by the trigonometric formula."""
    mean = (xx + yy + zz) / 3.0
    a, b, c = xx - mean, yy - mean, zz - mean
    spread = F.sqrt((a * a + b * b + c * c + 2.0 * (xy * xy + xz * xz + yz * yz)) / 6.0)
    det = a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    half = F.when(spread > 0, det / (2.0 * spread * spread * spread)).otherwise(F.lit(0.0))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3.0
    first = mean + 2.0 * spread * F.cos(angle)
    last = mean + 2.0 * spread * F.cos(angle + F.lit(2.0 * math.pi / 3.0))
    return first, 3.0 * mean - first - last, last


def kabsch_rmsd(pairs: DataFrame, key: Sequence[str], min_pairs: int = 3, out: str = "rmsd") -> DataFrame:
    """Superposed RMSD of paired points (px,py,pz)-(qx,qy,qz) per key; null under ``min_pairs`` pairs."""
    sums = pair_sums(pairs, key)
    h = [[F.col(f"h{i}{j}") for j in range(3)] for i in range(3)]
    gram = lambda a, b: h[0][a] * h[0][b] + h[1][a] * h[1][b] + h[2][a] * h[2][b]
    with_gram = sums.select(
        *key,
        "n",
        "e0",
        _det(h).alias("_det"),
        *[gram(a, b).alias(f"_g{a}{b}") for a, b in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))],
    )
    values = symmetric_eigenvalues(*[F.col(f"_g{s}") for s in ("00", "11", "22", "01", "02", "12")])
    s1, s2, s3 = [F.sqrt(F.greatest(v, F.lit(0.0))) for v in values]
    residual = (F.col("e0") - 2.0 * (s1 + s2 + F.signum("_det") * s3)) / F.col("n")
    rmsd = F.when(F.col("n") >= min_pairs, F.sqrt(F.greatest(residual, F.lit(0.0))))
    return with_gram.select(*key, F.col("n").alias("n_pairs"), rmsd.alias(out))


def kabsch_rmsds(pairs: DataFrame, key: Sequence[str], parts: dict[str, Column], min_pairs: int = 3) -> DataFrame:
    """Superposed RMSDs of several parts of the same pairs (``{out: which pairs}``), from one aggregate by (key, part)."""
    member = F.array_compact(F.array(*[F.when(keep, F.lit(i)) for i, keep in enumerate(parts.values())]))
    rows = kabsch_rmsd(pairs.select(*key, *_P, *_Q, F.explode(member).alias("_part")), [*key, "_part"], min_pairs)
    return rows.groupBy(*key).agg(*[F.max(F.when(F.col("_part") == i, F.col("rmsd"))).alias(out) for i, out in enumerate(parts)])


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


@F.pandas_udf(_doubles(*[f"r{i}{j}" for i in range(3) for j in range(3)]))
def _rotation(sums: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Proper rotation of each 3x3 cross-sum matrix, a whole Arrow batch at a time."""
    for batch in sums:
        h = batch.to_numpy(float).reshape(-1, 3, 3)
        ok = np.isfinite(h).all(axis=(1, 2))
        u, _, vt = np.linalg.svd(np.where(ok[:, None, None], h, 0.0))
        v, ut = np.swapaxes(vt, 1, 2), np.swapaxes(u, 1, 2)
        flip = np.ones((len(h), 3))
        flip[:, 2] = np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)
        r = (v * flip[:, None, :]) @ ut
        r[~ok] = np.nan
        yield pd.DataFrame(r.reshape(-1, 9), columns=[f"r{i}{j}" for i in range(3) for j in range(3)])


def kabsch_transform(pairs: DataFrame, key: Sequence[str], min_pairs: int = 3) -> DataFrame:
    """Per key, the rotation r00..r22 and shift t0..t2 that carry p onto q."""
    sums = pair_sums(pairs, key).where(F.col("n") >= min_pairs)
    h = F.struct(*[F.col(f"h{i}{j}") for i in range(3) for j in range(3)])
    turned = sums.withColumn("_r", _rotation(h))
    turned = turned.select(*key, "n", *[f"m_{c}" for c in (*_P, *_Q)], "_r.*")
    shift = [
        (F.col(f"m_{q}") - reduce(lambda a, b: a + b, [F.col(f"r{i}{j}") * F.col(f"m_{p}") for j, p in enumerate(_P)])).alias(f"t{i}")
        for i, q in enumerate(_Q)
    ]
    return turned.select(*key, F.col("n").alias("n_pairs"), *[f"r{i}{j}" for i in range(3) for j in range(3)], *shift)


def apply_transform(points: DataFrame, transforms: DataFrame, key: Sequence[str], small: bool | None = None) -> DataFrame:
    """Move (x,y,z) by the transform of the key; points of keys without one are dropped."""
    moved = lookup(points, transforms.drop("n_pairs"), key, "inner", small=small)
    new = [
        (F.col(f"t{i}") + reduce(lambda a, b: a + b, [F.col(f"r{i}{j}") * F.col(x) for j, x in enumerate(XYZ)])).alias(x)
        for i, x in enumerate(XYZ)
    ]
    return moved.select(*[c for c in points.columns if c not in XYZ], *new)


def rmsd_variant(
    a: DataFrame,
    b: DataFrame,
    key: Sequence[str],
    atoms: Sequence[str] = BACKBONE,
    part: str = "all",
    epitope: str = "is_epitope",
    out: str = "rmsd",
) -> DataFrame:
    """RMSD family: backbone or CA atoms over the whole window, the epitope or the scaffold."""

    def side(df: DataFrame, names: Sequence[str]) -> DataFrame:
        chosen = df.where(F.col("atom_name").isin(list(atoms)))
        return chosen.select(*key, "res_idx", "atom_name", *[F.col(x).alias(n) for x, n in zip(XYZ, names)], *([epitope] if names is _P else []))

    left = side(a, _P)
    if part != "all":
        left = left.where(F.col(epitope) if part == "epitope" else ~F.col(epitope))
    return kabsch_rmsd(left.join(side(b, _Q), [*key, "res_idx", "atom_name"]), key, out=out)


# ---------------------------------------------------------------- plane frames and cylinders


@F.pandas_udf(_doubles("nx", "ny", "nz"))
def _least_axis(cov: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit axis of least variance of each covariance (xx,yy,zz,xy,xz,yz), a batch at a time."""
    for batch in cov:
        c = batch.to_numpy(float)
        ok = np.isfinite(c).all(axis=1)
        c = np.where(ok[:, None], c, 0.0)
        m = c[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
        axis = np.linalg.eigh(m)[1][:, :, 0]
        axis[~ok] = np.nan
        yield pd.DataFrame(axis, columns=["nx", "ny", "nz"])


def covariance(points: DataFrame, key: Sequence[str]) -> DataFrame:
    pairs = (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))
    return points.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_epi"),
        *[F.avg(x).alias(f"c{x}") for x in XYZ],
        *[F.covar_pop(a, b).alias(f"v{a}{b}") for a, b in pairs],
    )


def plane_frame(
    points: DataFrame, key: Sequence[str], offset: float = OFFSET, epitope: str = "is_epitope", from_surface: bool = False
) -> DataFrame:
    """Epitope plane per key: centroid c, outward unit normal n, and base = centroid + offset·normal.

    The normal points away from the whole body's centroid. ``from_surface`` measures the offset from
    the epitope point furthest along the normal.
    """
    epi = points.where(F.col(epitope))
    cov = covariance(epi, key).where(F.col("n_epi") >= 3)
    body = points.groupBy(*key).agg(*[F.avg(x).alias(f"b{x}") for x in XYZ])
    axis = _least_axis(F.struct("vxx", "vyy", "vzz", "vxy", "vxz", "vyz"))
    frame = cov.withColumn("_n", axis).join(body, list(key))
    toward = reduce(lambda a, b: a + b, [F.col(f"_n.n{x}") * (F.col(f"b{x}") - F.col(f"c{x}")) for x in XYZ])
    sign = F.when(toward > 0, -1.0).otherwise(1.0)
    frame = frame.select(*key, "n_epi", "cx", "cy", "cz", *[(sign * F.col(f"_n.n{x}")).alias(f"n{x}") for x in XYZ])
    if from_surface:
        along = reduce(lambda a, b: a + b, [(F.col(x) - F.col(f"c{x}")) * F.col(f"n{x}") for x in XYZ])
        reach = lookup(epi, frame, key, "inner").groupBy(*key).agg(F.max(along).alias("reach"))
        frame = frame.join(reach, list(key))
    else:
        frame = frame.withColumn("reach", F.lit(0.0))
    return frame.withColumns({f"base{x}": F.col(f"c{x}") + (F.col("reach") + F.lit(offset)) * F.col(f"n{x}") for x in XYZ})


def along_axis(base: str = "base") -> tuple[Column, Column]:
    """(distance along the normal from the base, distance from the axis) of a point joined to its frame."""
    v = [F.col(x) - F.col(f"{base}{x}") for x in XYZ]
    n = [F.col(f"n{x}") for x in XYZ]
    proj = v[0] * n[0] + v[1] * n[1] + v[2] * n[2]
    perp = [v[i] - proj * n[i] for i in range(3)]
    return proj, F.sqrt(perp[0] * perp[0] + perp[1] * perp[1] + perp[2] * perp[2])


def in_cylinder(
    points: DataFrame, frames: DataFrame, key: Sequence[str], radius: float = RADIUS, height: float = HEIGHT, small: bool | None = None
) -> DataFrame:
    """Add ``proj``, ``dist`` and ``inside`` to every point of a key that has a frame."""
    joined = lookup(points, frames, key, "inner", small=small)
    proj, dist = along_axis()
    out = joined.select(*points.columns, proj.alias("proj"), dist.alias("dist"))
    return out.withColumn("inside", (F.col("proj") >= 0) & (F.col("proj") <= height) & (F.col("dist") <= radius))


def cylinder_counts(
    points: DataFrame,
    native: DataFrame,
    frames: DataFrame,
    key: Sequence[str],
    radius: float = RADIUS,
    height: float = HEIGHT,
    carve_dist: float = CARVE,
    epitope: str = "is_epitope",
) -> DataFrame:
    """Scaffold points in the cylinder, those left after carving native volume, and native non-epitope points."""
    placed = in_cylinder(points, frames, key, radius, height)
    scaffold = placed.where(F.col("inside") & ~F.col(epitope))
    plain = scaffold.groupBy(*key).agg(F.count(F.lit(1)).alias("cylinder_ca_clashes"))
    aware = carve(scaffold, native, carve_dist, key).groupBy(*key).agg(F.count(F.lit(1)).alias("cylinder_native_aware"))
    test = (
        in_cylinder(native, frames, key, radius, height)
        .where(F.col("inside") & ~F.col(epitope))
        .groupBy(*key)
        .agg(F.count(F.lit(1)).alias("native_in_cylinder"))
    )
    counts = frames.select(*key)
    for part in (plain, aware, test):
        counts = counts.join(part, list(key), "left")
    return counts.fillna(0, ["cylinder_ca_clashes", "cylinder_native_aware", "native_in_cylinder"])


def cylinder_weighted(
    points: DataFrame, frames: DataFrame, key: Sequence[str], radius: float = RADIUS, height: float = HEIGHT, power: float = 1.0
) -> DataFrame:
    """Count of scaffold points inside and the same weighted by radial depth ``(1 − dist/R)^power``."""
    inside = in_cylinder(points, frames, key, radius, height).where(F.col("inside") & ~F.col("is_epitope"))
    depth = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("dist") / F.lit(radius))
    counts = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("n_inside"), F.sum(F.pow(depth, F.lit(power))).alias("depth_sum"))
    return frames.select(*key).join(counts, list(key), "left").fillna(0, ["n_inside", "depth_sum"])


def cylinder_allatom(
    atoms: DataFrame, frames: DataFrame, key: Sequence[str], radius: float = RADIUS, height: float = HEIGHT
) -> DataFrame:
    """Distinct scaffold residues with their CA inside, and with any heavy atom inside."""
    inside = in_cylinder(atoms, frames, key, radius, height).where(F.col("inside") & ~F.col("is_epitope"))
    counts = inside.groupBy(*key, "res_idx").agg(F.max((F.col("atom_name") == "CA").cast("int")).alias("ca")).groupBy(*key)
    counts = counts.agg(F.sum("ca").alias("ca_clashes"), F.count(F.lit(1)).alias("allatom_clashes"))
    return frames.select(*key).join(counts, list(key), "left").fillna(0, ["ca_clashes", "allatom_clashes"])


# ---------------------------------------------------------------- cone, grid, probes


def cone_directions(max_deg: float, rings: int, n_az: int) -> list[tuple[float, float, float]]:
    """Direction weights on (normal, u, v): the normal itself, then rings of equally spaced azimuths."""
    out = [(1.0, 0.0, 0.0)]
    for ring in range(1, rings + 1):
        tilt = math.radians(max_deg) * ring / rings
        for k in range(n_az):
            turn = 2 * math.pi * k / n_az
            out.append((math.cos(tilt), math.sin(tilt) * math.cos(turn), math.sin(tilt) * math.sin(turn)))
    return out


def _cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _with_plane_axes(frames: DataFrame) -> DataFrame:
    """Two unit vectors u, v that complete the normal to a frame."""
    n = [F.col(f"n{x}") for x in XYZ]
    flat = F.abs(n[0]) < 0.9
    helper = [F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0)]
    raw = _cross(n, helper)
    norm = F.sqrt(raw[0] * raw[0] + raw[1] * raw[1] + raw[2] * raw[2])
    frames = frames.withColumns({f"u{x}": c / norm for x, c in zip(XYZ, raw)})
    return frames.withColumns({f"v{x}": c for x, c in zip(XYZ, _cross(n, [F.col(f"u{x}") for x in XYZ]))})


def cone_sweep(
    points: DataFrame,
    frames: DataFrame,
    key: Sequence[str],
    max_deg: float = 60.0,
    rings: int = 4,
    n_az: int = 8,
    radius: float = RADIUS,
    height: float = HEIGHT,
    offset: float = OFFSET,
) -> DataFrame:
    """Scaffold points in the cylinder along each direction of a cone: normal, min, p10, mean, clear share."""
    directions = F.array(
        *[F.struct(F.lit(i).alias("dir"), *[F.lit(w).alias(f"w{j}") for j, w in enumerate(d)]) for i, d in enumerate(cone_directions(max_deg, rings, n_az))]
    )
    swept = _with_plane_axes(frames).select(*key, "cx", "cy", "cz", *[f"{a}{x}" for a in "nuv" for x in XYZ], F.inline(directions))
    swept = swept.withColumns({f"d{x}": F.col("w0") * F.col(f"n{x}") + F.col("w1") * F.col(f"u{x}") + F.col("w2") * F.col(f"v{x}") for x in XYZ})
    swept = swept.select(*key, "dir", *[F.col(f"d{x}").alias(f"n{x}") for x in XYZ], *[(F.col(f"c{x}") + F.lit(offset) * F.col(f"d{x}")).alias(f"base{x}") for x in XYZ])
    scaffold = points.where(~F.col("is_epitope")).select(*key, *XYZ)
    per_key = swept.groupBy(*key).agg(F.collect_list(F.struct("dir", *[f"n{x}" for x in XYZ], *[f"base{x}" for x in XYZ])).alias("_dirs"))
    # the list has one entry per direction (33 by default), the point side is never grouped
    met = lookup(scaffold, per_key, key, "inner").select(*key, *XYZ, F.inline("_dirs"))
    proj, dist = along_axis()
    inside = (proj >= 0) & (proj <= height) & (dist <= radius)
    hits = met.groupBy(*key, "dir").agg(F.sum(inside.cast("int")).alias("n"))
    counts = swept.select(*key, "dir").join(hits, [*key, "dir"], "left").fillna(0, ["n"])
    # at most `directions` rows per key from here on
    return counts.groupBy(*key).agg(
        F.max(F.when(F.col("dir") == 0, F.col("n"))).cast("double").alias("cone_normal_clash"),
        F.min("n").cast("double").alias("cone_min_clash"),
        F.percentile("n", 0.1).alias("cone_p10_clash"),
        F.avg("n").alias("cone_mean_clash"),
        F.avg((F.col("n") == 0).cast("double")).alias("cone_clear_frac"),
    )


def grid_cells(offsets: Sequence[float], radii: Sequence[float], heights: Sequence[float], carves: Sequence[float] = (0.0,)) -> Column:
    """Every parameter cell as an array literal, for ``inline``."""
    cells = [(o, r, h, c) for o in offsets for r in radii for h in heights for c in carves]
    names = ("offset", "radius", "height", "carve")
    return F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(cell, names)]) for cell in cells])


def grid_sweep(points: DataFrame, native: DataFrame, frames: DataFrame, key: Sequence[str], point: str, grid: Column, max_carve: float) -> DataFrame:
    """Plain and native-aware counts of every parameter cell per key.

    Projection, axis distance and nearest-native distance are computed once per point; cells only
    compare them.
    """
    scaffold = points.where(~F.col("is_epitope"))
    whole = small_groups(scaffold, key) and small_groups(native, key)
    near = nearest_up_to(scaffold, native, max_carve, key, [point], whole)
    centred = frames.select(*key, *[F.col(f"c{x}").alias(f"base{x}") for x in XYZ], *[f"n{x}" for x in XYZ])
    joined = lookup(near, centred, key, "inner", small=whole or None)
    proj, dist = along_axis()
    measured = joined.select(*key, proj.alias("h0"), dist.alias("dist"), "target_dist")
    if whole:  # narrow points move instead of their cells
        measured = measured.repartition(*key)
    cells = measured.select("*", F.inline(grid))
    rise = F.col("h0") - F.col("offset")
    inside = (rise >= 0) & (rise <= F.col("height")) & (F.col("dist") <= F.col("radius"))
    free = F.col("target_dist").isNull() | (F.col("target_dist") > F.col("carve"))
    return cells.groupBy("offset", "radius", "height", "carve", *key).agg(
        F.sum(inside.cast("bigint")).alias("plain"), F.sum((inside & free).cast("bigint")).alias("aware")
    )


def probe_panel(
    points: DataFrame,
    frames: DataFrame,
    probes: DataFrame,
    key: Sequence[str],
    spins: int = 12,
    cutoff: float = CLASH_CUTOFF,
    own: str | None = None,
) -> DataFrame:
    """Least clash of a panel of partner shapes set onto each epitope.

    ``probes`` is (probe, x, y, z, ax, ay, az): points centred on the probe's own epitope and its unit
    approach direction. The panel is a fixed, small set of reference complexes. Each probe is turned so that
    its approach meets the design's normal, spun about it, and the residues it hits are counted; the best
    spin counts per probe. ``own`` names the frame column with the design's own probe, which is skipped.
    """
    keys = list(key)
    panel = probes.groupBy("probe", "ax", "ay", "az").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    shape = F.struct("probe", "ax", "ay", "az")
    listed = panel.agg(F.collect_list(shape).alias("_panel"))  # one entry per reference complex
    turns = F.array(*[F.struct(F.lit(i).alias("spin"), F.lit(math.cos(2 * math.pi * i / spins)).alias("cs"), F.lit(math.sin(2 * math.pi * i / spins)).alias("sn")) for i in range(spins)])
    extra = [own] if own else []
    placed = beside(frames.select(*keys, *extra, "cx", "cy", "cz", "nx", "ny", "nz"), listed)
    placed = placed.select(*keys, *extra, "cx", "cy", "cz", "nx", "ny", "nz", F.inline("_panel"))
    if own:
        placed = placed.where(~F.col("probe").eqNullSafe(F.col(own)))
    body = placed.join(F.broadcast(probes.drop("ax", "ay", "az")), "probe") if probes.count() <= 1_000_000 else placed.join(probes.drop("ax", "ay", "az"), "probe")
    a, n, p = ([F.col(f"{s}{x}") for x in XYZ] for s in ("a", "n", ""))
    dot = lambda s, t: s[0] * t[0] + s[1] * t[1] + s[2] * t[2]
    c = dot(a, n)
    # Rodrigues turn of p from a onto n: p·c + (a×n)×p + w (w·p)/(1+c), with w = a×n
    w = _cross(a, n)
    wp, scale = _cross(w, p), dot(w, p) / (F.lit(1.0) + c)
    turned = [p[i] * c + wp[i] + w[i] * scale for i in range(3)]
    # opposite directions: half a turn about any axis square to a
    flat = F.abs(a[0]) < 0.9
    helper = [F.when(flat, 1.0).otherwise(0.0), F.when(flat, 0.0).otherwise(1.0), F.lit(0.0)]
    k = _cross(a, helper)
    half = dot(k, p) / dot(k, k)
    opposite = [2.0 * half * k[i] - p[i] for i in range(3)]
    body = body.withColumns({f"_b{x}": F.when(c < -1 + 1e-8, opposite[i]).otherwise(turned[i]) for i, x in enumerate(XYZ)})
    spun = body.select(*keys, "probe", "cx", "cy", "cz", "nx", "ny", "nz", "_bx", "_by", "_bz", F.inline(turns))
    b = [F.col(f"_b{x}") for x in XYZ]
    nb, along = _cross(n, b), dot(n, b)
    where = [
        (b[i] * F.col("cs") + nb[i] * F.col("sn") + n[i] * along * (F.lit(1.0) - F.col("cs")) + F.col(f"c{x}")).alias(x)
        for i, x in enumerate(XYZ)
    ]
    set_down = spun.select(*keys, "probe", "spin", *where)
    poses = placed.select(*keys, "probe").withColumn("spin", F.explode(F.sequence(F.lit(0), F.lit(spins - 1))))
    # many poses meet the few points of their design: all of them, so that no pose moves, or else those points are copied
    whole = small_groups(points, keys, limit=100)
    struck = hits(set_down, points, cutoff, keys, ["probe", "spin"], ["res_idx"], "targets", whole)
    per_pose = struck.groupBy(*keys, "probe", "spin").agg(F.count(F.lit(1)).alias("n"))
    counts = poses.join(per_pose, [*keys, "probe", "spin"], "left").fillna(0, ["n"])
    best = counts.groupBy(*keys, "probe").agg(F.min("n").alias("n"))
    return best.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_probes"), F.min("n").alias("probe_min_clash"), F.avg("n").alias("probe_mean_clash")
    )


# ---------------------------------------------------------------- error matrices, frequencies, densities


def pae_blocks(df: DataFrame, matrix: str = "pae", epitope: str = "epitope_resindices") -> DataFrame:
    """Mean error over the whole matrix and its epitope and scaffold blocks, skipping nulls and NaN.

    Works inside each row: a matrix is one value of the table, nothing is shuffled.
    """

    def block_mean(keep) -> Column:
        rows = F.filter(F.transform(F.col(matrix), lambda r, i: F.struct(r.alias("r"), keep(i).alias("k"))), lambda s: s["k"])
        cells = F.flatten(F.transform(rows, lambda s: F.filter(F.transform(s["r"], lambda v, j: F.when(keep(j) & ~F.isnan(v), v)), lambda v: v.isNotNull())))
        total = F.aggregate(cells, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(cells) > 0, total / F.size(cells))

    # membership is looked up once per index, not once per cell
    side = F.greatest(F.size(matrix), F.array_max(F.transform(matrix, F.size)), F.lit(1))
    member = F.transform(F.sequence(F.lit(0), side - 1), lambda i: F.array_contains(F.col(epitope), i))
    epi = lambda i: F.get("_member", i)
    return (
        df.withColumn("_member", member)
        .withColumns(
            {
                "mean_pae": block_mean(lambda i: i >= 0),
                "epitope_pae": block_mean(epi),
                "scaffold_pae": block_mean(lambda i: ~epi(i)),
            }
        )
        .drop("_member")
    )


def clash_frequency(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """How many designs clash at each residue, and the percentage of all designs."""
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n_designs"))
    hits = df.select(*group, F.explode(F.array_distinct(column)).alias("res_idx")).groupBy(*group, "res_idx").agg(F.count(F.lit(1)).alias("n"))
    joined = hits.join(sizes, list(group)) if group else beside(hits, sizes)
    return joined.withColumn("pct", F.lit(100.0) * F.col("n") / F.col("n_designs"))


def principal_frame(points: DataFrame) -> np.ndarray:
    """Centroid and principal axes (rows, largest variance first) of one point set, from its covariance."""
    row = covariance(points, []).first()
    m = np.array([[row.vxx, row.vxy, row.vxz], [row.vxy, row.vyy, row.vyz], [row.vxz, row.vyz, row.vzz]])
    axes = np.linalg.eigh(m)[1][:, ::-1].T
    return np.vstack([[row.cx, row.cy, row.cz], axes])


def to_local(points: DataFrame, frame: np.ndarray) -> DataFrame:
    centre, axes = frame[0], frame[1:]
    v = [F.col(x) - F.lit(float(centre[i])) for i, x in enumerate(XYZ)]
    moved = {x: reduce(lambda a, b: a + b, [v[j] * F.lit(float(axes[i][j])) for j in range(3)]) for i, x in enumerate(XYZ)}
    return points.select(*[c for c in points.columns if c not in XYZ], *[c.alias(x) for x, c in moved.items()])


def voxel_density(points: DataFrame, size: float, pad: float = 5.0, origin: dict[str, float] | None = None) -> DataFrame:
    """Points per voxel (ix, iy, iz). The grid starts ``pad`` below the lowest coordinates."""
    if origin is None:
        low = points.agg(*[F.min(x).alias(x) for x in XYZ]).first()
        origin = {x: low[x] - pad for x in XYZ}
    cells = {f"i{x}": F.floor((F.col(x) - F.lit(float(origin[x]))) / F.lit(size)).cast("int") for x in XYZ}
    return points.withColumns(cells).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))


def smooth_density(voxels: DataFrame, bandwidth: float, size: float, truncate: float = 4.0) -> DataFrame:
    """Gaussian-smoothed density on an unbounded grid: each voxel adds its weighted count to its neighbours.

    The kernel is separable, so each axis is spread and summed in turn.
    """
    sigma = bandwidth / size
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / sum(raw)).alias("w")) for d, w in zip(range(-reach, reach + 1), raw)])
    out = voxels.select("ix", "iy", "iz", F.col("n").cast("double").alias("density"))
    for axis in ("ix", "iy", "iz"):
        spread = out.select("*", F.inline(kernel)).withColumn(axis, F.col(axis) + F.col("d"))
        out = spread.groupBy("ix", "iy", "iz").agg(F.sum(F.col("density") * F.col("w")).alias("density"))
    return out


def contact_epitope(atoms: DataFrame, antigen: str, partners: Sequence[str], cutoff: float = 4.0, key: Sequence[str] = ("design_id",)) -> DataFrame:
    """Antigen residues within ``cutoff`` of any partner atom, with the smallest distance.

    A residue is its number, and its insertion code where the atoms have one (``icode``, part of the result then).
    """
    antigens, others = atoms.where(F.col("chain") == antigen), atoms.where(F.col("chain").isin(list(partners)))
    if "icode" not in atoms.columns:
        return min_distance(antigens, others, cutoff, list(key), "res_num")
    residue = F.struct("res_num", "icode")
    found = min_distance(antigens.withColumn("_residue", residue), others, cutoff, list(key), "_residue")
    return found.select("*", "_residue.*").drop("_residue")


# ---------------------------------------------------------------- per-design metric row


def extract_metrics(
    designs: DataFrame,
    design_atoms: DataFrame,
    predicted_atoms: DataFrame,
    native_atoms: DataFrame,
    pae: DataFrame,
    clash_cutoff: float = CLASH_CUTOFF,
    carve_dist: float = CARVE,
) -> DataFrame:
    """One metric row per design, with a status for what stopped it.

    ``designs``: design_id, id, design_seq, predicted_seq, design_epi, native_epi (0-based lists; a null
    predicted_seq means no prediction). Atom tables are long with res_idx; native atoms carry ``id`` and
    ``chain`` (antigen ``A``, anything else is the antibody). ``pae``: design_id, pae.
    """
    key = ["design_id"]
    start = F.instr("predicted_seq", F.col("design_seq")) - 1
    n_res = F.length("predicted_seq")
    base = designs.withColumn("window_start", F.when(start >= 0, start)).withColumn(
        "predicted_epi", F.transform("design_epi", lambda i: i + F.col("window_start"))
    )
    status = (
        F.when(F.col("predicted_seq").isNull(), "no_prediction")
        .when(F.col("window_start").isNull(), "seqmatch_fail")
        .when(F.array_max("predicted_epi") >= n_res, F.concat(F.lit("epi_oob(n="), n_res.cast("string"), F.lit(")")))
        .otherwise("ok")
    )
    base = base.withColumn("status", status)
    good = base.where(F.col("status") == "ok").select(*key, "id", "window_start", "design_epi", "predicted_epi", "native_epi")

    small = fits_one_task(design_atoms)
    # one pairing of design and prediction, in the prediction's numbering, serves both RMSDs
    meta = good.select(*key, "id", "window_start", "predicted_epi")
    predicted = predicted_atoms.join(meta, key).withColumn("is_epitope", F.array_contains("predicted_epi", F.col("res_idx")))
    predicted = predicted.drop("window_start", "predicted_epi")
    side = lambda df, names: df.where(F.col("atom_name").isin(list(BACKBONE))).select(*key, "res_idx", "atom_name", *[F.col(x).alias(n) for x, n in zip(XYZ, names)])
    shifted = design_atoms.join(meta.select(*key, "window_start"), key).withColumn("res_idx", F.col("res_idx") + F.col("window_start"))
    paired = side(shifted, _P).join(side(predicted_atoms, _Q), [*key, "res_idx", "atom_name"])
    paired = paired.join(meta.select(*key, "predicted_epi"), key).withColumn("is_epitope", F.array_contains("predicted_epi", F.col("res_idx")))
    rmsds = kabsch_rmsds(paired, key, {"overall_rmsd": F.lit(True), "epitope_chunk_rmsd": F.col("is_epitope")})
    blocks = pae_blocks(pae.join(good.select(*key, F.col("predicted_epi").alias("epitope_resindices")), key))

    # epitope CA pairs, prediction to native
    index = good.select(*key, "id", F.inline(F.arrays_zip(F.col("predicted_epi").alias("res_idx"), F.col("native_epi").alias("native_idx"))))
    predicted_ca = predicted.where(F.col("atom_name") == "CA")
    native_ca = native_atoms.where((F.col("chain") == "A") & (F.col("atom_name") == "CA"))
    pairs = index.join(predicted_ca.select(*key, "res_idx", *[F.col(x).alias(p) for x, p in zip(XYZ, _P)]), [*key, "res_idx"])
    native_at = native_ca.select("id", F.col("res_idx").alias("native_idx"), *[F.col(x).alias(q) for x, q in zip(XYZ, _Q)])
    pairs = pairs.join(native_at, ["id", "native_idx"])
    to_native = kabsch_transform(pairs, key)

    # designs come to the native, never the other way round: its atoms are indexed once per id
    heavy = lambda df: df.where(F.col("element") != "H")
    scaffold = heavy(predicted).where(~F.col("is_epitope")).select(*key, "id", "res_idx", *XYZ)
    antibody = heavy(native_atoms).where(F.col("chain") != "A").select("id", *XYZ)
    struck = near_points(apply_transform(scaffold, to_native, key, small), antibody, clash_cutoff, ["id"], copied="targets")
    clash = struck.select(*key, "res_idx").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_clash_res"))
    with_ab = antibody.select("id").distinct().withColumn("_ab", F.lit(True))

    # the cylinder stands in the prediction's frame; what is inside it is carved, and counted, in the native's
    frames = plane_frame(predicted_ca.select(*key, *XYZ, "is_epitope"), key)
    scaffold_ca = predicted_ca.where(~F.col("is_epitope")).select(*key, "id", *XYZ)
    inside = in_cylinder(scaffold_ca, frames, key, small=small).where(F.col("inside")).select(*key, "id", *XYZ)
    plain = inside.groupBy(*key).agg(F.count(F.lit(1)).alias("cylinder_ca_clashes"))
    native_heavy = heavy(native_atoms).where(F.col("chain") == "A").select("id", *XYZ)
    kept = carve(apply_transform(inside, to_native, key, small), native_heavy, carve_dist, ["id"], copied="targets")
    aware = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("cylinder_native_aware"))
    standing = frames.join(to_native, key).join(good.select(*key, "id", "native_epi"), key)
    test = native_inside(standing, heavy(native_ca), key, designs.groupBy("id").agg(F.count(F.lit(1)).alias("_designs")))
    counts = frames.select(*key)
    for part in (plain, aware, test):
        counts = counts.join(part, key, "left")
    counts = counts.fillna(0, ["cylinder_ca_clashes", "cylinder_native_aware", "native_in_cylinder"])

    out = base.join(rmsds, key, "left")
    out = out.join(blocks.select(*key, "mean_pae", "epitope_pae", "scaffold_pae"), key, "left")
    out = out.join(to_native.select(*key, F.col("n_pairs")), key, "left").join(with_ab, "id", "left")
    out = out.join(clash, key, "left").join(counts, key, "left")
    aligned = F.col("n_pairs").isNotNull()
    clash_status = (
        F.when(F.col("status") != "ok", "not_run")
        .when(~aligned, "too_few_epitope_pairs")
        .when(F.col("_ab").isNull(), "no_antibody_atoms")
        .otherwise("ok")
    )
    out = out.withColumn("af3_clash_status", clash_status)
    n_clash = F.when(F.col("af3_clash_status") == "ok", F.coalesce("n_clash_res", F.lit(0)))
    return out.select(
        *key,
        "id",
        "status",
        "af3_clash_status",
        F.col("window_start").alias("af3_window_start"),
        "overall_rmsd",
        "epitope_chunk_rmsd",
        "mean_pae",
        "epitope_pae",
        "scaffold_pae",
        n_clash.alias("af3_n_clash_res"),
        (n_clash > 0).alias("af3_has_clash"),
        *[F.when(aligned, F.col(c)).alias(c) for c in ("cylinder_ca_clashes", "cylinder_native_aware", "native_in_cylinder")],
    )


def native_inside(
    frames: DataFrame, native_ca: DataFrame, key: Sequence[str], weights: DataFrame, radius: float = RADIUS, height: float = HEIGHT
) -> DataFrame:
    """``native_in_cylinder``: non-epitope native CAs in each design's cylinder, moved to the native's frame.

    ``frames`` has the frame, the transform to the native, ``id`` and ``native_epi``. The CAs of a native are
    one row, a list no longer than its chain; designs look it up by id and count inside the row. ``weights``
    has the number of designs per id (``_designs``), so that ids with very many are split.
    """
    listed = native_ca.groupBy("id").agg(F.collect_list(F.struct("res_idx", *XYZ)).alias("_cas")).join(weights, "id")
    turn = lambda v: [reduce(lambda a, b: a + b, [F.col(f"r{i}{j}") * v[j] for j in range(3)]) for i in range(3)]
    normal = turn([F.col(f"n{x}") for x in XYZ])
    base = turn([F.col(f"base{x}") for x in XYZ])
    moved = frames.select(
        *key, "id", "native_epi", *[n.alias(f"n{x}") for n, x in zip(normal, XYZ)], *[(b + F.col(f"t{i}")).alias(f"base{x}") for i, (b, x) in enumerate(zip(base, XYZ))]
    )

    def counted(s: Column) -> Column:
        v = [s[x] - F.col(f"base{x}") for x in XYZ]
        n = [F.col(f"n{x}") for x in XYZ]
        proj = v[0] * n[0] + v[1] * n[1] + v[2] * n[2]
        perp = [v[i] - proj * n[i] for i in range(3)]
        across = F.sqrt(perp[0] * perp[0] + perp[1] * perp[1] + perp[2] * perp[2])
        return (proj >= 0) & (proj <= height) & (across <= radius) & ~F.array_contains("native_epi", s["res_idx"])

    met = lookup(moved, listed, ["id"], "inner", weight="_designs", small=False)
    return met.select(*key, F.size(F.filter("_cas", counted)).cast("bigint").alias("native_in_cylinder"))
