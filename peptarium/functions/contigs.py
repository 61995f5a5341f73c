"""Contig strings ``N-N/Aa-b/gap/Ac-d/C-C``: flanks and spacers are lengths, ``A`` tokens are islands."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.functions.keys import stable_hash
from peptarium.functions.numeric import as_col, let
from peptarium.operators.ordering import first_per, row_rank, top_k

# Fixed value: the grammar of a contig token.
TOKEN = r"^(A?)(\d+)-(\d+)$"


def contig_tokens(c: str | Column) -> Column:
    """``array<struct<is_island, a, b>>``; any token off the grammar is an error."""
    text = as_col(c)
    bad = F.exists(F.split(text, "/"), lambda t: ~t.rlike(TOKEN))
    tokens = F.transform(
        F.split(text, "/"),
        lambda t: F.struct(
            t.startswith("A").alias("is_island"),
            F.regexp_extract(t, TOKEN, 2).cast("int").alias("a"),
            F.regexp_extract(t, TOKEN, 3).cast("int").alias("b"),
        ),
    )
    return F.when(bad, F.raise_error(F.concat(F.lit("unparseable contig "), text))).otherwise(tokens)


def token_length(t: Column) -> Column:
    return F.when(t["is_island"], t["b"] - t["a"] + 1).otherwise(t["a"])


def contig_length(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0), lambda acc, t: acc + token_length(t))


def contig_positions(c: str | Column) -> Column:
    """Struct(design, native): parallel 0-based epitope positions in the design and in the native chain."""

    def step(acc: Column, t: Column) -> Column:
        n = token_length(t)
        start = acc["offset"]
        return F.struct(
            (start + n).alias("offset"),
            F.when(t["is_island"], F.concat(acc["design"], F.sequence(start, start + n - 1))).otherwise(acc["design"]).alias("design"),
            F.when(t["is_island"], F.concat(acc["native"], F.sequence(t["a"] - 1, t["b"] - 1))).otherwise(acc["native"]).alias("native"),
        )

    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("offset"), empty.alias("design"), empty.alias("native"))
    return F.aggregate(contig_tokens(c), start, step, lambda a: F.struct(a["design"].alias("design"), a["native"].alias("native")))


def segment_positions(segments: Column, sizes: Column) -> Column:
    """0-based motif positions from scaffold segment lengths and island sizes (the last segment trails)."""

    def step(acc: Column, pair: Column) -> Column:
        start = acc["offset"] + pair["seg"]
        size = pair["size"]
        return F.struct((start + size).alias("offset"), F.concat(acc["fixed"], F.sequence(start, start + size - 1)).alias("fixed"))

    paired = F.transform(
        sizes, lambda size, i: F.struct(F.element_at(segments, i + 1).alias("seg"), size.alias("size"))
    )
    start = F.struct(F.lit(0).alias("offset"), F.array().cast("array<int>").alias("fixed"))
    return F.aggregate(paired, start, step, lambda a: a["fixed"])


def comma_contig(c: str | Column) -> Column:
    return F.array_join(F.filter(F.split(as_col(c), "/"), lambda t: t != ""), ",")


def island_targets(df: DataFrame, min_size: int = 2) -> DataFrame:
    """One row per island of each two-island contig, with its size, its partner's size and a keep flag."""
    segments = F.filter(contig_tokens("contig_string"), lambda t: t["is_island"])
    size = lambda t: t["b"] - t["a"] + 1
    rows = df.withColumn("_s", segments).where(F.size("_s") == 2)
    rows = rows.select("id", "contig_string", "_s", F.posexplode("_s").alias("_i", "_t"))
    partner = F.element_at("_s", F.lit(2) - F.col("_i"))
    return rows.select(
        "id",
        "contig_string",
        F.format_string("A%d-%d", F.col("_t.a"), F.col("_t.b")).alias("island"),
        (F.col("_i") + 1).alias("island_index"),
        size(F.col("_t")).alias("island_size"),
        size(partner).alias("partner_size"),
        (size(F.col("_t")) >= min_size).alias("scaffold"),
    )


def shorten_contig(c: str | Column, length: int = 103) -> Column:
    """Struct(contig, where): take one scaffold residue off a contig that is one residue too long.

    The longer terminal flank gives it (C on a tie); when both are empty, the first largest spacer.
    """
    return let(contig_tokens(c), lambda tokens: let(_giving_token(tokens), lambda give: _shortened(as_col(c), tokens, give, length)))


def _giving_token(tokens: Column) -> Column:
    """Struct(index, where) of the token that gives a residue."""
    last = F.size(tokens) - 1
    flank = lambda i: F.when(~F.get(tokens, i)["is_island"], F.get(tokens, i)["a"]).otherwise(F.lit(-1))
    n_flank, c_flank = flank(F.lit(0)), flank(last)
    inner = F.filter(
        F.transform(
            tokens,
            lambda t, i: F.struct(t["a"].alias("len"), (-i).alias("neg"), ((i > 0) & (i < last) & ~t["is_island"]).alias("inner")),
        ),
        lambda s: s["inner"] & (s["len"] >= 1),
    )
    spacer = -F.array_max(inner)["neg"]
    at_c, at_n = (c_flank >= 1) & (c_flank >= n_flank), n_flank >= 1
    return F.struct(
        F.when(at_c, last).when(at_n, F.lit(0)).otherwise(spacer).alias("index"),
        F.when(at_c, F.lit("C")).when(at_n, F.lit("N")).otherwise(F.concat(F.lit("spacer@"), spacer.cast("string"))).alias("where"),
    )


def _shortened(text: Column, tokens: Column, give: Column, length: int) -> Column:
    left = lambda t, i: t["a"] - (i == give["index"]).cast("int")
    edited = F.array_join(
        F.transform(
            tokens,
            lambda t, i: F.when(t["is_island"], F.format_string("A%d-%d", t["a"], t["b"])).otherwise(F.format_string("%d-%d", left(t, i), left(t, i))),
        ),
        "/",
    )
    ok = (contig_length(tokens) == length + 1) & give["index"].isNotNull()
    message = F.concat(F.lit("cannot shorten contig "), text)
    return F.when(ok, F.struct(edited.alias("contig"), give["where"].alias("where"))).otherwise(F.raise_error(message))


def expand_contigs(df: DataFrame, seeds: Sequence[int], reps: int, id_col: str = "id") -> DataFrame:
    """One row per unique contig, seed and replicate, under a stable ``design_id``."""
    unique = first_per(df, [id_col, "contig_id"], ["contig_string"])
    runs = F.array(*[F.lit(int(s)) for s in seeds])
    out = unique.withColumn("seed", F.explode(runs)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    return out.withColumn(
        "design_id", F.format_string("%s__contig%d__seed%d__rep%d", F.col(id_col).cast("string"), "contig_id", "seed", "rep")
    ).withColumn("contig_rfd3", comma_contig("contig_string"))


def flank_variants(
    df: DataFrame, variants: int, length: int = 103, min_size: int = 2, seed: int = 0, whole_island: bool = False
) -> DataFrame:
    """Single-island contigs of each two-island epitope, with distinct hash-picked N flanks.

    One variant centres the island. Fixed residues are the contacts inside the island.
    """
    segments = F.filter(contig_tokens("contig_string"), lambda t: t["is_island"])
    rows = first_per(df, ["id"], ["contig_string"]).withColumn("_s", segments).where(F.size("_s") == 2)
    rows = rows.select("id", "epitope_resindices", F.posexplode("_s").alias("island_index", "_t"))
    rows = rows.select("id", "epitope_resindices", "island_index", F.col("_t.a").alias("a"), F.col("_t.b").alias("b"))
    rows = rows.withColumn("island_size", F.col("b") - F.col("a") + 1).where(F.col("island_size") >= min_size)
    budget = F.lit(length) - F.col("island_size")
    if variants <= 1:
        picked = rows.withColumn("n_flank", F.floor(budget / 2).cast("int"))
    else:
        spread = F.array_sort(
            F.transform(
                F.sequence(F.lit(1), budget - 1),
                lambda n: F.struct(stable_hash("id", "island_index", n, seed=seed).alias("h"), n.alias("n")),
            )
        )
        # the pool is at most `length` placements per island, so sorting it in the row is bounded
        picked = rows.withColumn("n_flank", F.explode(F.array_sort(F.transform(F.slice(spread, 1, variants), lambda s: s["n"]))))
    # at most 2 islands x `length` placements per id
    by_island = Window.partitionBy("id", "island_index").orderBy("n_flank")
    by_id = Window.partitionBy("id").orderBy("island_index", "n_flank")
    inside = F.filter("epitope_resindices", lambda x: (x >= F.col("a") - 1) & (x <= F.col("b") - 1))
    fixed = F.sequence(F.col("a") - 1, F.col("b") - 1) if whole_island else F.array_sort(inside)
    out = (
        picked.withColumn("c_flank", budget - F.col("n_flank"))
        .withColumn("variant", F.row_number().over(by_island) - 1)
        .withColumn("contig_id", F.row_number().over(by_id) - 1)
        .withColumn("fixed", fixed)
    )
    return out.select(
        "id",
        "contig_id",
        F.format_string("%d-%d/A%d-%d/%d-%d", "n_flank", "n_flank", "a", "b", "c_flank", "c_flank").alias("contig_string"),
        F.lit(f"{length}-{length}").alias("contig_length"),
        F.col("fixed").alias("epitope_resindices"),
        F.lit(1).alias("epitope_chunks"),
        F.format_string("A%d-%d", "a", "b").alias("island_segment"),
        "island_index",
        "island_size",
        "variant",
        "n_flank",
        "c_flank",
        F.size("fixed").alias("n_fixed"),
    )


def contig_ledger(df: DataFrame, length: int = 103) -> DataFrame:
    """Unique contigs of each id in order, shortened to ``length`` and numbered from 0."""
    unique = first_per(df, ["id", "contig_string"], ["epitope_chunks"])
    numbered = row_rank(unique, ["id"], [F.col("contig_string")], out="_n")
    edit = shorten_contig("contig_string", length)
    out = numbered.withColumn("_edit", edit).withColumn("epitope_resindices", F.array_sort("epitope_resindices"))
    return out.select(
        "id",
        (F.col("_n") - 1).cast("int").alias("contig_id"),
        F.col("_edit.contig").alias("contig_string"),
        F.lit(f"{length}-{length}").alias("contig_length"),
        "epitope_resindices",
        "epitope_chunks",
        F.col("contig_string").alias("orig_contig_string"),
        F.col("_edit.where").alias("length_edit"),
        F.size("epitope_resindices").alias("n_fixed"),
    )


def composition(rank: int, parts: int, room: int) -> list[int]:
    """The ``rank``-th way, in ascending order, to write ``room`` as ``parts`` whole numbers from 0."""
    out = []
    for left in range(parts - 1, 0, -1):
        value = 0
        while rank >= (ways := math.comb(room - value + left - 1, left - 1)):
            rank -= ways
            value += 1
        out.append(value)
        room -= value
    return [*out, room]


def ranked_compositions(parts: int, room: int, n: int, first: int, second: int) -> list[list[int]]:
    """min(n, how many there are) different compositions, picked by a seeded permutation of their ranks.

    Ranks are ``start, start + step, ...`` modulo their number, with a step that has no divisor in common
    with it; both come from the hashes ``first`` and ``second``.
    """
    total = math.comb(room + parts - 1, parts - 1)
    start, step = first % total, total // 4 + 1 + second % (total // 2 + 1)
    while math.gcd(step, total) != 1:
        step += 1
    return [composition((start + k * step) % total, parts, room) for k in range(min(n, total))]


def compositions(
    targets: DataFrame,
    n: int,
    length: int = 103,
    min_each: int = 3,
    seed: int = 0,
    chain: str = "C",
    native_gaps: bool = False,
) -> DataFrame:
    """``n`` distinct random contigs per target row (``target``, ``islands array<struct<a,b>>``), all there are if fewer.

    Free residues are split into scaffold segments; every split has a rank, and a seeded permutation of the
    ranks says which are taken. With ``native_gaps`` the spacing between islands is kept and only the two
    flanks vary.
    """
    sizes = F.transform("islands", lambda i: i["b"] - i["a"] + 1)
    motif = F.aggregate(sizes, F.lit(0), lambda a, s: a + s)
    gaps = F.transform(
        F.slice("islands", 2, F.greatest(F.size("islands") - 1, F.lit(0))),
        lambda i, k: i["a"] - F.get("islands", k)["b"] - 1,
    )
    kept = F.aggregate(gaps, F.lit(0), lambda a, g: a + g) if native_gaps else F.lit(0)
    parts = F.lit(2) if native_gaps else F.size("islands") + 1
    room = F.lit(length) - motif - kept - parts * min_each

    @F.pandas_udf("array<array<int>>")
    def picks(parts: pd.Series, room: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        rows = zip(parts.tolist(), room.tolist(), first.tolist(), second.tolist(), strict=True)
        return pd.Series([ranked_compositions(p, r, n, a, b) for p, r, a, b in rows])

    fitting = F.when(room < 0, F.raise_error(F.lit("segments do not fit the length"))).otherwise(room)
    start, step = (stable_hash("target", F.lit(name), seed=seed) for name in ("start", "step"))
    draws = targets.withColumns({"_parts": parts, "_gaps": gaps, "_room": fitting})
    draws = draws.withColumn("_all", picks("_parts", "_room", start, step))
    draws = draws.select("*", F.posexplode("_all").alias("contig_id", "_cut")).drop("_all")
    draws = draws.withColumn("_free", F.transform("_cut", lambda x: x + min_each))
    segs = F.concat(F.slice("_free", 1, 1), F.col("_gaps"), F.slice("_free", 2, 1)) if native_gaps else F.col("_free")
    draws = draws.withColumn("scaffold_segs", segs)
    pieces = F.flatten(
        F.transform(
            "islands",
            lambda i, k: F.array(
                F.concat(F.lit(chain), i["a"].cast("string"), F.lit("-"), i["b"].cast("string")),
                F.format_string("%d-%d", F.get("scaffold_segs", k + 1), F.get("scaffold_segs", k + 1)),
            ),
        )
    )
    first = F.format_string("%d-%d", F.get("scaffold_segs", F.lit(0)), F.get("scaffold_segs", F.lit(0)))
    draws = draws.withColumn("contig_string", F.array_join(F.concat(F.array(first), pieces), ","))
    return draws.select(
        "contig_id",
        "target",
        F.lit(chain).alias("chain"),
        "contig_string",
        F.array_join(F.col("scaffold_segs").cast("array<string>"), ",").alias("scaffold_segs"),
        F.array_join(F.transform("islands", lambda i: F.format_string("%d-%d", i["a"], i["b"])), ";").alias("islands"),
        F.lit(length).alias("total_len"),
    )
