"""Mixing sources by temperature.

Source token shares p are raised to an exponent in [0, 1] and normalised: 1 keeps the natural mix, 0 makes
all sources equal. The exponent is found by bisection (cut into ``GRID`` parts a pass, each pass one
aggregate over the source table) so that the mix has a target entropy, or is as flat as a repetition limit
allows. The weights times the token budget are then realised per source: whole passes over all its
documents, and for the rest a permutation of the source's blocks by a seeded hash, taken in order until the
budget is used; only the block at the edge is cut, inside it in hash order.

Without a budget the mix takes the least one under which every source gets one full pass, so nothing is
dropped and only small sources repeat.

Defined cases: a null source is a source of its own; null, empty and blank texts have no tokens and come
along with every whole pass of their source, or once if the source has no tokens at all; repeated rows are
rows of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.llm.common import id_key, stored

GRID, PASSES = 32, 5
BLOCKS = 1024
SEED = 17
MAX_EPOCHS = 2.0



def n_tokens(text: Column) -> Column:
    """Words between white space, counted without splitting: a word starts where the text or a space ends."""
    squeezed = F.regexp_replace(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r")), "[\\x09-\\x0D]", " ")
    single = F.regexp_replace(squeezed, " {2,}", " ")
    return F.when(F.length(single) == 0, F.lit(0)).otherwise(F.length(single) - F.length(F.replace(single, F.lit(" "), F.lit(""))) + 1).cast("long")


@dataclass(frozen=True)
class Temperature:
    exponent: float
    partition: float  # sum of p ** exponent
    entropy: float
    least_lift: float  # smallest and largest weight over natural share
    most_lift: float


def temperatures(sizes: DataFrame, exponents: list[float]) -> list[Temperature]:
    """What each exponent gives, in one aggregate over (source, tokens)."""
    live = sizes.where("tokens > 0")
    total = live.agg(F.sum("tokens")).first()[0]
    if not total:
        return [Temperature(a, 1.0, 0.0, 1.0, 1.0) for a in exponents]
    p, a = F.col("tokens") / F.lit(float(total)), F.col("a")
    w = F.pow(p, a)
    sums = (
        live.withColumn("a", F.explode(F.array(*map(F.lit, exponents))))
        .groupBy("a")
        .agg(F.sum(w).alias("z"), F.sum(w * a * F.log(p)).alias("s"), F.min(w / p).alias("lo"), F.max(w / p).alias("hi"))
    )
    return [
        Temperature(r["a"], r["z"], math.log(r["z"]) - r["s"] / r["z"], r["lo"] / r["z"], r["hi"] / r["z"]) for r in sorted(sums.collect())
    ]


def find_temperature(
    sizes: DataFrame, target_entropy: float | None = None, max_epochs: float | None = MAX_EPOCHS, budget_share: float | None = None
) -> Temperature:
    """The least exponent that meets every given condition; both conditions get easier as it grows.

    ``target_entropy``: entropy (nats) at most this. ``max_epochs``: no source is passed over more often,
    at a budget of ``budget_share`` times all tokens (None: the least budget giving each source a pass).
    """

    def meets(t: Temperature) -> bool:
        budget = 1 / t.least_lift if budget_share is None else budget_share
        return (target_entropy is None or t.entropy <= target_entropy) and (max_epochs is None or budget * t.most_lift <= max_epochs)

    low, high = 0.0, 1.0
    found = None
    for _ in range(PASSES):
        grid = [low + (high - low) * k / GRID for k in range(GRID + 1)]
        tried = temperatures(sizes, grid)
        ok = next((i for i, t in enumerate(tried) if meets(t)), None)
        if ok is None:
            return tried[-1]  # the natural mix comes closest
        found = tried[ok]
        if ok == 0:
            break
        low, high = grid[ok - 1], grid[ok]
    return found


def mix(
    docs: DataFrame,
    target_entropy: float | None = None,
    max_epochs: float | None = MAX_EPOCHS,
    budget_tokens: int | None = None,
    seed: int = SEED,
    blocks: int = BLOCKS,
) -> DataFrame:
    """``docs`` (less columns of the three new names) with each row as often as the mix takes it, and ``mix_epoch`` (from 1), ``mix_block`` (the place
    of its block in the source's permutation, from 1) and ``mix_weight``.

    Only narrow rows (id, row hash, source, tokens) are counted, numbered and joined by source; the
    documents are met once, by id.
    """
    narrow = stored(
        docs.select(
            id_key().alias("_id"), F.xxhash64("text").alias("_row"), F.col("source").alias("_source"), n_tokens(F.col("text")).alias("_tokens")
        ).withColumn("_h", F.xxhash64(F.lit(seed), "_source", "_id", "_row"))
        .withColumn("_block", F.pmod("_h", F.lit(blocks)).cast("int")),
        "mix",
    )
    by_block = stored(narrow.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_in")), "mix-blocks")
    sizes = by_block.groupBy("_source").agg(F.sum("_in").alias("tokens"))
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    share = budget_tokens / total if budget_tokens is not None and total else None
    t = find_temperature(sizes, target_entropy, max_epochs, share)
    budget = float(budget_tokens) if budget_tokens is not None else total / t.least_lift

    p = F.col("tokens") / F.lit(max(total, 1))
    quotas = (
        sizes.withColumn("mix_weight", F.when(F.col("tokens") > 0, F.pow(p, F.lit(t.exponent)) / t.partition).otherwise(F.lit(0.0)))
        # the small term keeps a full pass whole when a quotient falls a rounding error below it
        .withColumn("_passes", F.when(F.col("tokens") > 0, F.floor(F.col("mix_weight") * budget / F.col("tokens") + 1e-9)).otherwise(F.lit(1)))
        .withColumn("_rest", F.greatest(F.lit(0.0), F.col("mix_weight") * budget - F.col("_passes") * F.col("tokens")))
    )
    order = Window.partitionBy("_source").orderBy(F.xxhash64(F.lit(seed), F.lit("block"), "_block"), "_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    dealt = (  # one row per source and block: bounded by ``blocks`` rows per source
        null_safe(by_block, quotas, "_source")
        .withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .withColumn("_room", F.col("_rest") - F.col("_before"))
        .withColumn("mix_block", F.row_number().over(order))
        .select("_source", "_block", "_in", "_room", "_passes", "mix_weight", "mix_block")
    )
    dealt = dealt.withColumnRenamed("_source", "_s").withColumnRenamed("_block", "_b")
    rows = narrow.join(dealt, F.expr("_block = _b and _source <=> _s"))
    edge = rows.where("_room > 0 and _room < _in")
    inside = Window.partitionBy("_source", "_block").orderBy("_h", "_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = edge.withColumn("_more", (F.sum("_tokens").over(inside) <= F.col("_room")).cast("int"))
    whole = rows.where("not (_room > 0 and _room < _in)").withColumn("_more", F.when((F.col("_room") >= F.col("_in")) & (F.col("_in") > 0), 1).otherwise(0))
    taken = (
        whole.unionByName(cut)
        .withColumn("_copies", (F.col("_passes") + F.col("_more")).cast("int"))
        .groupBy("_id", "_row", "_source")  # repeated rows share a hash, hence a fate
        .agg(F.max("_copies").alias("_copies"), F.max("mix_weight").alias("mix_weight"), F.max("mix_block").alias("mix_block"))
        .where("_copies > 0")
        .withColumnRenamed("_source", "_s")
    )
    wide = docs.select(F.struct(*docs.columns).alias("_doc"), id_key().alias("_id"), F.xxhash64("text").alias("_row"), F.col("source").alias("_source"))
    met = wide.join(taken, (wide["_id"] == taken["_id"]) & (wide["_row"] == taken["_row"]) & wide["_source"].eqNullSafe(taken["_s"]))
    keep = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ("mix_epoch", "mix_block", "mix_weight")]
    return met.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*keep, "mix_epoch", "mix_block", "mix_weight")


def null_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    other = right.withColumnRenamed(key, "_other")
    return left.join(other, left[key].eqNullSafe(other["_other"])).drop("_other")
