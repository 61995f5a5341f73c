"""Unions, cross-component dedupe, disjoint picks and prefixed external columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.operators.ordering import first_per


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """Schema union; a column a part lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def component_priority(order: Sequence[str], column: str = "component") -> Column:
    ranked = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    return F.coalesce(F.try_element_at(ranked, F.col(column)), F.lit(len(order)))


def dedupe_by_sequence(df: DataFrame, order: Sequence[str], key: Sequence[str], seq: str = "sequence") -> DataFrame:
    """One row per sequence: the first component in ``order`` keeps it, then the smallest key."""
    return first_per(df, [seq], [component_priority(order), *key])


def disjoint_rest(pool: DataFrame, taken: DataFrame, key: Sequence[str]) -> DataFrame:
    return pool.join(taken, list(key), "left_anti")


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns])


def same_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key-set check: counts of keys on both sides, only left, only right."""
    left, right = a.select(*key).distinct(), b.select(*key).distinct()
    sides = left.withColumn("l", F.lit(1)).join(right.withColumn("r", F.lit(1)), list(key), "full_outer")
    return sides.agg(
        F.count(F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), 1)).alias("both"),
        F.count(F.when(F.col("r").isNull(), 1)).alias("only_left"),
        F.count(F.when(F.col("l").isNull(), 1)).alias("only_right"),
    )
