"""Contiguous numbering, flat labels and runs of neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.operators.ordering import row_rank, running_total


def number_members(df: DataFrame, order: Sequence[Column | str], prefix: str = "LIB_", out: str = "library_member", small: bool | None = None, rows: int | None = None) -> DataFrame:
    """``<prefix>1 .. <prefix>N`` over the whole table without gaps, in the given total order."""
    numbered = row_rank(df, [], order, out="_n", small=small, rows=rows)
    return numbered.withColumn(out, F.concat(F.lit(prefix), F.col("_n").cast("string"))).drop("_n")


def quote_names(df: DataFrame, width: int, prefix: str = "LIB_", member: str = "library_member", out: str = "name") -> DataFrame:
    """Zero-padded label from the member number; ``width`` is at least 5."""
    number = F.regexp_extract(F.col(member), r"(\d+)$", 1)
    width = max(5, width)
    padded = F.when(F.length(number) >= width, number).otherwise(F.lpad(number, width, "0"))
    return df.withColumn(out, F.concat(F.lit(prefix), padded))


def runs(df: DataFrame, groups: Sequence[str], position: str) -> DataFrame:
    """Runs of consecutive distinct integers: start, end and size per run."""
    distinct = df.select(*groups, position).distinct()
    ranked = running_total(distinct, groups, [F.col(position)], out="_r")
    return (
        ranked.groupBy(*groups, (F.col(position) - F.col("_r")).alias("_run"))
        .agg(F.min(position).alias("run_start"), F.max(position).alias("run_end"), F.count(F.lit(1)).alias("run_size"))
        .drop("_run")
    )
