"""Tables by suffix, headerless pairs, codon weights, external generations, wide assays."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peptarium.operators.ordering import first_per


def read_table(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """``.parquet``, ``.csv`` or ``.csv.gz``. CSV without a schema is read as text columns."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith((".csv", ".csv.gz")):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ValueError(f"unknown table suffix: {path}")


def read_named_peptides(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``name,seq``; a line with another number of fields is an error."""
    return spark.read.schema("name string, seq string").option("mode", "FAILFAST").csv(path)


def read_codon_weights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("aa string, codon string, weight double, `index` int").option("mode", "FAILFAST").csv(path)


def keep_passing(df: DataFrame, column: str = "passes") -> DataFrame:
    """Rows whose flag reads true or 1 in any spelling."""
    return df.where(F.lower(F.trim(F.col(column).cast("string"))).isin("true", "1"))


def read_passing(spark: SparkSession, path: str, column: str = "passes") -> DataFrame:
    kept = keep_passing(read_table(spark, path), column)
    if kept.isEmpty():
        raise ValueError(f"no passing rows in {path}")
    return kept


def ledger_sequences(df: DataFrame, id_col: str, seq_col: str, dedupe: str = "seq") -> DataFrame:
    """(id, seq) without nulls, one row per sequence or per id (the smallest partner is kept)."""
    pairs = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq")).dropna()
    one, other = ("seq", "id") if dedupe == "seq" else ("id", "seq")
    return first_per(pairs, [one], [other]).select("id", "seq")


def assay_columns(df: DataFrame) -> tuple[dict[str, str], str]:
    """({antibody: signal column}, baseline column) of a wide assay table."""
    found = {m.group(1): c for c in df.columns if (m := re.match(r"^X([0-9a-z]{4})_", c))}
    baseline = [c for c in df.columns if c.startswith("NoAb")]
    if len(baseline) != 1:
        raise ValueError(f"expected one NoAb column, got {baseline}")
    return found, baseline[0]


def assay_map(*runs: DataFrame) -> dict[str, tuple[str, str]]:
    """{antibody: (signal column, that run's baseline column)} over several runs."""
    out: dict[str, tuple[str, str]] = {}
    for run in runs:
        signals, baseline = assay_columns(run)
        out.update({ab: (column, baseline) for ab, column in signals.items()})
    return out
