"""Prediction outputs: error matrices, summary scalars, and an index of artifact files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptarium.functions.numeric import as_col, num
from peptarium.operators.ordering import first_per
from peptarium.sinks.files import read_row_files
from peptarium.sources.structures import stem

# Names the matrix goes by, in order of preference.
MATRIX_KEYS = ("pae", "predicted_aligned_error", "predicted_aligned_error_matrix")


def pae_matrix(c: str | Column) -> Column:
    """The error matrix of a JSON document under the first key that holds a 2-D array, else null."""
    text = as_col(c)
    picks = []
    for key in MATRIX_KEYS:
        raw = F.get_json_object(text, f"$.{key}")
        picks.append(F.when(raw.rlike(r"^\s*\[\s*\["), F.from_json(raw, "array<array<double>>")))
    return F.coalesce(*picks)


def whole_files(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """(value, path) of the files below ``path`` whose name matches ``wanted``, sub-folders included."""
    written = read_row_files(spark, path)
    if written is not None:
        return written.where(F.col("name").rlike(wanted)).select("value", "path")
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    named = files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("_name"))
    return named.where(F.col("_name").rlike(wanted)).drop("_name")


def readable(df: DataFrame, ok: Column, bad: str) -> DataFrame:
    """What to do with files that hold no usable value: ``null`` keeps their row, ``drop`` leaves it out, ``fail`` stops."""
    if bad == "drop":
        return df.where(ok)
    if bad == "fail":
        return df.where(ok | F.raise_error(F.concat(F.lit("unreadable file: "), F.col("path"))).cast("boolean"))
    if bad != "null":
        raise ValueError(f"unknown policy: {bad!r}")
    return df


def read_pae(spark: SparkSession, path: str, bad: str = "null") -> DataFrame:
    """(design_id, pae) of every full confidence file below ``path``; summary files never count."""
    full = whole_files(spark, path, r"\.json$").where(~F.element_at(F.split("path", "/"), -1).contains("summary"))
    name = F.regexp_replace(stem(F.col("path")), "_(full_)?confidences$", "")
    rows = full.select("path", name.alias("design_id"), pae_matrix("value").alias("pae"))
    return readable(rows, F.col("pae").isNotNull(), bad).drop("path")


def summary_scalars(c: str | Column) -> Column:
    """Struct of the summary scalars; any value that is no number is null."""
    text = as_col(c)
    value = lambda path: num(F.get_json_object(text, path))
    clash = F.get_json_object(text, "$.has_clash")
    clash = F.when(F.lower(clash) == "true", 1.0).when(F.lower(clash) == "false", 0.0).otherwise(num(clash))
    nested = F.get_json_object(text, "$.chain_pair_pae_min")
    pair = F.when(nested.startswith("[["), value("$.chain_pair_pae_min[0][0]")).otherwise(num(nested))
    return F.struct(
        value("$.ptm").alias("ptm"),
        value("$.ranking_score").alias("ranking_score"),
        value("$.fraction_disordered").alias("fraction_disordered"),
        clash.alias("has_clash_af3"),
        pair.alias("chain_pair_pae_min"),
    )


def read_summary_scalars(spark: SparkSession, path: str, bad: str = "null") -> DataFrame:
    """(design_id, the scalars) of every summary file below ``path``; a file that is no JSON object is bad."""
    files = whole_files(spark, path, r"summary.*\.json$")
    name = F.regexp_replace(stem(F.col("path")), "_summary_confidences$", "")
    rows = files.select("path", name.alias("design_id"), summary_scalars("value").alias("s"), F.json_object_keys("value").isNotNull().alias("_ok"))
    return readable(rows, F.col("_ok"), bad).select("design_id", "s.*")


def index_paths(paths: DataFrame, key_regex: str, keys: Sequence[str], prefer: Sequence[Column] = ()) -> DataFrame:
    """One path per key parsed from the file name; ``prefer`` orders the candidates, then the path does."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = paths.where(name.rlike(key_regex)).withColumns(
        {k: F.lower(F.regexp_extract(name, key_regex, i + 1)) for i, k in enumerate(keys)}
    )
    return first_per(rows, list(keys), [*prefer, F.col("path")]).select(*keys, "path")


def index_artifacts(spark: SparkSession, root: str, key_regex: str, keys: Sequence[str], prefer: Sequence[Column] = ()) -> DataFrame:
    """Index files below ``root``; file contents are pruned from the scan."""
    files = read_row_files(spark, root, content=False)
    if files is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.select("path")
    return index_paths(files, key_regex, keys, prefer)
