"""Writers for tables, peptide lists, order files and JSON payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from peptarium.functions.contigs import comma_contig
from peptarium.functions.keys import number_from_text
from peptarium.sinks.files import drop_partition, read_row_files, write_row_files


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (ArrayType, MapType, StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_dual(df: DataFrame, out: str) -> None:
    """``<out>.parquet`` and ``<out>.csv``; the CSV is written from the parquet, not recomputed."""
    df.write.mode("overwrite").parquet(f"{out}.parquet")
    flat(df.sparkSession.read.parquet(f"{out}.parquet")).write.mode("overwrite").option("header", True).csv(f"{out}.csv")


def write_gz(df: DataFrame, out: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(out)


def write_named_peptides(df: DataFrame, out: str) -> None:
    """Headerless ``name,seq`` with LF line ends; a carriage return in the data is an error."""
    rows = df.select("name", "seq")
    if not rows.where(F.col("name").contains("\r") | F.col("seq").contains("\r")).isEmpty():
        raise ValueError("carriage return in peptide rows")
    rows.write.mode("overwrite").option("header", False).option("lineSep", "\n").csv(out)


def write_pairs(df: DataFrame, out: str, columns: Sequence[str], header: bool = True) -> None:
    """Two-column order or quote file."""
    df.select(*columns).write.mode("overwrite").option("header", header).option("lineSep", "\n").csv(out)


def write_order(df: DataFrame, out: str, oligo_header: str = "nucleotide_encoding_with_adapters", header: bool = True) -> None:
    write_pairs(df.select(F.col("id").alias("Seq ID"), F.col("oligo").alias(oligo_header)), out, ["Seq ID", oligo_header], header)


def write_quote(df: DataFrame, out: str, header: bool = True) -> None:
    write_pairs(df, out, ["name", "sequence"], header)


def write_component(df: DataFrame, out: str, component: str, mode: str = "rebuild") -> None:
    """Write one component's block: ``append`` adds rows, ``rebuild`` replaces that block only.

    Row counts come from the write itself: a block rebuilt from no rows is removed.
    """
    if mode not in ("append", "rebuild"):
        raise ValueError(f"unknown mode: {mode!r}")
    seen = Observation()
    rows = df.observe(seen, F.count(F.lit(1)).alias("n")).withColumn("component", F.lit(component)).write.partitionBy("component")
    if mode == "append":
        rows.mode("append").parquet(out)
        return
    rows.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(out)
    if not seen.get["n"]:  # dynamic overwrite leaves partitions it does not write
        drop_partition(out, "component", component)


def fixed_atoms(c: str | Column) -> Column:
    """0-based residue indices to ``{A<i+1>: BKBN}``; negative indices are skipped."""
    idx = F.filter(F.col(c) if isinstance(c, str) else c, lambda i: i >= 0)
    return F.map_from_entries(F.transform(F.array_distinct(idx), lambda i: F.struct(F.concat(F.lit("A"), (i + 1).cast("string")), F.lit("BKBN"))))


def json_specs(df: DataFrame, input_col: str = "input_pdb", contig_col: str = "contig_string", indices: str = "epitope_resindices") -> DataFrame:
    """(design_id, json): one generation request per design under its own id as key."""
    length = number_from_text("contig_length").cast("string")
    body = F.struct(
        F.col(input_col).alias("input"),
        comma_contig(contig_col).alias("contig"),
        F.concat(length, F.lit("-"), length).alias("length"),
        fixed_atoms(indices).alias("select_fixed_atoms"),
        F.lit(False).alias("select_unfixed_sequence"),
    )
    return df.select("design_id", F.to_json(F.create_map(F.col("design_id"), body)).alias("json"))


def sequence_payload(df: DataFrame, seed: int = 1, name: str = "name", seq: str = "seq") -> DataFrame:
    """(name, json): one prediction request per sequence, with a stub alignment of the query alone."""
    msa = F.concat(F.lit(">query\n"), F.col(seq), F.lit("\n"))
    protein = F.struct(
        F.lit("A").alias("id"),
        F.col(seq).alias("sequence"),
        msa.alias("unpairedMsa"),
        msa.alias("pairedMsa"),
        F.array().cast("array<string>").alias("templates"),
    )
    body = F.struct(
        F.col(name).alias("name"),
        F.array(F.lit(seed)).alias("modelSeeds"),
        F.array(F.struct(protein.alias("protein"))).alias("sequences"),
        F.lit("alphafold3").alias("dialect"),
        F.lit(1).alias("version"),
    )
    return df.select(F.col(name).alias("name"), F.to_json(body).alias("json"))


def write_json_files(df: DataFrame, out: str, key: str) -> DataFrame:
    """Write (key, json) as one ``<key>.json`` each and return the (key, path) manifest of what is there."""
    write_row_files(df.select(F.concat(F.col(key).cast("string"), F.lit(".json")), "json"), out)
    found = read_row_files(df.sparkSession, out, content=False)
    if found is None:  # no row, no file
        return df.sparkSession.createDataFrame([], f"{key} string, path string")
    return found.select(F.regexp_extract("name", r"^(.+)\.json$", 1).alias(key), "path")


def emit_json_specs(df: DataFrame, out: str) -> DataFrame:
    return write_json_files(json_specs(df), out, "design_id")


def emit_sequence_payload(df: DataFrame, out: str, seed: int = 1) -> DataFrame:
    return write_json_files(sequence_payload(df, seed), out, "name")
