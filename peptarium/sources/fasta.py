"""FASTA records and their headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptarium.functions.numeric import as_col

# Short organism names.
ORGANISM_SHORT = {"Homo sapiens": "human", "Mus musculus": "mouse", "Rattus norvegicus": "rat"}


def fasta_records(df: DataFrame, text: str = "value") -> DataFrame:
    """Records, cut where a line starts with ``>``, to (id, header, seq). Other ``>`` belong to their line.

    Further columns of ``df`` stay.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r", ""), r"^\s*>", "")
    lines = F.split(clean, "\n")
    header = F.trim(F.element_at(lines, 1))
    seq = F.regexp_replace(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), ""), r"\s", "")
    rows = df.where(F.length(F.trim(clean)) > 0)
    more = [c for c in df.columns if c != text]
    return rows.select(F.element_at(F.split(header, r"\s+"), 1).alias("id"), header.alias("header"), seq.alias("seq"), *more)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Multi-record FASTA; the reader itself cuts the files before each record so large files stay splittable.

    ``file`` names the file of a record and ``record`` sorts records of a file in file order.
    """
    lines = spark.read.option("lineSep", "\n>").text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return fasta_records(lines.select("value", F.col("_metadata.file_path").alias("file"), place.alias("record")))


def fasta_header_fields(c: str | Column) -> Column:
    """Struct(protein, organism): fields 3 and 4 of a ``|`` header, empty when absent."""
    parts = F.split(as_col(c), r"\|")
    field = lambda i: F.trim(F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")))
    return F.struct(field(3).alias("protein"), field(4).alias("organism"))


def organism_short(c: str | Column) -> Column:
    base = F.trim(F.element_at(F.split(as_col(c), r"\("), 1))
    known = F.create_map(*[F.lit(x) for pair in ORGANISM_SHORT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, base), F.replace(base, F.lit(" "), F.lit("_")))
