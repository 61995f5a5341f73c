"""Atom tables from fixed-width and mmCIF files, and chain sequences from atoms.

Everything is column expressions on text: files are read one row each, since models and mmCIF column
order are stated once per file, and exploded to atoms. Only the first model counts; of alternate
locations of an atom the first in the file stays. A residue is (chain, number, insertion code).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptarium.functions.sequences import residue_letter
from peptarium.operators.ordering import first_per
from peptarium.sinks.files import read_row_files


def stem(path: Column) -> Column:
    """File name without directory and extensions."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(pdb|ent|cif|json)(\.gz)?$", "")


def is_heavy(element: Column, atom_name: Column) -> Column:
    """Not hydrogen, by element or, without one, by atom name."""
    by_name = ~F.regexp_replace(F.trim(atom_name), "^[0-9]+", "").startswith("H")
    return F.when(F.length(F.trim(element)) > 0, ~F.trim(element).isin("H", "D")).otherwise(by_name)


def fixed_width_atoms(lines: DataFrame, text: str = "value", source: str = "design_id") -> DataFrame:
    """ATOM and HETATM lines to atoms; columns as in the fixed-width format."""
    v = F.col(text)
    cut = lambda a, b: F.trim(F.substring(v, a + 1, b - a))
    rows = lines.where(v.startswith("ATOM") | v.startswith("HETATM"))
    atoms = rows.select(
        source,
        cut(21, 22).alias("chain"),
        cut(22, 26).try_cast("int").alias("res_num"),
        cut(26, 27).alias("icode"),
        cut(16, 17).alias("altloc"),
        cut(17, 20).alias("res_name"),
        cut(12, 16).alias("atom_name"),
        cut(76, 78).alias("element"),
        cut(6, 11).try_cast("int").alias("serial"),
        cut(30, 38).try_cast("double").alias("x"),
        cut(38, 46).try_cast("double").alias("y"),
        cut(46, 54).try_cast("double").alias("z"),
    ).withColumn("is_heavy", is_heavy(F.col("element"), F.col("atom_name")))
    return first_location(atoms, source)


def first_location(atoms: DataFrame, source: str) -> DataFrame:
    """Drop further alternate locations of an atom; rows without a location mark are not compared."""
    marked = F.col("altloc") != ""
    site = [source, "chain", "res_num", "icode", "atom_name"]
    return atoms.where(~marked).unionByName(first_per(atoms.where(marked), site, ["serial"])).drop("altloc")


def first_model_atoms(files: DataFrame, text: str = "value", source: str = "design_id") -> DataFrame:
    """Atoms of the first model of whole fixed-width files, one row per file."""
    model = F.element_at(F.split(F.col(text), r"\nENDMDL", 2), 1)
    return fixed_width_atoms(files.select(source, F.explode(F.split(model, r"\r?\n")).alias(text)), text, source)


def read_atoms_fixed_width(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of every file below ``path``, sub-folders included."""
    return first_model_atoms(_texts(spark, path))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(value, design_id) of every file below ``path``, sub-folders included."""
    written = read_row_files(spark, path)
    if written is not None:
        return written.select("value", stem(F.col("name")).alias("design_id"))
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return files.select("value", stem(F.col("_metadata.file_path")).alias("design_id"))


_TOKENS = r"""'[^']*'|"[^"]*"|\S+"""
_ATOM_SITE = r"(?s)loop_\s*\n((?:\s*_atom_site\.\S+[ \t]*\n)+)(.*?)(?=\n\s*(?:_|loop_|data_|#)|\z)"


def mmcif_atoms(files: DataFrame, text: str = "value", source: str = "design_id") -> DataFrame:
    """The ``_atom_site`` loop of each file to atoms, reading column order from its header.

    Author columns win over label columns. Rows with fewer tokens than the header are skipped.
    """
    whole = F.regexp_replace(F.col(text), "\r", "")
    names = F.regexp_extract_all(F.regexp_extract(whole, _ATOM_SITE, 1), F.lit(r"_atom_site\.(\S+)"), F.lit(1))

    def tokens(line: Column) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(_TOKENS), F.lit(0)), lambda t: F.regexp_replace(t, r"""^(['"])(.*)\1$""", "$2"))

    listed = files.select(source, names.alias("_names"), F.split(F.regexp_extract(whole, _ATOM_SITE, 2), "\n").alias("_lines"))
    lead = tokens(F.get(F.filter("_lines", lambda x: F.length(F.trim(x)) > 0), 0))
    located = listed.select(source, "_names", lead.alias("_lead"), F.posexplode("_lines").alias("serial", "_line"))
    whole_rows = located.withColumn("_t", tokens(F.col("_line"))).where((F.size("_names") > 0) & (F.size("_t") >= F.size("_names")))
    model = F.array_position("_names", "pdbx_PDB_model_num").cast("int")
    rows = whole_rows.where((model == 0) | (F.get("_t", model - 1) == F.get("_lead", model - 1)))

    def column(*options: str) -> Column:
        picks = [F.when(F.array_position("_names", o) > 0, F.get("_t", F.array_position("_names", o).cast("int") - 1)) for o in options]
        return F.coalesce(*picks)

    named = lambda *options: F.coalesce(F.nullif(F.nullif(column(*options), F.lit("?")), F.lit(".")), F.lit(""))
    atoms = rows.select(
        source,
        column("auth_asym_id", "label_asym_id").alias("chain"),
        column("auth_seq_id", "label_seq_id").try_cast("int").alias("res_num"),
        named("pdbx_PDB_ins_code").alias("icode"),
        named("label_alt_id").alias("altloc"),
        column("auth_comp_id", "label_comp_id").alias("res_name"),
        column("auth_atom_id", "label_atom_id").alias("atom_name"),
        F.coalesce(column("type_symbol"), F.lit("")).alias("element"),
        "serial",
        column("Cartn_x").try_cast("double").alias("x"),
        column("Cartn_y").try_cast("double").alias("y"),
        column("Cartn_z").try_cast("double").alias("z"),
    ).withColumn("is_heavy", is_heavy(F.col("element"), F.col("atom_name")))
    return first_location(atoms, source)


def read_atoms_mmcif(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of every file below ``path``, sub-folders included."""
    return mmcif_atoms(_texts(spark, path))


def chain_sequences(atoms: DataFrame, source: str = "design_id", order: str = "serial") -> DataFrame:
    """One-letter sequence of every chain: first atom per residue, in file order."""
    number = ["res_num", *(["icode"] if "icode" in atoms.columns else [])]
    residues = atoms.groupBy(source, "chain", *number).agg(F.min(F.struct(order, "res_name")).alias("_f"))
    # the sequence is the output value: one entry per residue of one chain
    placed = residues.select(source, "chain", F.struct(F.col(f"_f.{order}").alias("o"), residue_letter(F.col("_f.res_name")).alias("aa")).alias("_r"))
    grown = placed.groupBy(source, "chain").agg(F.collect_list("_r").alias("_rs"), F.min("_r.o").alias("first_at"))
    text = F.array_join(F.transform(F.array_sort("_rs"), lambda r: r["aa"]), "")
    return grown.select(source, "chain", text.alias("seq"), F.size("_rs").alias("n_res"), "first_at")


def chain_sequence(atoms: DataFrame, chain: str = "A", source: str = "design_id", order: str = "serial") -> DataFrame:
    """The preferred chain of each structure, else the one with most residues (first in the file on a tie)."""
    chains = chain_sequences(atoms, source, order)
    rank = [F.when(F.col("chain") == chain, 0).otherwise(1), F.col("n_res").desc(), F.col("first_at")]
    return first_per(chains, [source], rank).select(source, "chain", "seq", "n_res")
