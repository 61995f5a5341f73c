"""Source and sink queries: tables are written from the driver tables and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from peptarium.catalog import REGISTRY
from peptarium.catalog.views import CONTIGS_SQL, POINTS_SQL, SEQS_SQL, contigs, points, r6, seqs, table
from peptarium.session import shared_scratch
from peptarium.sinks import tables as K
from peptarium.sinks.files import write_row_files
from peptarium.sources import fasta, outputs, structures
from peptarium.sources import tables as T

ORDER_COLUMNS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders"


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@REGISTRY.add("s1_read_parquet", ORDERS_SQL)
def read_parquet(spark, sf):
    return T.read_table(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@REGISTRY.add("s1_read_csv", ORDERS_SQL)
def read_csv(spark, sf):
    out = f"{shared_scratch(spark, 'orders')}.csv"
    _orders(spark, sf).write.option("header", True).csv(out)
    return T.read_table(spark, out, ORDER_COLUMNS)


@REGISTRY.add("k5_gzip_export", ORDERS_SQL)
def gzip_export(spark, sf):
    out = f"{shared_scratch(spark, 'orders')}.csv.gz"
    K.write_gz(_orders(spark, sf), out)
    return T.read_table(spark, out, ORDER_COLUMNS)


@REGISTRY.add("s2_named_peptides", f"WITH {SEQS_SQL} SELECT source || '_' || id AS name, seq FROM seqs WHERE seq <> ''")
def named_peptides(spark, sf):
    out = shared_scratch(spark, "peptides")
    rows = seqs(spark, sf).where("seq <> ''")
    K.write_named_peptides(rows.select(F.concat("source", F.lit("_"), "id").alias("name"), "seq"), out)
    return T.read_named_peptides(spark, out)


@REGISTRY.add("k2_named_peptide_lines", f"WITH {SEQS_SQL} SELECT source || '_' || id || ',' || seq AS line FROM seqs WHERE seq <> ''")
def named_peptide_lines(spark, sf):
    out = shared_scratch(spark, "peptides")
    rows = seqs(spark, sf).where("seq <> ''")
    K.write_named_peptides(rows.select(F.concat("source", F.lit("_"), "id").alias("name"), "seq"), out)
    return spark.read.text(out).select(F.col("value").alias("line"))


@REGISTRY.add("s3_read_fasta", f"WITH {SEQS_SQL} SELECT id || '_1>A|Chain' AS id, lang AS protein, source AS organism, seq FROM seqs")
def read_fasta(spark, sf):
    out = shared_scratch(spark, "fasta")
    s = seqs(spark, sf)
    header = F.concat(F.lit(">"), "id", F.lit("_1>A|Chain A|"), "lang", F.lit("|"), "source")
    wrapped = F.array_join(F.regexp_extract_all("seq", F.lit(".{1,60}"), F.lit(0)), "\n")
    s.select(F.concat(header, F.lit("\n"), wrapped).alias("value")).write.text(out)
    rows = fasta.read_fasta(spark, out)
    return rows.select("id", fasta.fasta_header_fields("header").alias("h"), "seq").select("id", "h.protein", "h.organism", "seq")


@REGISTRY.add(
    "s4_fasta_header_fields",
    """SELECT c_custkey, c_mktsegment AS protein, CASE c_nationkey % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'mouse' WHEN 2 THEN 'Vicugna_pacos' ELSE '' END AS organism FROM customer""",
)
def header_fields(spark, sf):
    kinds = F.array(F.lit("|Homo sapiens (9606)"), F.lit("| Mus musculus"), F.lit("|Vicugna pacos (30538)"), F.lit(""))
    c = table(spark, sf, "customer")
    header = F.concat("c_name", F.lit("_1|Chain A| "), "c_mktsegment", F.get(kinds, F.col("c_nationkey") % 4))
    rows = c.select("c_custkey", fasta.fasta_header_fields(header).alias("h"))
    return rows.select("c_custkey", "h.protein", fasta.organism_short("h.organism").alias("organism"))


@REGISTRY.add("s5_ledger_sequences", f"WITH {SEQS_SQL} SELECT min(id) AS id, seq FROM seqs GROUP BY seq")
def ledger_sequences(spark, sf):
    return T.ledger_sequences(seqs(spark, sf), "id", "seq")


ATOMS_SQL = f"""{POINTS_SQL}, atoms AS (SELECT design_id, CASE WHEN res_idx < 12 THEN 'A' ELSE 'H' END AS chain, res_idx + 1 AS res_num, res_idx,
  ['ALA', 'GLY', 'SER', 'UNK'][res_idx % 4 + 1] AS res_name, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM points)"""
RES_NAMES = ("ALA", "GLY", "SER", "UNK")


def _atoms(spark, sf):
    p = points(spark, sf)
    name = F.element_at(F.array(*[F.lit(n) for n in RES_NAMES]), F.col("res_idx") % 4 + 1)
    return p.select(
        "design_id", F.when(F.col("res_idx") < 12, "A").otherwise("H").alias("chain"), (F.col("res_idx") + 1).alias("res_num"), "res_idx", name.alias("res_name"),
        *[F.round(c, 3).alias(c) for c in "xyz"],
    )


@REGISTRY.add(
    "s6_fixed_width_atoms",
    f"WITH {ATOMS_SQL} SELECT design_id::VARCHAR AS design_id, chain, res_num, res_name, CASE WHEN res_idx % 5 = 4 THEN 'H1' ELSE 'CA' END AS atom_name, x, y, z, res_idx % 5 <> 4 AS is_heavy FROM atoms",
)
def fixed_width(spark, sf):
    a = _atoms(spark, sf)
    hydrogen = F.col("res_idx") % 5 == 4
    line = F.format_string(
        "ATOM  %5d  %s %s %s%4d    %8.3f%8.3f%8.3f  1.00  0.00          %s",
        F.col("res_num"), F.when(hydrogen, "H1 ").otherwise("CA "), "res_name", "chain", "res_num", "x", "y", "z", F.when(hydrogen, " H").otherwise(" C"),
    )
    lines = a.select(F.col("design_id").cast("string").alias("design_id"), line.alias("value"))
    rows = structures.fixed_width_atoms(lines)
    return rows.select("design_id", "chain", F.col("res_num").cast("bigint").alias("res_num"), "res_name", "atom_name", "x", "y", "z", "is_heavy")


FILES_SQL = f"""{ATOMS_SQL}, filed AS (SELECT design_id::VARCHAR AS design_id, chain, res_idx, CASE WHEN res_idx % 3 = 2 THEN res_num - 1 ELSE res_num END AS res_num,
  CASE WHEN res_idx % 3 = 2 THEN 'A' ELSE '' END AS icode, res_name, x, y, z FROM atoms)"""


def _filed(spark, sf):
    """Atoms with insertion codes: every third residue carries the number of the one before it and code A."""
    inserted = F.col("res_idx") % 3 == 2
    return _atoms(spark, sf).withColumns({"icode": F.when(inserted, "A").otherwise(""), "res_num": F.when(inserted, F.col("res_num") - 1).otherwise(F.col("res_num"))})


def _pdb_files(spark, sf):
    """One file per design: every fourth atom in two locations, and a second model with everything moved."""
    a = _filed(spark, sf)
    at = lambda mark, dx: F.format_string(
        "ATOM  %5d  CA %s%s %s%4d%s   %8.3f%8.3f%8.3f  1.00  0.00           C", F.col("res_idx") + 1, mark, "res_name", "chain", "res_num",
        F.when(F.col("icode") == "", " ").otherwise(F.col("icode")), F.col("x") + dx, "y", "z",
    )
    lines = F.when(F.col("res_idx") % 4 == 0, F.concat(at(F.lit("A"), 0.0), F.lit("\n"), at(F.lit("B"), 1.0))).otherwise(at(F.lit(" "), 0.0))
    moved = at(F.lit(" "), 9.0)
    rows = a.select(F.col("design_id").cast("string").alias("design_id"), F.struct("res_idx", lines.alias("l"), moved.alias("m")).alias("r"))
    body = rows.groupBy("design_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))  # 21 atoms each
    block = lambda f: F.array_join(F.transform("rs", lambda r: r[f]), "\n")
    text = F.concat(F.lit("MODEL        1\n"), block("l"), F.lit("\nENDMDL\nMODEL        2\n"), block("m"), F.lit("\nENDMDL\nEND"))
    out = shared_scratch(spark, "structures")
    write_row_files(body.select(F.concat("design_id", F.lit(".pdb")), text), out)
    return out


@REGISTRY.add("s6_read_fixed_width", f"WITH {FILES_SQL} SELECT design_id, chain, res_num, icode, res_name, x, y, z FROM filed")
def read_fixed_width(spark, sf):
    atoms = structures.read_atoms_fixed_width(spark, _pdb_files(spark, sf))
    return atoms.select("design_id", "chain", F.col("res_num").cast("bigint").alias("res_num"), "icode", "res_name", "x", "y", "z")


@REGISTRY.add(
    "s8_inserted_residues",
    f"WITH {FILES_SQL} SELECT design_id, 'A' AS chain, string_agg(CASE res_name WHEN 'ALA' THEN 'A' WHEN 'GLY' THEN 'G' WHEN 'SER' THEN 'S' ELSE 'X' END, '' ORDER BY res_idx) AS seq, count(*)::INTEGER AS n_res FROM filed WHERE chain = 'A' GROUP BY design_id",
)
def inserted_residues(spark, sf):
    return structures.chain_sequence(structures.read_atoms_fixed_width(spark, _pdb_files(spark, sf)))


@REGISTRY.add("s7_models_and_locations", f"WITH {FILES_SQL} SELECT design_id, chain, res_num, icode, res_name, x, y, z FROM filed")
def models_and_locations(spark, sf):
    names = ["group_PDB", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    header = "\n".join(["data_x", "loop_", *[f"_atom_site.{n}" for n in names]]) + "\n"
    code = F.when(F.col("icode") == "", "?").otherwise(F.col("icode"))
    at = lambda mark, dx, model: F.format_string(f"ATOM C CA {mark} %s %s %d %s %.3f %.3f %.3f {model}", "res_name", "chain", "res_num", code, F.col("x") + dx, "y", "z")
    lines = F.when(F.col("res_idx") % 4 == 0, F.concat(at("A", 0.0, 1), F.lit("\n"), at("B", 1.0, 1))).otherwise(at(".", 0.0, 1))
    rows = _filed(spark, sf).select("design_id", F.struct("res_idx", lines.alias("l"), at(".", 9.0, 2).alias("m")).alias("r"))
    body = rows.groupBy("design_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    block = lambda f: F.array_join(F.transform("rs", lambda r: r[f]), "\n")
    text = F.concat(F.lit(header), block("l"), F.lit("\n"), block("m"), F.lit("\n#\n"))
    atoms = structures.mmcif_atoms(body.select(F.col("design_id").cast("string").alias("design_id"), text.alias("value")))
    return atoms.select("design_id", "chain", F.col("res_num").cast("bigint").alias("res_num"), "icode", "res_name", "x", "y", "z")


def _cif(spark, sf):
    header = "\n".join(["data_x", "loop_", "_atom_site.group_PDB", "_atom_site.type_symbol", "_atom_site.label_atom_id", "_atom_site.label_comp_id", "_atom_site.label_asym_id",
                        "_atom_site.auth_asym_id", "_atom_site.label_seq_id", "_atom_site.auth_seq_id", "_atom_site.Cartn_x", "_atom_site.Cartn_y", "_atom_site.Cartn_z"])
    line = F.format_string("ATOM C \"CA'\" %s Z %s 1 %d %.3f %.3f %.3f", "res_name", "chain", "res_num", "x", "y", "z")
    rows = _atoms(spark, sf).select("design_id", F.struct("res_num", line.alias("l")).alias("r"))
    # one text per design, 21 atoms each
    body = rows.groupBy("design_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["l"]), "\n").alias("b"))
    return body.select(F.col("design_id").cast("string").alias("design_id"), F.concat(F.lit(header + "\n"), "b", F.lit("\n#\nloop_\n_other.x\nATOM 1\n")).alias("value"))


@REGISTRY.add("s7_mmcif_atoms", f"WITH {ATOMS_SQL} SELECT design_id::VARCHAR AS design_id, chain, res_num, res_name, 'CA''' AS atom_name, x, y, z FROM atoms")
def mmcif(spark, sf):
    return structures.mmcif_atoms(_cif(spark, sf)).select("design_id", "chain", F.col("res_num").cast("bigint").alias("res_num"), "res_name", "atom_name", "x", "y", "z")


@REGISTRY.add("s7_read_mmcif", f"WITH {ATOMS_SQL} SELECT design_id::VARCHAR AS design_id, chain, res_num, res_name, 'CA''' AS atom_name, x, y, z FROM atoms")
def read_mmcif(spark, sf):
    """One file per design, written and read back."""
    out = shared_scratch(spark, "mmcif")
    write_row_files(_cif(spark, sf).select(F.concat("design_id", F.lit(".cif")), "value"), out)
    atoms = structures.read_atoms_mmcif(spark, out)
    return atoms.select("design_id", "chain", F.col("res_num").cast("bigint").alias("res_num"), "res_name", "atom_name", "x", "y", "z")


@REGISTRY.add("s8_chain_sequence", f"WITH {ATOMS_SQL} SELECT design_id, 'A' AS chain, 'AGSXAGSXAGSX' AS seq, 12 AS n_res FROM atoms GROUP BY design_id")
def chain_sequence(spark, sf):
    atoms = _atoms(spark, sf).withColumn("serial", F.col("res_idx"))
    doubled = atoms.unionByName(atoms.withColumn("serial", F.col("serial") + 100).withColumn("res_name", F.lit("TRP")))
    return structures.chain_sequence(doubled)


@REGISTRY.add(
    "s9_pae_matrix",
    """SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN NULL ELSE 8 END::INTEGER AS n, CASE WHEN vec_id % 4 = 3 THEN NULL ELSE round(CAST(embedding[12] AS DOUBLE), 6) END AS cell FROM embeddings""",
)
def pae_matrix(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))
    kind = F.col("vec_id") % 4
    text = (
        F.when(kind == 0, F.to_json(F.struct(matrix.alias("pae"))))
        .when(kind == 1, F.to_json(F.struct(F.lit(3.0).alias("pae"), matrix.alias("predicted_aligned_error"))))
        .when(kind == 2, F.to_json(F.struct(matrix.alias("predicted_aligned_error_matrix"))))
        .otherwise(F.to_json(F.struct(F.array(F.lit(1.0)).alias("pae"))))
    )
    rows = e.select("vec_id", outputs.pae_matrix(text).alias("m"))
    size = F.when(F.col("m").isNotNull(), F.size("m"))
    return r6(rows.select("vec_id", size.alias("n"), F.get(F.get("m", F.lit(1)), F.lit(3)).alias("cell")))


@REGISTRY.add(
    "s9_read_pae",
    "SELECT vec_id::VARCHAR AS design_id, CASE WHEN vec_id % 7 = 3 THEN NULL ELSE 8 END::INTEGER AS n, CASE WHEN vec_id % 7 = 3 THEN NULL ELSE round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) END AS total FROM embeddings",
)
def read_pae(spark, sf):
    """Confidence files, some without a matrix, beside summary files that must not be read."""
    e = table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    matrix = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))
    text = F.when(F.col("vec_id") % 7 == 3, F.lit('{"pae": "none"}')).otherwise(F.to_json(F.struct(matrix.alias("pae"))))
    name = lambda kind: F.concat(F.col("vec_id").cast("string"), F.lit(f"_{kind}confidences.json"))
    out = shared_scratch(spark, "confidences")
    write_row_files(e.select(name("full_"), text).unionByName(e.select(name("summary_").alias("a"), F.lit("{}").alias("b")).toDF(*e.select(name("full_"), text).columns)), out)
    rows = outputs.read_pae(spark, out)
    total = F.aggregate(F.flatten("pae"), F.lit(0.0), lambda a, v: a + v)
    return rows.select("design_id", F.when(F.col("pae").isNotNull(), F.size("pae")).alias("n"), F.round(total, 4).alias("total"))


@REGISTRY.add(
    "s10_read_summaries",
    """SELECT vec_id::VARCHAR AS design_id, round(CAST(embedding[1] AS DOUBLE), 6) AS ptm, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE round(CAST(embedding[2] AS DOUBLE), 6) END AS ranking_score,
  label::DOUBLE AS fraction_disordered, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_clash_af3, round(CAST(embedding[64] AS DOUBLE), 6) AS chain_pair_pae_min FROM embeddings WHERE vec_id % 9 <> 5""",
)
def read_summaries(spark, sf):
    """Summary files; every ninth is cut short and dropped by policy."""
    e = table(spark, sf, "embeddings")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    body = F.to_json(F.struct(
        at(0).alias("ptm"), F.when(F.col("vec_id") % 3 == 0, "bad").otherwise(at(1).cast("string")).alias("ranking_score"), F.col("label").alias("fraction_disordered"),
        (F.col("vec_id") % 2 == 0).alias("has_clash"), F.array(F.array(at(63))).alias("chain_pair_pae_min"),
    ))
    text = F.when(F.col("vec_id") % 9 == 5, F.substring(body, 1, 20)).otherwise(body)
    out = shared_scratch(spark, "summaries")
    write_row_files(e.select(F.concat(F.col("vec_id").cast("string"), F.lit("_summary_confidences.json")), text), out)
    return r6(outputs.read_summary_scalars(spark, out, bad="drop"))


@REGISTRY.add(
    "s11_index_folder",
    """WITH f AS (SELECT lower(p_brand || '_m' || (p_partkey % 40)) AS design, p_brand || '_m' || (p_partkey % 40) || '_seed' || (p_partkey % 3) || '_' || p_partkey || '.cif' AS file FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY design ORDER BY CASE WHEN contains(file, '_seed1_') THEN 0 ELSE 1 END, file) AS n FROM f) SELECT design, file FROM r WHERE n = 1""",
)
def index_folder(spark, sf):
    p = table(spark, sf, "part")
    name = F.format_string("%s_m%d_seed%d_%d.cif", "p_brand", F.col("p_partkey") % 40, F.col("p_partkey") % 3, "p_partkey")
    out = shared_scratch(spark, "artifacts")
    write_row_files(p.select(name, F.col("p_name").alias("content")), out)
    file = F.element_at(F.split("path", "/"), -1)
    prefer = [F.when(F.col("path").contains("_seed1_"), 0).otherwise(1), file]
    found = outputs.index_artifacts(spark, out, r"^(.+_m\d+)_seed\d+_\d+\.cif$", ["design"], prefer)
    return found.select("design", F.regexp_replace(file, "%23", "#").alias("file"))


@REGISTRY.add(
    "s10_summary_scalars",
    """SELECT event_id, value AS ptm, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS ranking_score, CAST(json_extract(props, '$.k') AS DOUBLE) AS fraction_disordered,
  CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS has_clash_af3, value AS chain_pair_pae_min FROM events""",
)
def summary_scalars(spark, sf):
    e = table(spark, sf, "events")
    v, k = F.col("value").cast("string"), F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit('{"ptm": '), v, F.lit(', "ranking_score": '), F.when(F.col("event_id") % 3 == 0, F.lit('"bad"')).otherwise(v), F.lit(', "fraction_disordered": '), k,
        F.lit(', "has_clash": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("0.0"), F.lit(', "chain_pair_pae_min": '),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[["), v, F.lit("]]"))).otherwise(v), F.lit("}"),
    )
    return e.select("event_id", outputs.summary_scalars(text).alias("s")).select("event_id", "s.*")


@REGISTRY.add(
    "s11_artifact_index",
    """WITH f AS (SELECT p_brand || '_m' || (p_partkey % 40) AS k, p_partkey, '/out/' || p_brand || '_m' || (p_partkey % 40) || '_seed' || (p_partkey % 3) || '_' || p_partkey || '.cif' AS path FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(k) ORDER BY CASE WHEN contains(path, '_seed1_') THEN 0 ELSE 1 END, path) AS n FROM f) SELECT lower(k) AS design, path FROM r WHERE n = 1""",
)
def artifact_index(spark, sf):
    p = table(spark, sf, "part")
    path = F.format_string("/out/%s_m%d_seed%d_%d.cif", "p_brand", F.col("p_partkey") % 40, F.col("p_partkey") % 3, "p_partkey")
    prefer = F.when(F.col("path").contains("_seed1_"), 0).otherwise(1)
    return outputs.index_paths(p.select(path.alias("path")), r"^(.+_m\d+)_seed\d+_\d+\.cif$", ["design"], [prefer])


@REGISTRY.add("s13_passing_rows", "SELECT p_partkey, p_brand FROM part WHERE p_size % 4 IN (0, 1, 2)")
def passing_rows(spark, sf):
    flag = F.element_at(F.array(F.lit("True "), F.lit("1"), F.lit("TRUE"), F.lit("no")), F.col("p_size") % 4 + 1)
    out = f"{shared_scratch(spark, 'generations')}.parquet"
    table(spark, sf, "part").select("p_partkey", "p_brand", flag.alias("passes")).write.parquet(out)
    return T.read_passing(spark, out).select("p_partkey", "p_brand")


@REGISTRY.add("s14_codon_weights", "SELECT upper(substr(p_name, 1, 1)) AS aa, upper(substr(p_type, 1, 3)) AS codon, p_retailprice AS weight, p_size AS index FROM part")
def codon_weights(spark, sf):
    out = shared_scratch(spark, "codons")
    p = table(spark, sf, "part")
    p.select(F.upper(F.substring("p_name", 1, 1)), F.upper(F.substring("p_type", 1, 3)), "p_retailprice", "p_size").write.csv(out)
    return T.read_codon_weights(spark, out)


@REGISTRY.add(
    "k1_dual_sink",
    f"WITH {CONTIGS_SQL} SELECT contig_id, '[' || array_to_string(epitope_resindices, ',') || ']' AS csv_list, len(epitope_resindices)::INTEGER AS parquet_size FROM contigs",
)
def dual_sink(spark, sf):
    out = shared_scratch(spark, "dual")
    K.write_dual(contigs(spark, sf), out)
    text = T.read_table(spark, f"{out}.csv").select(F.col("contig_id").cast("bigint").alias("contig_id"), F.col("epitope_resindices").alias("csv_list"))
    return text.join(T.read_table(spark, f"{out}.parquet").select("contig_id", F.size("epitope_resindices").alias("parquet_size")), "contig_id")


@REGISTRY.add("k3_order_file", "SELECT 'LIB_' || o_orderkey AS seq_id, upper(o_orderpriority) AS oligo FROM orders")
def order_file(spark, sf):
    out = shared_scratch(spark, "order")
    o = table(spark, sf, "orders").select(F.concat(F.lit("LIB_"), "o_orderkey").alias("id"), F.upper("o_orderpriority").alias("oligo"))
    K.write_order(o, out)
    return spark.read.option("header", True).csv(out).toDF("seq_id", "oligo")


@REGISTRY.add("k3_quote_file", "SELECT 'LIB_' || o_orderkey AS name, o_orderstatus AS sequence FROM orders")
def quote_file(spark, sf):
    out = shared_scratch(spark, "quote")
    K.write_quote(table(spark, sf, "orders").select(F.concat(F.lit("LIB_"), "o_orderkey").alias("name"), F.col("o_orderstatus").alias("sequence")), out, header=False)
    return spark.read.csv(out).toDF("name", "sequence")


@REGISTRY.add(
    "k4_component_blocks",
    "SELECT o_orderpriority AS component, count(*) * CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END AS n, round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 7.0 WHEN o_orderpriority = '1-URGENT' THEN 2 * o_totalprice ELSE o_totalprice END), 2) AS total FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY 1",
)
def component_blocks(spark, sf):
    out = shared_scratch(spark, "library")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("component"), "o_orderkey", "o_totalprice")
    o.write.partitionBy("component").parquet(out)
    low = o.where("component = '5-LOW'").withColumn("o_totalprice", F.lit(7.0))
    for _ in range(2):
        K.write_component(low, out, "5-LOW")
    K.write_component(o.where("component = '1-URGENT'"), out, "1-URGENT", mode="append")
    K.write_component(o.where("component = 'none'"), out, "2-HIGH")  # rebuilt from nothing: the block goes
    return spark.read.parquet(out).groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REGISTRY.add(
    "k6_json_specs",
    f"""WITH {CONTIGS_SQL} SELECT contig_id || '' AS design_id, '{{"' || contig_id || '":{{"input":"' || input_pdb || '","contig":"' || replace(contig_string, '/', ',') || '","length":"104-104","select_fixed_atoms":{{'
  || array_to_string(list_transform(epitope_resindices, lambda i: '"A' || (i + 1) || '":"BKBN"'), ',') || '}},"select_unfixed_sequence":false}}}}' AS json FROM contigs""",
)
def json_specs(spark, sf):
    rows = contigs(spark, sf).withColumn("design_id", F.col("contig_id").cast("string"))
    return K.json_specs(rows)


@REGISTRY.add("k6_json_manifest", f"WITH {CONTIGS_SQL} SELECT contig_id || '' AS design_id FROM contigs")
def json_manifest(spark, sf):
    rows = contigs(spark, sf).withColumn("design_id", F.col("contig_id").cast("string"))
    return K.emit_json_specs(rows, shared_scratch(spark, "specs")).select("design_id")


@REGISTRY.add(
    "k7_sequence_payload",
    f"""WITH {SEQS_SQL} SELECT 'd' || id AS name, '{{"name":"d' || id || '","modelSeeds":[1],"sequences":[{{"protein":{{"id":"A","sequence":"' || seq || '","unpairedMsa":">query\\n' || seq || '\\n","pairedMsa":">query\\n' || seq
  || '\\n","templates":[]}}}}],"dialect":"alphafold3","version":1}}' AS json FROM seqs""",
)
def payload(spark, sf):
    return K.sequence_payload(seqs(spark, sf).select(F.concat(F.lit("d"), "id").alias("name"), "seq"))


PAYLOAD_SQL = REGISTRY.sql["k7_sequence_payload"]


@REGISTRY.add("k7_payload_files", PAYLOAD_SQL)
def payload_files(spark, sf):
    """One request file per sequence, written and read back."""
    out = shared_scratch(spark, "payloads")
    K.emit_sequence_payload(seqs(spark, sf).select(F.concat(F.lit("d"), "id").alias("name"), "seq"), out)
    return outputs.whole_files(spark, out, r"\.json$").select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("json"))
