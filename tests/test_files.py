"""Readers and writers on real files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from peptarium.plans import flows
from peptarium.sinks import files
from peptarium.sinks import tables as K
from peptarium.sources import fasta, outputs, structures
from peptarium.sources import tables as T

PDB = """HEADER    X
ATOM      1  N   ALA A   1      11.104   6.134  -6.504  1.00  0.00           N
ATOM      2  CA  ALA A   1      11.639   6.071  -5.147  1.00  0.00           C
ATOM      3  H   ALA A   1       1.000   1.000   1.000  1.00  0.00           H
ATOM      4 1HB  ALA A   1       1.000   1.000   1.000  1.00  0.00
ATOM      5  CA  MSE A   2       2.000   2.000   2.000  1.00  0.00           C
HETATM    6  O   HOH B   9       3.000   3.000   3.000  1.00  0.00           O
END
"""

CIF = """data_x
loop_
_entity.id
1
loop_
_atom_site.group_PDB
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_seq_id
_atom_site.auth_asym_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM N N GLY B 1 H 1.0 2.0 3.0
ATOM C "C1'" GLY B 1 H 1.5 2.5 3.5
ATOM C CA TRP B 2 H 4.0 5.0 6.0
ATOM C CA
#
loop_
_other.id
ATOM
"""


def test_fixed_width_atoms_and_sequence(spark, tmp_path):
    (tmp_path / "d1.pdb").write_text(PDB)
    atoms = structures.read_atoms_fixed_width(spark, str(tmp_path))
    rows = atoms.orderBy("serial").collect()
    assert [r["is_heavy"] for r in rows] == [True, True, False, False, True, True]
    assert (rows[0]["design_id"], rows[0]["x"], rows[0]["z"], rows[0]["atom_name"]) == ("d1", 11.104, -6.504, "N")
    assert structures.chain_sequence(atoms).first()["seq"] == "AX"
    assert structures.chain_sequence(atoms, chain="Q").first()["chain"] == "A"


def test_mmcif_plain_and_gzipped(spark, tmp_path):
    (tmp_path / "a.cif").write_text(CIF)
    with gzip.open(tmp_path / "b.cif.gz", "wt") as fh:
        fh.write(CIF.replace("TRP", "ZZZ"))
    atoms = structures.read_atoms_mmcif(spark, str(tmp_path))
    assert atoms.groupBy("design_id").count().orderBy("design_id").toPandas()["count"].tolist() == [3, 3]
    first = atoms.where("design_id = 'a'").orderBy("serial").collect()
    assert [r["atom_name"] for r in first] == ["N", "C1'", "CA"] and {r["chain"] for r in first} == {"H"}
    seqs = {r["design_id"]: r["seq"] for r in structures.chain_sequence(atoms).collect()}
    assert seqs == {"a": "GW", "b": "GX"}


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">1ABC_1|Chain A|Some protein|Homo sapiens (9606)\nACD\r\nEFG\n>2 second\nKL\n")
    rows = {r["id"]: r for r in fasta.read_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert rows["1ABC_1|Chain"]["seq"] == "ACDEFG" and rows["2"]["seq"] == "KL"


def test_pae_and_summary(spark, tmp_path):
    (tmp_path / "d1_confidences.json").write_text(json.dumps({"pae": [[1.0, 2.0], [3.0, 4.0]]}))
    (tmp_path / "d1_summary_confidences.json").write_text(json.dumps({"ptm": 0.5, "has_clash": True, "chain_pair_pae_min": [[0.76]], "ranking_score": "x"}))
    (tmp_path / "d2_confidences.json").write_text(json.dumps({"pae": 3, "predicted_aligned_error": [[9.0]]}))
    got = {r["design_id"]: r["pae"] for r in outputs.read_pae(spark, str(tmp_path)).collect()}
    assert got == {"d1": [[1.0, 2.0], [3.0, 4.0]], "d2": [[9.0]]}
    s = outputs.read_summary_scalars(spark, str(tmp_path / "d1_summary_confidences.json")).first()
    assert (s["design_id"], s["ptm"], s["has_clash_af3"], s["chain_pair_pae_min"], s["ranking_score"]) == ("d1", 0.5, 1.0, 0.76, None)


def test_artifact_index_prefers(spark, tmp_path):
    for name in ("sub/Tok1_0_model_1_seed2.cif", "Tok1_0_model_1_seed1.cif", "other.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x")
    seed1 = F.when(F.col("path").contains("seed1"), 0).otherwise(1)
    rows = outputs.index_artifacts(spark, str(tmp_path), r"^(\w+?)_0_model_(\d+).*\.cif$", ["token", "pred"], [seed1]).collect()
    assert len(rows) == 1 and rows[0]["token"] == "tok1" and rows[0]["path"].endswith("seed1.cif")


def test_named_peptides_arity_is_an_error(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a,ACD\nb,EFG\n")
    assert T.read_named_peptides(spark, str(tmp_path / "good.csv")).count() == 2
    (tmp_path / "bad.csv").write_text("a,ACD\nb,EFG,extra\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        T.read_named_peptides(spark, str(tmp_path / "bad.csv")).collect()


def test_passing_and_assay_errors(spark, tmp_path):
    spark.createDataFrame([("no",)], "passes string").write.parquet(str(tmp_path / "p.parquet"))
    with pytest.raises(ValueError, match="no passing rows"):
        T.read_passing(spark, str(tmp_path / "p.parquet"))
    df = spark.createDataFrame([(1, 2, 3)], "NoAb_x int, X1abc_y int, other int")
    assert T.assay_columns(df) == ({"1abc": "X1abc_y"}, "NoAb_x")
    with pytest.raises(ValueError, match="expected one NoAb"):
        T.assay_columns(df.drop("NoAb_x"))
    with pytest.raises(ValueError, match="unknown table suffix"):
        T.read_table(spark, "x.txt")


def test_carriage_return_is_refused(spark, tmp_path):
    df = spark.createDataFrame([("a", "AC\r")], "name string, seq string")
    with pytest.raises(ValueError, match="carriage return"):
        K.write_named_peptides(df, str(tmp_path / "out"))


def test_component_rebuild_is_idempotent(spark, tmp_path):
    out = str(tmp_path / "lib")
    a, b = spark.createDataFrame([(1,), (2,)], "v int"), spark.createDataFrame([(9,)], "v int")
    K.write_component(a, out, "C1")
    K.write_component(b, out, "C2")
    for _ in range(2):
        K.write_component(a, out, "C1")
    assert spark.read.parquet(out).count() == 3
    K.write_component(b, out, "C2", mode="append")
    assert spark.read.parquet(out).where("component = 'C2'").count() == 2


def test_json_specs(spark, tmp_path):
    df = spark.createDataFrame([("d1", "/x.pdb", "1-1/A2-3/", "103-104", [0, -1, 4])], "design_id string, input_pdb string, contig_string string, contig_length string, epitope_resindices array<int>")
    spec = json.loads(K.json_specs(df).first()["json"])["d1"]
    assert spec["contig"] == "1-1,A2-3" and spec["length"] == "104-104"
    assert spec["select_fixed_atoms"] == {"A1": "BKBN", "A5": "BKBN"} and spec["select_unfixed_sequence"] is False
    payload = json.loads(K.sequence_payload(df.selectExpr("design_id AS name", "'ACD' AS seq"), 7).first()["json"])
    assert payload["modelSeeds"] == [7] and payload["sequences"][0]["protein"]["unpairedMsa"] == ">query\nACD\n"
    manifest = K.emit_json_specs(df, str(tmp_path / "specs"))
    assert manifest.first()["design_id"] == "d1"


def test_fasta_with_marks_inside_headers(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">d1_epitopeIsland1Mut>A note\r\nACD\r\n>d2 a>b\r\nKL\r\n")
    rows = {r["id"]: r for r in fasta.read_fasta(spark, str(tmp_path / "x.fasta")).collect()}
    assert set(rows) == {"d1_epitopeIsland1Mut>A", "d2"} and rows["d1_epitopeIsland1Mut>A"]["seq"] == "ACD" and rows["d2"]["header"] == "d2 a>b"


def test_first_model_locations_and_insertions(spark, tmp_path):
    line = "ATOM  {:5d}  CA {}{} A{:4d}{}   {:8.3f}{:8.3f}{:8.3f}  1.00  0.00           C"
    one = [line.format(1, " ", "ALA", 52, " ", 0, 0, 0), line.format(2, "A", "GLY", 52, "A", 1, 0, 0), line.format(3, "B", "GLY", 52, "A", 2, 0, 0), line.format(4, " ", "SER", 53, " ", 3, 0, 0)]
    (tmp_path / "m.pdb").write_text("MODEL 1\r\n" + "\r\n".join(one) + "\r\nENDMDL\r\nMODEL 2\r\n" + "\r\n".join(one) + "\r\nENDMDL\r\n")
    atoms = structures.read_atoms_fixed_width(spark, str(tmp_path / "m.pdb"))
    assert sorted((r["res_num"], r["icode"], r["x"]) for r in atoms.collect()) == [(52, "", 0), (52, "A", 1), (53, "", 3)]
    assert structures.chain_sequence(atoms).first()["seq"] == "AGS"


def test_empty_rebuild_drops_the_block(spark, tmp_path):
    out = str(tmp_path / "lib")
    rows = spark.createDataFrame([(1,), (2,)], "v int")
    for name in ("C1", "a/b c"):
        K.write_component(rows, out, name)
    K.write_component(rows.where("v > 5"), out, "a/b c")
    K.write_component(rows.where("v > 5"), out, "never there")
    assert spark.read.parquet(out).select("component").distinct().collect()[0][0] == "C1"


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from peptarium import session

    unset = SimpleNamespace(get=lambda key, default=None: default)
    for master, fine in (("local", True), ("local[8]", True), ("local-cluster[3,2,3000]", False), ("spark://h:7077", False), ("yarn", False)):
        fake = SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert session.shared_folder(fake).startswith("/tmp/")
        else:
            with pytest.raises(RuntimeError, match="checkpoint"):
                session.shared_folder(fake)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: "hdfs:///x/"), sparkContext=SimpleNamespace(master="yarn"))
    assert session.shared_scratch(named, "t").startswith("hdfs:///x/t-")


def test_a_task_that_runs_twice_leaves_one_copy(tmp_path):
    out = str(tmp_path / "out")
    rows = [("a.json", "1"), ("b.json", "2")]
    writer = files.RowFileWriter(out, overwrite=True)
    writer.write(iter(rows[:1]))  # lost with its executor after it had written
    writer.commit([writer.write(iter(rows)), writer.write(iter([("c.json", None)])), writer.write(iter([]))])
    found = {f.name: f.read_text() for f in (tmp_path / "out").rglob("*.json")}
    assert found == {"a.json": "1", "b.json": "2", "c.json": ""} and len(list((tmp_path / "out").rglob("*.json"))) == 3
    failing = files.RowFileWriter(out, overwrite=True)
    failing.write(iter([("d.json", "4")]))
    failing.abort([None])
    assert len(list((tmp_path / "out").rglob("*.json"))) == 3
    for bad in ([("x/y", "1")], [("", "1")], [("a", "1"), ("a", "2")]):
        with pytest.raises(ValueError):
            files.RowFileWriter(out, overwrite=False).write(iter(bad))


def test_row_files_replace_or_add(spark, tmp_path):
    out = str(tmp_path / "specs")
    df = spark.range(40).select(F.concat(F.lit("d"), "id").alias("name"), F.col("id").cast("string").alias("json"))
    manifest = K.write_json_files(df, out, "name").collect()
    assert sorted(r["name"] for r in manifest) == sorted(f"d{i}" for i in range(40))
    files.write_row_files(df.limit(3).select(F.concat("name", F.lit("x.json")), "json"), out, mode="append")
    assert len(list((tmp_path / "specs").rglob("*.json"))) == 43
    files.write_row_files(df.limit(2), out)
    assert sorted(f.name for f in (tmp_path / "specs").rglob("*") if f.is_file()) == ["d0", "d1"]


@pytest.mark.parametrize("bad, want", [("null", 3), ("drop", 1), ("fail", None)])
def test_bad_files_follow_the_policy(spark, tmp_path, bad, want):
    for name, text in {"a_confidences.json": '{"pae": [[1.0]]}', "b_confidences.json": '{"pae": 3}', "sub/c_confidences.json": "cut {"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = outputs.read_pae(spark, str(tmp_path), bad)
    if want is None:
        with pytest.raises(Exception, match="unreadable file"):
            rows.collect()
    else:
        assert {r["design_id"] for r in rows.collect()} == set("abc"[:want]) and rows.count() == want
    with pytest.raises(ValueError, match="policy"):
        outputs.read_pae(spark, str(tmp_path), "other")


def test_first_chain_of_the_file_stands_for_the_target(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">one|Chain A|late\nAAAABCDEFGHIJK\nFIRST\n>two|Chain B|early\nBCDEFGHIJKSECOND\n")
    chains = fasta.read_fasta(spark, str(tmp_path)).select(F.lit("e").alias("entry"), F.col("seq").alias("c_seq"), "record")
    queries = spark.createDataFrame([("t", "e", "BCDEFGHIJK")], "target string, entry string, q_seq string")
    windows = flows.native_tiles(queries, chains, mer=8, step=4)[1].first()
    assert (windows["native"], windows["status"]) == ("BCDEFGHIJKFIRST", "clean")
