"""What a step reads, ships and works out must not grow faster than its input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from peptarium.catalog import tables
from peptarium.functions import contigs as C
from peptarium.operators import ordering as O
from peptarium.operators import scoring, stats
from peptarium.operators import spatial as R
from peptarium.operators.joins import longest_block, relabel_by_sequence
from peptarium.operators.ordering import lookup, row_rank
from peptarium.operators.predicates import to_library_schema
from peptarium.operators.scoring import calibrate_ties, swap_term
from peptarium.operators.validation import verify_order
from peptarium.plans import flows
from peptarium.plans.presets import PRESETS, SCORED, comparison_presets
from peptarium.session import ROWS_PER_TASK_CONF
from peptarium.sinks import files
from peptarium.sources import outputs


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shorten_contig_parses_once(spark):
    rows = spark.createDataFrame([("3-3/A5-9/2-2/A40-50/83-83",), ("9-9/A5-9/2-2/A40-50/0-0",), ("0-0/A5-9/2-2/A40-50/4-4/A60-60/0-0",)], ["c"])
    length = F.when(F.col("c").startswith("3-"), 103)
    out = rows.select(length.alias("n"), C.shorten_contig("c").alias("s")).where("n = 103").select("s.contig", "s.where")
    assert out.where(F.lit(True)).select("contig", "where").first() == ("3-3/A5-9/2-2/A40-50/82-82", "C")
    short = rows.where(F.col("c").startswith("9-")).select(C.shorten_contig("c", 26).alias("s")).first().s
    assert (short.contig, short.where) == ("8-8/A5-9/2-2/A40-50/0-0", "N")
    inner = rows.where(F.col("c").startswith("0-")).select(C.shorten_contig("c", 22).alias("s")).first().s
    assert (inner.contig, inner.where) == ("0-0/A5-9/2-2/A40-50/3-3/A60-60/0-0", "spacer@4")
    assert plan_of(rows.select(C.shorten_contig("c").alias("s"))).count("regexp_extract") == 2


def _shipped(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastExchange" in line]


def test_copies_of_targets_are_not_broadcast(spark, monkeypatch):
    points = spark.range(40).select((F.col("id") % 4).alias("design_id"), F.col("id").alias("res_idx"), *[(F.col("id") * k % 7).cast("double").alias(x) for k, x in ((1, "x"), (2, "y"), (3, "z"))])
    whole = R._meet(points, points, 2.0, ["design_id"], R.squared_distance() < 4.0, "left_semi")
    assert not _shipped(whole) and "_cx" not in plan_of(whole)
    monkeypatch.setattr(R, "BROADCAST_ROWS", 10)
    cells = R._meet(points, points, 2.0, ["design_id"], R.squared_distance() < 4.0, "left_semi", copied="targets")
    assert not _shipped(cells) and "_cx" in plan_of(cells)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cells.collect()))


def test_sweep_report_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return float(v % 5)

    rows = spark.range(100).select((F.col("id") % 2).alias("cell"), counted(F.col("id")).alias("s"), (F.col("id") % 3 == 0).alias("l"))
    assert len(stats.sweep_report(rows, ["cell"], "s", "l").collect()) == 2
    assert seen.value <= 200  # the score is tested for null and used: at most twice a row, in one read


def test_written_files_are_listed_and_read_by_tasks(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(40).coalesce(1).select(F.concat("id", F.lit(".json")).alias("name"), F.col("id").cast("string"))
    files.write_row_files(rows, out)
    assert len([n for n in files.listed(out) if n.startswith("part-")]) > 1  # one input partition, several writers
    got = outputs.whole_files(spark, out, r"\.json$")
    assert sorted(int(r["value"]) for r in got.collect()) == list(range(40))
    assert "BatchScan row_files" in got._jdf.queryExecution().executedPlan().toString()
    assert outputs.index_artifacts(spark, out, r"^(\d)\d*\.json$", ["first"]).count() == 10
    assert files.read_row_files(spark, str(tmp_path / "none")) is None


def test_structures_are_files_in_few_folders(spark):
    out = tables._pdb_files(spark, "/root/testdata/sf0.001")
    assert 0 < len(files.listed(out)) <= 2 * spark.sparkContext.defaultParallelism + 1


def test_native_tiles_are_not_searched_for(spark):
    text = "ACDEFGHIKLMNPQRSTVWY" * 3
    queries = spark.createDataFrame([("t", "e", text[7:])], "target string, entry string, q_seq string")
    chains = spark.createDataFrame([("e", text, 1)], "entry string, c_seq string, record int")
    tiles, _ = flows.native_tiles(queries, chains)
    assert {(r["start"], r["tile"]) for r in tiles.collect()} == {(i + 1, text[7 + i : 37 + i]) for i in (0, 6, 12, 18, 23)}
    assert "contains(" not in plan_of(tiles.select("target", "start", "tile")).lower()


def test_oligos_are_translated_once(spark):
    oligos = spark.createDataFrame([("a_1", "AAGCTTT", 1), ("b_1", "AANNNTT", 2), ("c_1", "AAGCTTGCTT", 3)], "id string, oligo string, row int")
    peptides = spark.createDataFrame([("x", "A"), ("y", "AC")], "name string, seq string")
    out = relabel_by_sequence(oligos, peptides, "AA", "TT")
    assert {r["name"]: r["oligo"] for r in out.collect()} == {"x": "AAGCTTT", "y": "AAGCTTGCTT"}
    assert plan_of(out).count("regexp_extract_all") == 1


def test_calibrate_ties_reads_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def stored(v):
        seen.add(1)
        return 1.0 - (v % 5 + 1) / 5.0  # the dense rank of id % 5

    rows = spark.range(50).select((F.col("id") % 5).alias("v"), stored("id").alias("s"))
    errors = {r["method"]: r["max_error"] for r in calibrate_ties(rows, "v", "s", 1.0).collect()}
    assert set(errors) == {"average", "min", "max", "dense"} and errors["dense"] < 1e-9 < errors["min"]
    assert seen.value == 50


def test_swap_term_reads_scored_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def composite(v):
        seen.add(1)
        return v / 2.0

    rows = spark.range(50).select((F.col("id") % 5).alias("v"), F.lit(1.0).alias("old"))
    out = swap_term(rows.withColumn("composite", composite("v")), "old", "v", 0.5, population=rows)
    assert sorted({r["composite_swapped"] for r in out.collect()}) == pytest.approx(sorted({v / 2 - 1 + 0.5 * (1 - (10 * v + 5.5) / 50) for v in range(5)}))
    assert seen.value == 50


def test_ranks_of_small_groups_are_not_written(sliced):
    rows = sliced.range(400).select((F.col("id") % 20).alias("g"), "id")
    ranked = row_rank(rows, ["g"], ["id"])
    assert "LogicalRDD" not in plan_of(ranked) and {r["n"] for r in ranked.groupBy("g").agg(F.max("rank_in_group").alias("n")).collect()} == {20}
    assert "LogicalRDD" in plan_of(row_rank(rows.withColumn("g", F.lit(0)), ["g"], ["id"]))


def test_lookup_counts_keys_without_shuffling_them(sliced):
    rows, ref = sliced.range(400), sliced.range(390).withColumn("v", F.col("id") + 1)
    out = lookup(rows, ref, ["id"])
    assert "_salt" not in plan_of(out) and out.where("v = id + 1").count() == 390 and out.count() == 400


def test_world_selections_deal_rows_once(spark):
    rng = np.random.default_rng(4)
    f = pd.DataFrame({c: rng.integers(0, 12, 300) / 2.0 for c in (*SCORED, "mean_pae")}).assign(key=range(300), id=np.arange(300) % 7)
    f.loc[f.index % 9 == 0, "epitope_pae"] = np.nan
    rows = spark.createDataFrame(f)
    presets = comparison_presets(topk=6)
    got = scoring.select_all(rows, presets, ["key"], "id", ["key"])
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(id") <= 1
    want = {(name, r["id"], r["key"]) for name, p in presets.items() for r in scoring.score_and_select(rows, p, ["key"]).collect()}
    assert {(r["world"], r["id"], r["key"]) for r in got.collect()} == want
    spark.conf.set(ROWS_PER_TASK_CONF, "20")  # ids are larger than a task: presets go one by one
    try:
        assert {(r["world"], r["id"], r["key"]) for r in scoring.select_all(rows, presets, ["key"], "id", ["key"]).collect()} == want
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)


def test_cut_component_keeps_no_full_ranking(sliced):
    rows = sliced.range(300).select(F.col("id").alias("key"), F.lit("a").alias("id"), *[(F.col("id") % k / 2.0).alias(c) for k, c in ((7, "af3_n_clash_res"), (5, "epitope_chunk_rmsd"), (11, "overall_rmsd"), (13, "epitope_pae"), (3, "mean_pae"))])
    cut = flows.cut_component(rows, PRESETS["antibody_softgate"], ["id"], ["key"], 5)
    _, want = flows.score_component(rows, PRESETS["antibody_softgate"], ["id"], ["key"], 5)
    assert "LogicalRDD" not in plan_of(cut)
    assert [tuple(r) for r in cut.select("key", "rank_in_group").orderBy("key").collect()] == [tuple(r) for r in want.select("key", "rank_in_group").orderBy("key").collect()]


def test_verify_order_joins_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(v):
        seen.add(1)
        return v

    rows = [("a_1", "AAGCTTT", 1), ("b_1", "AANNNTT", 2), ("c_1", "AAGCTTGCTT", 3), ("a_2", "AAGCTTT", 4), ("z_1", "AATT", 5)]
    oligos = spark.createDataFrame(rows, "id string, oligo string, row int").withColumn("oligo", named("oligo"))
    peptides = spark.createDataFrame([("a", "A"), ("b", "A"), ("c", "AA"), ("d", "C")], "name string, seq string")
    got = {tuple(r) for r in verify_order(oligos, peptides, "AA", "TT").collect()}
    assert got == {("a_2", "more_than_one_encoding"), ("b_1", "untranslatable_core"), ("c_1", "unequal_length"), ("z_1", "unknown_peptide"), ("d", "no_encoding")}
    assert seen.value == 5  # oligos are read for their checks once


def test_assembled_texts_move_once_per_step(spark):
    fields = "component string, design_ID string, sequence string, designedSequence string"
    part = lambda rows: to_library_schema(spark.createDataFrame(rows, fields), keep=("component",))
    one = part([("C1", "a", "ACD", "aCD"), ("C1", "b", "KLM", "own"), ("C1", "c", None, "x")])
    out = flows.assemble([one, part([("C4", "d", "ACD", "ACd"), ("C4", "e", "XYZ", "xyz")])])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any("sequence#" in line and "hashpartitioning(sequence" in line for line in plan.splitlines())
    got = [(r["library_member"], r["design_ID"], r["sequence"], r["designedSequence"]) for r in out.orderBy("design_ID").collect()]
    assert got == [("LIB_1", "a", "ACD", "aCD"), ("LIB_2", "b", "KLM", "own"), ("LIB_3", "c", None, "x"), ("LIB_4", "e", "XYZ", "xyz")]


def _library_rows(spark, name, sequence, rows=300):
    """Two arms over the same sequences; names and sequences follow from the row number ``id``."""
    arm = lambda c, start: spark.range(start, start + rows).select(
        F.lit(c).alias("component"), F.expr(name).alias("design_ID"), F.expr(sequence).alias("sequence"), F.lower(F.expr(sequence)).alias("designedSequence")
    )
    return [to_library_schema(arm(c, start), keep=("component",)) for c, start in (("C4", 0), ("C1", rows // 2), ("other", 0))]


def _assembled_plainly(parts):
    """One row per sequence by (component, name), numbered by (component, name, sequence), without Spark."""
    place = {c: i for i, c in enumerate(flows.COMPONENT_ORDER)}
    rows = sorted((place.get(r["component"], 99), r["design_ID"] is not None, r["design_ID"] or "", r["sequence"]) for p in parts for r in p.collect())
    kept = sorted({r[3]: r for r in reversed(rows)}.values())
    return [(f"LIB_{i + 1}", r[2] if r[1] else None, r[3]) for i, r in enumerate(kept)]


@pytest.mark.parametrize("limit", ["40", "100000"])
def test_library_is_numbered_without_its_texts(spark, limit):
    spark.conf.set(ROWS_PER_TASK_CONF, limit)
    try:
        parts = _library_rows(spark, "concat('d', id)", "concat('AC', id % 280)")
        out = flows.assemble(parts)
        plan = plan_of(out)
        assert "LogicalRDD" not in plan  # no row is written before it is numbered
        windows = [line for line in plan.splitlines() if "Window" in line or "RepartitionByExpression" in line]
        assert windows and not any("designedSequence" in line for line in windows)
        got = out.select("library_member", "design_ID", "sequence").collect()
        assert sorted(map(tuple, got)) == sorted(_assembled_plainly(parts))
        # copies of whole rows change nothing, and are not a reason to move texts for their numbers
        twice = flows.assemble([*parts, *parts])
        assert "LogicalRDD" not in plan_of(twice)
        assert sorted(map(tuple, twice.select("library_member", "design_ID", "sequence").collect())) == sorted(map(tuple, got))
    finally:
        spark.conf.unset(ROWS_PER_TASK_CONF)


@pytest.mark.parametrize("name", ["concat('d', id div 2)", "if(id % 3 = 0, null, concat('d', id))", "cast(null as string)", "concat('d', id div 2, '_d', id div 2, '_0_model')"])
def test_names_of_several_sequences_are_numbered_by_them(sliced, name):
    parts = _library_rows(sliced, name, "concat('AC', 1000 - id % 280)", 60)
    out = flows.assemble(parts).select("library_member", "design_ID", "sequence").collect()
    want = [(member, d and d.split("_")[0] + ("_0_model" if "_" in d else ""), s) for member, d, s in _assembled_plainly(parts)]
    assert sorted(map(tuple, out)) == sorted(want)


def test_census_and_cut_points(sliced):
    rows = sliced.range(1_000).select(F.format_string("k%04d", "id").alias("k"))
    n, most, sample = O.key_census(rows, F.col("k"))
    assert (n, most, sample) == (1_000, 1, [f"k{i:04d}" for i in range(1_000)])
    assert O.key_census(rows.union(rows.limit(1)), F.col("k"))[:2] == (1_001, 2)
    assert O.key_census(sliced.sql("SELECT cast(null as string) AS k"), F.col("k"))[:2] == (1, 2)
    assert O.key_census(rows.limit(0), F.col("k")) == (0, 0, []) and O.cut_points([], 5) == []
    for slices in (1, 7, 64, 5_000):
        points = O.cut_points(sample, slices)
        assert len(points) < slices
        got = rows.select("k", O.slice_of(F.col("k"), points).alias("s")).collect()
        assert all(r["s"] == sum(p <= r["k"] for p in points) for r in got)
        ranked = O.rank_between(rows, F.col("k"), points, ["k"], "n").collect()
        assert all(r["n"] == int(r["k"][1:]) + 1 for r in ranked) and len(ranked) == 1_000


def test_numbering_works_its_rows_out_once(sliced):
    orders = sliced.read.parquet("/root/testdata/sf0.001/orders.parquet").repartition(8, "o_orderkey")
    rows = orders.select(F.format_string("k%08d", "o_orderkey").alias("k"))
    out = O.rank_between(rows, F.col("k"), ["k00000300", "k00000700"], ["k"], "n")
    assert len(out.collect()) == rows.count()
    assert out._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1


def test_letters_of_a_library_are_found_once(spark):
    from peptarium.catalog.sequences import _library_parts

    for part in _library_parts(spark, "/root/testdata/sf0.001"):
        assert plan_of(part.select("design_ID", "sequence", "designedSequence")).count("regexp_replace") == 1


def test_longest_block_gets_pairs_in_small_lots(spark):
    rows = spark.createDataFrame([(1, "abcdefgh"), (2, "xxxx")], "k int, a_seq string")
    out = longest_block(rows, rows.withColumnRenamed("a_seq", "b_seq"), ["k"])
    assert [tuple(r) for r in out.collect()] == [(1, 8, 0, 0)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_values_of_a_percentile_are_not_written(spark, monkeypatch):
    written, freeze = [], O.freeze

    def counted(df):
        out = freeze(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(O, "freeze", counted)
    monkeypatch.setattr(O, "BROADCAST_STEPS", 1_000)
    rows = spark.range(6_000).select("id", (F.col("id") % 2).alias("g"), (1_000 + F.col("id") / 64.0).alias("v"), (F.col("id") % 3).cast("double").alias("w"))
    got = O.with_ranks(rows, {"v": "rv", "w": "rw"}, ["g"], pct=True)
    # id is the (id // 2 + 1)th of the 3,000 in its group
    assert got.where(F.abs(F.col("rv") - (F.floor(F.col("id") / 2) + 1) / 3_000) < 1e-12).count() == 6_000
    assert {round(r["rw"], 9) for r in got.collect()} == {round((1_000 * k + 500.5) / 3_000, 9) for k in range(3)}
    assert 0 < sum(written) <= 2_000
