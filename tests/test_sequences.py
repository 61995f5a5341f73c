import pytest
from pyspark.sql import functions as F

from peptarium.functions import contigs as C
from peptarium.functions import keys
from peptarium.functions import sequences as S


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "length, mer, step, cterm, want",
    [(10, 4, 2, True, [1, 3, 5, 7]), (13, 4, 4, True, [1, 5, 9, 10]), (13, 4, 4, False, [1, 5, 9]), (3, 4, 2, True, []), (900, 7, 3, True, None)],
)
def test_tiling(spark, length, mer, step, cterm, want):
    seq = "".join("ACDEFGHIKLMNPQRSTVWY"[(i * i + i // 3) % 20] for i in range(length))
    rows = S.tile(spark.createDataFrame([(seq,)], "seq string"), "seq", mer, step, cterm, prefix="G").orderBy("start").collect()
    if want is None:
        want = list(range(1, length - mer + 2, step))
        want += [length - mer + 1] if want[-1] != length - mer + 1 else []
    assert [r["start"] for r in rows] == want
    assert all(r["tile"] == seq[r["start"] - 1 : r["start"] - 1 + mer] and r["construct"] == "G" + r["tile"] for r in rows)


def test_contig_positions(spark):
    got = one(spark, C.contig_positions(F.lit("2-2/A5-7/3-3/A10-10/4-4")))
    assert list(got["design"]) == [2, 3, 4, 8] and list(got["native"]) == [4, 5, 6, 9]


def test_bad_contig_is_an_error(spark):
    with pytest.raises(Exception, match="unparseable contig"):
        one(spark, C.contig_positions(F.lit("2-2/B5-7")))


def test_segment_positions(spark):
    got = one(spark, C.segment_positions(F.array(F.lit(4), F.lit(2), F.lit(9)), F.array(F.lit(2), F.lit(1))))
    assert list(got) == [4, 5, 8]


@pytest.mark.parametrize(
    "contig, want, where",
    [
        ("50-50/A1-10/44-44", "49-49/A1-10/44-44", "N"),
        ("47-47/A1-10/47-47", "47-47/A1-10/46-46", "C"),
        ("0-0/A1-40/9-9/A60-70/20-20/A80-103/0-0", "0-0/A1-40/9-9/A60-70/19-19/A80-103/0-0", "spacer@4"),
        ("0-0/A1-40/10-10/A60-93/10-10/A95-104/0-0", "0-0/A1-40/9-9/A60-93/10-10/A95-104/0-0", "spacer@2"),
        ("A1-50/54-54", "A1-50/53-53", "C"),
    ],
)
def test_shorten_contig(spark, contig, want, where):
    got = one(spark, C.shorten_contig(F.lit(contig)))
    assert (got["contig"], got["where"]) == (want, where)


@pytest.mark.parametrize("contig", ["50-50/A1-10/43-43", "A1-104"])
def test_shorten_contig_errors(spark, contig):
    with pytest.raises(Exception, match="cannot shorten"):
        one(spark, C.shorten_contig(F.lit(contig)))


def test_compositions_invariants(spark):
    targets = spark.createDataFrame([("t", [(10, 14), (20, 20)]), ("u", [(5, 30)])], "target string, islands array<struct<a:int,b:int>>")
    rows = C.compositions(targets, 30, length=60, seed=1).collect()
    assert len({(r["target"], r["contig_string"]) for r in rows}) == len(rows)
    motif = {"t": 6, "u": 26}
    for r in rows:
        segs = [int(x) for x in r["scaffold_segs"].split(",")]
        assert min(segs) >= 3 and sum(segs) + motif[r["target"]] == 60
    assert sorted(r["contig_id"] for r in rows if r["target"] == "t") == list(range(30))


def test_compositions_are_all_there_are(spark):
    assert [C.composition(k, 3, 2) for k in range(6)] == [[0, 0, 2], [0, 1, 1], [0, 2, 0], [1, 0, 1], [1, 1, 0], [2, 0, 0]]
    targets = spark.createDataFrame([("t", [(10, 14), (20, 20)]), ("u", [(5, 30)]), ("v", [(1, 54)])], "target string, islands array<struct<a:int,b:int>>")
    rows = C.compositions(targets, 2000, length=60, seed=1).collect()
    count = {t: len({r["contig_string"] for r in rows if r["target"] == t}) for t in "tuv"}
    assert count == {"t": 1081, "u": 29, "v": 1} and len(rows) == sum(count.values())  # every split of 45, 28 and 0
    few = C.ranked_compositions(6, 90, 50, 123, 456)
    assert len({tuple(x) for x in few}) == 50 and all(sum(x) == 90 and min(x) >= 0 for x in few)


def test_compositions_with_native_gaps(spark):
    targets = spark.createDataFrame([("t", [(10, 14), (20, 20), (30, 31)])], "target string, islands array<struct<a:int,b:int>>")
    for r in C.compositions(targets, 10, length=60, native_gaps=True).collect():
        segs = [int(x) for x in r["scaffold_segs"].split(",")]
        assert segs[1:3] == [5, 9] and sum(segs) + 8 == 60


def test_flank_variants_single_is_centred(spark):
    df = spark.createDataFrame([("e", "5-5/A3-6/2-2/A9-9/5-5", [2, 4, 8])], "id string, contig_string string, epitope_resindices array<int>")
    rows = C.flank_variants(df, 1, length=20).collect()
    assert len(rows) == 1 and rows[0]["n_flank"] == 8 and list(rows[0]["epitope_resindices"]) == [2, 4]


@pytest.mark.parametrize("dna, want", [("GCTTGC", "AC"), ("GCTTG", None), ("GCTNNN", None), ("TAA", "*")])
def test_translate(spark, dna, want):
    assert one(spark, S.translate(F.lit(dna))) == want


def test_case_encoding(spark):
    assert one(spark, S.case_encode_positions(F.lit("ACDEF"), F.array(F.lit(1), F.lit(3)))) == "aCdEf"
    assert one(spark, S.case_encode_span(F.lit("ACDEF"), 3, 9)) == "acdEF"
    assert one(spark, S.case_encode_unique(F.lit("ACDACD"), F.lit("ACD")))["status"] == "epitope_not_unique"
    assert one(spark, S.case_encode_unique(F.lit("WWACDY"), F.lit("ACD")))["encoded"] == "wwACDy"


def test_trim(spark):
    long = "a" * 103
    assert one(spark, S.trim_to(F.lit(long)))["note"] == "already103"
    assert one(spark, S.trim_to(F.lit(long + "a")))["note"] == "cterm"
    assert one(spark, S.trim_to(F.lit(long + "K")))["seq"] == long[1:] + "K"
    assert one(spark, S.trim_to(F.lit("K" + long + "K")))["seq"] is None


def test_mutate_island(spark):
    s = F.lit("aaKLMaaWYaa")
    assert one(spark, S.mutate_island(s, 1)) == "aaAAAaaWYaa"
    assert one(spark, S.mutate_island(s, 1, every_other=True)) == "aaALAaaWYaa"
    assert one(spark, S.mutate_island(s, 2)) == "aaKLMaaAAaa"
    assert one(spark, S.mutate_island(s, 3)) is None


def test_disrupt_invariants(spark):
    seqs = ["a" * 60 + "KLM" + "c" * 40, "a" * 10 + "K" + "a" * 12, "a" * 9 + "K", "aaaKaaaKaaa", "g" * 30]
    df = spark.createDataFrame([(str(i), s) for i, s in enumerate(seqs)], "id string, s string")
    rows = df.select("id", "s", S.disrupt("s", "id").alias("d")).collect()
    for r in rows:
        s, d = r["s"], r["d"]
        if d is None:
            continue
        assert len(d["seq"]) == len(s)
        placed = [i for i in range(len(s)) if d["seq"][i] != s[i]]
        assert len(placed) == 6 * d["placed"]
        caps = [i for i, ch in enumerate(s) if ch.isupper()]
        assert all(abs(i - c) > 4 for i in placed for c in caps)
        assert d["seq"].count(S.HEXAMER) == d["placed"]
    by = {r["id"]: r["d"] for r in rows}
    assert by["0"]["placed"] == 4 and by["1"]["placed"] == 2 and by["2"] is None and by["3"] is None


def test_keys(spark):
    assert one(spark, keys.collapse_id(F.lit("ab_ab_0_model_1"))) == "ab_0_model_1"
    got = one(spark, keys.parse_key(F.lit("7ABC_res12_split3_model4_fixed_dldesign_5"), "tile"))
    assert got.asDict() == {"antigen": "7ABC", "res": 12, "split": 3, "model": 4, "dldesign": 5}
    assert one(spark, keys.parse_key(F.lit("nothing"), "contig")) is None
    assert one(spark, keys.parse_key(F.lit("a" * 32 + "_x_0_model_7_y"), "token"))["pred"] == 7
    assert one(spark, keys.strip_library_key(F.lit("C1_x_y_r12"))) == "x_y"
    assert one(spark, keys.strip_encoding(F.lit("LIB_12_00050"))) == "LIB_12"
    assert list(one(spark, keys.parse_index_list(F.lit("[1 -2, 30]")))) == [1, -2, 30]
    assert one(spark, keys.remap_prefix(F.lit("/a/b"), "/a", "/z")) == "/z/b"
    assert one(spark, keys.number_from_text(F.lit("100-104"))) == 104


def test_build_controls(spark):
    df = spark.createDataFrame([("d", "g" * 50 + "KL" + "g" * 20 + "MN" + "g" * 40, "t"), ("e", "gggKL", "t")], "design_ID string, designedSequence string, target string")
    names = sorted(r["design_ID"] for r in S.build_controls(df).collect())
    assert names == ["d_epitopeIsland1Mut>A", "d_epitopeIsland2Mut>A", "d_scaffoldMutX4", "e_epitopeIsland1Mut>A"]
