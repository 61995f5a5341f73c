import difflib
import random

import pytest

from peptarium.operators import joins as J
from peptarium.operators import validation as V
from peptarium.operators.numbering import number_members, quote_names, runs


def test_merge_runs_needs_equal_unique_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    assert J.merge_runs(a, a.withColumnRenamed("a", "b"), "k").count() == 2
    for bad in (a.limit(1), a.union(a)):
        with pytest.raises(ValueError, match="same k values"):
            J.merge_runs(a, bad.withColumnRenamed("a", "b"), "k")


def test_attach_by_position_checks_length(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "row_idx int, a string")
    with pytest.raises(ValueError, match="row count mismatch"):
        J.attach_by_position(a, a.limit(1))


def test_longest_block_matches_difflib(sliced):
    rng = random.Random(5)
    pairs = []
    for i in range(25):
        core = "".join(rng.choice("ACDE") for _ in range(rng.randint(4, 25)))
        mk = lambda: "".join(rng.choice("ACDE") for _ in range(rng.randint(0, 30)))
        pairs.append((i, mk() + core + mk(), mk() + core + mk()))
    pairs.append((99, "A" * 40, "A" * 33))
    a = sliced.createDataFrame([(i, x) for i, x, _ in pairs], "k int, a_seq string")
    b = sliced.createDataFrame([(i, y) for i, _, y in pairs], "k int, b_seq string")
    got = {r["k"]: (r["a_start"], r["b_start"], r["size"]) for r in J.longest_block(a, b, ["k"]).collect()}
    for i, x, y in pairs:
        m = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match(0, len(x), 0, len(y))
        assert got.get(i) == ((m.a, m.b, m.size) if m.size >= 5 else None)


def test_longest_block_of_long_repetitive_texts(spark):
    rng = random.Random(6)
    core = "".join(rng.choice("ACDE") for _ in range(30_000))
    x, y = "AC" * 30_000 + core + "A" * 10_000, "A" * 20_000 + core + "AC" * 25_000
    rows = [(1, x, y), (2, "A" * 100_000, "A" * 90_000), (3, "abcde", "vwxyz"), (4, "ab", "ab"), (5, "zzabcdezz", "abcde"), (6, "", "")]
    pairs = spark.createDataFrame(rows, "k int, a_seq string, b_seq string")
    got = {r["k"]: (r["size"], r["a_start"], r["b_start"]) for r in J.longest_block(pairs.select("k", "a_seq"), pairs.select("k", "b_seq"), ["k"]).collect()}
    size, at, other = got.pop(1)
    assert size >= 30_000 and x[at : at + size] == y[other : other + size]
    assert got == {2: (90_000, 0, 0), 5: (5, 2, 0)}


def test_wildcards_match_brute_force_and_stay_linear(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        chain = "".join(rng.choice("ABX") for _ in range(rng.randrange(0, 40)))
        rows.append((k, "".join(rng.choice("AB") for _ in range(rng.randrange(1, 7))), chain))
    rows += [(100, "A" * 300 + "B", "A" * 100_000 + "X"), (101, "B", None), (102, None, "A")]
    df = spark.createDataFrame(rows, "k int, q_seq string, c_seq string")
    got = {r["k"]: (r["start"], r["trim_c"]) for r in J.containment(df.select("k", "q_seq"), df.select("k", "c_seq"), ["k"], "X").collect()}
    want = {}
    for k, q, c in rows[:60]:
        fits = [i for i in range(len(c) - len(q) + 1) if all(y in ("X", x) for x, y in zip(q, c[i:]))]
        if fits:
            want[k] = (fits[0], len(c) - len(q) - fits[0])
    assert got == want | {100: (99_700, 0)}


@pytest.mark.parametrize("ship", [J.SHIP_CHARS, 0])
def test_contained_passages_match_brute_force(spark, ship):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(30)]
    passages = [(0, docs[3][1][10:80]), (1, docs[4][1][:15]), (2, "alpha"), (3, "ta gam"), (4, "nowhere to be found"), (5, docs[5][1]), (6, "  beta "), (7, "pha be")]
    passages += [(10 + w, docs[7][1][5 : 5 + w]) for w in range(1, 12)] + [(40, "alpha"), (41, ""), (42, None), (43, "a\U0001f642b")]
    docs += [(100, None), (101, ""), (102, "xx a\U0001f642b alpha")]
    got = J.contained_passages(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(passages, "p_id int, p_text string"), ship=ship)
    want = {(p, d, t.find(s)) for p, s in passages if s for d, t in docs if t and s in t}
    assert {(r["p_id"], r["doc_id"], r["start"]) for r in got.collect()} == want


def test_kmers_cover_the_whole_sequence(spark):
    seq = "".join(chr(97 + (i * 7 + i // 5) % 26) for i in range(900))
    rows = J.kmer_index(spark.createDataFrame([(1, seq)], "k int, s string"), ["k"], "s", 6).orderBy("pos").collect()
    assert [(r["pos"], r["kmer"]) for r in rows] == [(i, seq[i : i + 6]) for i in range(895)]


def test_relabel_takes_first_encoding_and_reports_missing(spark):
    oligos = spark.createDataFrame([("OLD_1_7", "ppGCTTGCss", 2), ("OLD_2_9", "ppGCTTGTss", 1), ("OLD_3_1", "ppNNNTGCss", 0)], "id string, oligo string, row int")
    peptides = spark.createDataFrame([("N1", "AC"), ("N2", "WW")], "name string, seq string")
    got = {r["name"]: (r["id"], r["oligo"]) for r in J.relabel_by_sequence(oligos, peptides, "pp", "ss").collect()}
    assert got == {"N1": ("N1_9", "ppGCTTGTss"), "N2": ("N2_1", None)}


def test_verify_order_first_failure_only(spark):
    oligos = [("a_1", "ppGCTss", 1), ("a_2", "ppGCTss", 2), ("b_1", "xxGCTss", 3), ("c_1", "ppGCTTss", 4), ("d_1", "ppTGCss", 5), ("q_1", "ppGCTss", 6), ("l_1", "ppGCTGCTss", 7)]
    peptides = [("a", "A"), ("b", "A"), ("c", "A"), ("d", "A"), ("e", "A"), ("l", "AA")]
    got = V.verify_order(spark.createDataFrame(oligos, "id string, oligo string, row int"), spark.createDataFrame(peptides, "name string, seq string"), "pp", "ss")
    assert {(r["subject"], r["reason"]) for r in got.collect()} == {
        ("a_2", "more_than_one_encoding"), ("b_1", "prefix_mismatch"), ("c_1", "wrong_length"), ("d_1", "other_peptide"),
        ("q_1", "unknown_peptide"), ("l_1", "unequal_length"), ("e", "no_encoding"),
    }


def test_numbering_labels_and_runs(sliced):
    df = sliced.range(200).withColumnRenamed("id", "k")
    numbered = number_members(df, ["k"], "M_")
    assert sorted(int(r["library_member"][2:]) for r in numbered.collect()) == list(range(1, 201))
    assert numbered.where("k = 7").first()["library_member"] == "M_8"
    assert quote_names(numbered.where("k = 7"), 3).first()["name"] == "LIB_00008"
    ints = sliced.createDataFrame([(1, i) for i in (*range(60), 70, 71, 90)], "g int, n int")
    assert sorted((r["run_start"], r["run_end"], r["run_size"]) for r in runs(ints, ["g"], "n").collect()) == [(0, 59, 60), (70, 71, 2), (90, 90, 1)]
