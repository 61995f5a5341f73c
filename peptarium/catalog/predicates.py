"""Filters, predicates, projections, keys and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from peptarium.catalog import REGISTRY
from peptarium.catalog.views import CASED_SQL, CONTIGS_SQL, PASS_SQL, POOL_SQL, SEQS_SQL, contigs, pool, r6, seqs, table
from peptarium.functions import keys
from peptarium.functions.numeric import num
from peptarium.functions.sequences import ORDER_PREFIX, ORDER_SUFFIX
from peptarium.operators import predicates as P
from peptarium.operators import validation as V


@REGISTRY.add(
    "p1_numeric_coercion",
    "SELECT doc_id, TRY_CAST(split_part(source, 'c', 2) AS DOUBLE) AS number, TRY_CAST(lang AS DOUBLE) AS word FROM documents",
)
def numeric_coercion(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", num(F.split_part("source", F.lit("c"), F.lit(2))).alias("number"), num("lang").alias("word"))


@REGISTRY.add("p2_gate", f"WITH {POOL_SQL} SELECT key, epitope_pae FROM pool WHERE epitope_pae <= 2.5")
def gate(spark, sf):
    return P.gate(pool(spark, sf), "epitope_pae", 2.5).select("key", "epitope_pae")


@REGISTRY.add("p3_multi_gate", f"WITH {POOL_SQL} SELECT key FROM pool WHERE overall_rmsd < 2 AND epitope_pae <= 3 AND af3_n_clash_res > 5 AND mean_pae >= 1")
def multi_gate(spark, sf):
    spec = [
        P.Condition("overall_rmsd", "<", 2),
        P.Condition("epitope_pae", "<=", 3),
        P.Condition("af3_n_clash_res", ">", 5),
        P.Condition("mean_pae", ">=", 1),
        P.Condition("not_there", "<", 1),
    ]
    return P.gates(pool(spark, sf), spec).select("key")


@REGISTRY.add("p4_four_filter", f"WITH {POOL_SQL}, q AS (SELECT * REPLACE (af3_n_clash_res - 1 AS af3_n_clash_res) FROM pool) SELECT key, {PASS_SQL} AS is_pass FROM q")
def four_filter(spark, sf):
    rows = pool(spark, sf).withColumn("af3_n_clash_res", F.col("af3_n_clash_res") - 1)
    return P.four_filter(rows).select("key", "is_pass")


VARIANT_SQL = {
    "inclusive_pae": "overall_rmsd <= 2 AND epitope_chunk_rmsd <= 1 AND mean_pae <= 5 AND af3_n_clash_res = 0",
    "strict_no_clash": "overall_rmsd < 2 AND epitope_chunk_rmsd < 1 AND mean_pae < 5",
    "strict_max_clash": "overall_rmsd < 2 AND epitope_chunk_rmsd < 1 AND mean_pae < 5 AND af3_n_clash_res <= 5",
    "swapped": "epitope_chunk_rmsd < 2 AND overall_rmsd < 1",
    "relaxed": "mean_pae < 7 AND overall_rmsd < 3 AND epitope_chunk_rmsd < 2 AND af3_n_clash_res = 1",
}


@REGISTRY.add(
    "p4a_filter_variants",
    f"WITH {POOL_SQL} SELECT key, " + ", ".join(f"coalesce({e}, false) AS {n}" for n, e in VARIANT_SQL.items()) + " FROM pool",
)
def filter_variants(spark, sf):
    return pool(spark, sf).select("key", *[P.all_of(P.PASS_VARIANTS[n]).alias(n) for n in VARIANT_SQL])


def _fold(e, s, ep, sp):
    return f"count(*) FILTER (epitope_chunk_rmsd <= {e} AND scaffold_rmsd <= {s} AND epitope_pae < {ep} AND scaffold_pae < {sp} AND c = 0)"


@REGISTRY.add(
    "p5_fold_conditions",
    f"""WITH {POOL_SQL}, q AS (SELECT *, coalesce(af3_n_clash_res - 1, 1) AS c FROM pool),
t AS (SELECT count(*) AS n, {_fold(1, 2, 5, 5)} AS a, {_fold(1, 5, 5, 10)} AS b, {_fold(3, 2, 10, 5)} AS d, {_fold(3, 5, 10, 10)} AS e FROM q)
SELECT unnest(['rigid_rigid', 'rigid_epitope_flexible_scaffold', 'flexible_epitope_rigid_scaffold', 'flexible_flexible']) AS condition,
  unnest([a, b, d, e]) AS n_pass, round(unnest([100.0::DOUBLE * a / n, 100.0::DOUBLE * b / n, 100.0::DOUBLE * d / n, 100.0::DOUBLE * e / n]), 6) AS pct FROM t""",
)
def fold_conditions(spark, sf):
    rows = pool(spark, sf).withColumn("af3_n_clash_res", F.col("af3_n_clash_res") - 1)
    return r6(P.fold_condition_counts(rows))


@REGISTRY.add("p6_status_ok", f"WITH {POOL_SQL} SELECT key FROM pool WHERE lower(status) = 'ok'")
def status_ok(spark, sf):
    return P.status_ok(pool(spark, sf)).select("key")


@REGISTRY.add(
    "p7_exclusions",
    "SELECT p_partkey FROM part WHERE NOT lower(p_name) LIKE 'red%' AND NOT lower(p_name) LIKE 'blue%' AND lower(p_type) <> 'economy' AND p_partkey <> 17",
)
def exclusions(spark, sf):
    p = P.exclude_prefix(table(spark, sf, "part"), "p_name", ["RED", "blue"])
    return P.exclude_values(P.exclude_values(p, "p_type", ["Economy"]), "p_partkey", ["17"]).select("p_partkey")


@REGISTRY.add("p8_drop_uncomputable", f"WITH {POOL_SQL} SELECT key FROM pool WHERE af3_n_clash_res IS NOT NULL OR island_index < 7")
def drop_uncomputable(spark, sf):
    state = F.when(F.col("af3_n_clash_res").isNull() & (F.col("island_index") >= 7), "too_few_epitope_pairs").when(F.col("island_index") == 3, "ok")
    return P.drop_uncomputable(pool(spark, sf).withColumn("af3_clash_status", state)).select("key")


@REGISTRY.add(
    "p9_alias_weights",
    f"WITH {POOL_SQL} SELECT key, round(overall_rmsd * (0.3 / 0.8) + epitope_chunk_rmsd * (0.5 / 0.8), 6) AS term_sum FROM pool",
)
def alias_weights(spark, sf):
    rows = pool(spark, sf)
    spec = {"overall": (("rmsd_all", "overall_rmsd"), 0.3), "epitope": (("epitope_chunk_rmsd", "x"), 0.5), "gone": (("nowhere",), 0.2)}
    terms = [F.col(c) * F.lit(w) for c, w in P.resolve_aliases(rows, spec).values()]
    return r6(rows.select("key", (terms[0] + terms[1]).alias("term_sum")))


@REGISTRY.add("p10_contract_projection", f"WITH {CONTIGS_SQL} SELECT id, contig_id, contig_string, contig_length FROM contigs")
def contract_projection(spark, sf):
    return P.project_contract(contigs(spark, sf), ("id", "contig_id", "contig_string", "contig_length", "absent"))


@REGISTRY.add(
    "p11_library_schema",
    f"""WITH {POOL_SQL} SELECT key, NULL::VARCHAR AS sequence, epitope_chunk_rmsd AS epitope_rmsd, overall_rmsd, epitope_pae, scaffold_pae, mean_pae,
  NULL::DOUBLE AS ptm, af3_n_clash_res AS af3_clashes, cylinder_native_aware AS cylinder_clashes, island_index FROM pool""",
)
def library_schema(spark, sf):
    shaped = P.to_library_schema(pool(spark, sf), keep=("key",))
    metrics = ("epitope_rmsd", "overall_rmsd", "epitope_pae", "scaffold_pae", "mean_pae", "ptm", "af3_clashes", "cylinder_clashes")
    return shaped.select("key", "sequence", *metrics, "island_index")


@REGISTRY.add("p12_collapse_id", "SELECT p_partkey, p_name || '_' || (p_partkey % 7) || '_model' AS id FROM part")
def collapse_id(spark, sf):
    p = table(spark, sf, "part")
    doubled = F.concat("p_name", F.lit("_"), "p_name", F.lit("_"), (F.col("p_partkey") % 7).cast("string"), F.lit("_model"))
    return p.select("p_partkey", keys.collapse_id(doubled).alias("id"))


@REGISTRY.add(
    "p13_parse_keys",
    """SELECT l_orderkey AS contig_id, l_suppkey AS seed, l_linenumber AS rep, 'p' || l_partkey AS id, 'p' || l_partkey || '_x' AS base FROM lineitem""",
)
def parse_keys(spark, sf):
    li = table(spark, sf, "lineitem")
    stem = F.format_string("p%d__contig%d__seed%d__rep%d_0_fixed_dldesign_3", "l_partkey", "l_orderkey", "l_suppkey", "l_linenumber")
    mutant = F.concat(F.lit("C1_p"), F.col("l_partkey").cast("string"), F.lit("_x_scaffoldMutX3_r4"))
    return li.select(keys.parse_key(stem, "contig").alias("k"), keys.strip_mutation(keys.strip_library_key(mutant)).alias("base")).select(
        F.col("k.contig_id").cast("bigint").alias("contig_id"), F.col("k.seed").cast("bigint").alias("seed"), F.col("k.rep").alias("rep"), F.col("k.id").alias("id"), "base"
    )


@REGISTRY.add(
    "p14_paths",
    f"WITH {CONTIGS_SQL} SELECT contig_id, '/new/root' || substr(input_pdb, 6) AS moved, contig_id || '.pdb' AS base FROM contigs",
)
def paths(spark, sf):
    c = contigs(spark, sf)
    return c.select("contig_id", keys.remap_prefix("input_pdb", "/data", "/new/root").alias("moved"), keys.basename("input_pdb").alias("base"))


@REGISTRY.add(
    "p15_even_sample",
    """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE p IN (SELECT CAST(floor(i * (SELECT count(*) FROM orders) / 100.0) AS BIGINT) FROM range(100) t(i))""",
)
def even_sample(spark, sf):
    return P.even_sample(table(spark, sf, "orders").select("o_orderkey"), 100, ["o_orderkey"])


HASH_SQL = "('0x' || substr(md5({x}), 1, 15))::BIGINT"


@REGISTRY.add(
    "p15_seeded_sample",
    f"SELECT o_orderkey FROM orders ORDER BY {HASH_SQL.format(x='o_orderkey || chr(124) || 7')}, o_orderkey LIMIT 500",
)
def seeded_sample(spark, sf):
    return P.sample_n(table(spark, sf, "orders").select("o_orderkey"), 500, ["o_orderkey"], seed=7)


@REGISTRY.add(
    "n17_index_lists",
    f"WITH {CONTIGS_SQL} SELECT contig_id, array_to_string(epitope_resindices, ',') AS positions, CASE WHEN contig_id % 3 > 0 THEN len(epitope_resindices) END AS n FROM contigs",
)
def index_lists(spark, sf):
    c = contigs(spark, sf).withColumn("text", F.concat(F.lit("["), F.array_join(F.col("epitope_resindices").cast("array<string>"), " "), F.lit("]")))
    listed = F.when(F.col("contig_id") % 3 > 0, F.col("epitope_resindices"))
    return c.select("contig_id", F.array_join(keys.parse_index_list("text").cast("array<string>"), ",").alias("positions"), keys.list_len(listed).cast("bigint").alias("n"))


# ---------------------------------------------------------------- validation


@REGISTRY.add("v1_required_columns", f"WITH {CONTIGS_SQL} SELECT id, contig_id FROM contigs")
def required_columns(spark, sf):
    return P.require_columns(contigs(spark, sf), ["id", "contig_id", "contig_string"]).select("id", "contig_id")


@REGISTRY.add(
    "v2_validate_peptides",
    f"""WITH {SEQS_SQL}, p AS (SELECT source || '_' || (id % 90) || CASE WHEN id % 50 = 0 THEN ',x' ELSE '' END AS name, seq FROM seqs)
SELECT name AS subject, 'bad_character_in_name' AS reason FROM p WHERE contains(name, ',')
UNION ALL SELECT name, 'off_alphabet' FROM p WHERE regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWY]')
UNION ALL SELECT name, 'line_too_long' FROM p WHERE length(name) + length(seq) + 1 > 128
UNION ALL SELECT name, 'duplicate_name' FROM p GROUP BY name HAVING count(*) > 1""",
)
def validate_peptides(spark, sf):
    s = seqs(spark, sf)
    name = F.concat("source", F.lit("_"), (F.col("id") % 90).cast("string"), F.when(F.col("id") % 50 == 0, ",x").otherwise(""))
    return V.validate_peptides(s.select(name.alias("name"), "seq"))


@REGISTRY.add(
    "v3_validate_new",
    f"""WITH {SEQS_SQL}, p AS (SELECT id::VARCHAR AS name, seq FROM seqs)
SELECT name AS subject, 'wrong_length' AS reason FROM p WHERE length(seq) <> 103
UNION ALL SELECT name, 'off_alphabet' FROM p WHERE regexp_matches(seq, '[^ACDEFGHIKLMNPQRSTVWY]')
UNION ALL SELECT seq, 'duplicate_sequence' FROM p GROUP BY seq HAVING count(*) > 1""",
)
def validate_new(spark, sf):
    return V.validate_new(seqs(spark, sf).select(F.col("id").cast("string").alias("name"), "seq"), 103)


# coding sequence of a part number: one alanine, cysteine, ... codon per decimal digit
DIGIT_CODONS = ("GCT", "TGC", "GAT", "GAA", "TTC", "GGT", "CAC", "ATT", "AAA", "CTG")
DIGIT_AMINO = "ACDEFGHIKL"
DIGITS = "0123456789"


def oligo_views(spark, sf):
    """Peptides spelled from order keys, and order oligos with planted faults by key."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    digits = F.lpad((F.col("k") % 100000).cast("string"), 5, "0")
    pep = F.translate(digits, DIGITS, DIGIT_AMINO)
    code = F.array_join(F.transform(F.split(digits, ""), lambda d: F.element_at(F.array(*[F.lit(c) for c in DIGIT_CODONS]), d.cast("int") + 1)), "")
    peptides = o.where(F.col("k") % 11 != 3).select(F.concat(F.lit("LIB_"), "k").alias("name"), pep.alias("seq"))
    body = (
        F.when(F.col("k") % 97 == 5, F.concat(F.lit("TTT"), F.substring(code, 4, 99)))
        .when(F.col("k") % 97 == 6, F.concat(F.lit("NNN"), F.substring(code, 4, 99)))
        .when(F.col("k") % 97 == 7, F.concat(code, F.lit("A")))
        .otherwise(code)
    )
    prefix = F.when(F.col("k") % 97 == 8, F.lit("A" * 20)).otherwise(F.lit(ORDER_PREFIX))
    suffix = F.when(F.col("k") % 97 == 9, F.lit("A" * 20)).otherwise(F.lit(ORDER_SUFFIX))
    oligos = o.where(F.col("k") % 89 != 1).select(F.concat(F.lit("LIB_"), "k", F.lit("_00050")).alias("id"), F.concat(prefix, body, suffix).alias("oligo"), F.col("k").alias("row"))
    return oligos, peptides


_CODE_SQL = "list_aggregate(list_transform(string_split(d, ''), lambda x: [{}][x::INT + 1]), 'string_agg', '')".format(", ".join(f"'{c}'" for c in DIGIT_CODONS))
OLIGO_SQL = f"""ord AS (SELECT o_orderkey AS k, lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS d FROM orders),
coded AS (SELECT k, translate(d, '{DIGITS}', '{DIGIT_AMINO}') AS pep, {_CODE_SQL} AS code FROM ord),
peptides AS (SELECT 'LIB_' || k AS name, pep AS seq FROM coded WHERE k % 11 <> 3),
oligos AS (SELECT 'LIB_' || k || '_00050' AS id, 'LIB_' || k AS name, k AS row, k, code, pep,
  CASE WHEN k % 97 = 8 THEN '{"A" * 20}' ELSE '{ORDER_PREFIX}' END
  || CASE k % 97 WHEN 5 THEN 'TTT' || substr(code, 4) WHEN 6 THEN 'NNN' || substr(code, 4) WHEN 7 THEN code || 'A' ELSE code END
  || CASE WHEN k % 97 = 9 THEN '{"A" * 20}' ELSE '{ORDER_SUFFIX}' END AS oligo FROM coded WHERE k % 89 <> 1)"""


@REGISTRY.add(
    "v4_verify_order",
    f"""WITH {OLIGO_SQL}
SELECT id AS subject, CASE WHEN k % 11 = 3 THEN 'unknown_peptide' WHEN k % 97 = 8 THEN 'prefix_mismatch' WHEN k % 97 = 9 THEN 'suffix_mismatch'
  WHEN k % 97 = 7 THEN 'wrong_length' WHEN k % 97 = 6 THEN 'untranslatable_core' ELSE 'other_peptide' END AS reason
FROM oligos WHERE k % 11 = 3 OR k % 97 IN (6, 7, 8, 9) OR (k % 97 = 5 AND substr(pep, 1, 1) <> 'F')
UNION ALL SELECT name, 'no_encoding' FROM peptides WHERE name NOT IN (SELECT name FROM oligos)""",
)
def verify_order(spark, sf):
    oligos, peptides = oligo_views(spark, sf)
    return V.verify_order(oligos, peptides, ORDER_PREFIX, ORDER_SUFFIX)


@REGISTRY.add(
    "v5_verify_quote",
    f"""WITH {OLIGO_SQL} SELECT count(*) AS n, count(*) FILTER (length(oligo) <> 55) AS bad_length,
  count(*) FILTER (NOT (starts_with(oligo, '{ORDER_PREFIX}') AND ends_with(oligo, '{ORDER_SUFFIX}'))) AS bad_adapters,
  count(*) - count(DISTINCT k) AS duplicates, (min(k) = 1 AND max(k) = count(*) AND count(*) = count(DISTINCT k)) AS contiguous,
  count(*) = (SELECT count(*) FROM peptides) AS matches_library FROM oligos""",
)
def verify_quote(spark, sf):
    oligos, peptides = oligo_views(spark, sf)
    return V.verify_quote(oligos, "row", "oligo", ORDER_PREFIX, ORDER_SUFFIX, 55, peptides.count())


@REGISTRY.add(
    "v6_reconcile",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
lib AS (SELECT o_orderkey, o_orderpriority, rn FROM r WHERE rn <= 100 OR (o_orderpriority = '5-LOW' AND rn = 150))
SELECT o_orderpriority, count(*) AS n_selected, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END::BIGINT AS n_unmatched, max(rn) = count(*) AS contiguous
FROM lib GROUP BY o_orderpriority""",
)
def reconcile(spark, sf):
    from peptarium.operators.ordering import row_rank

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ranked = row_rank(o, ["o_orderpriority"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    library = ranked.where((F.col("rank_in_group") <= 100) | ((F.col("o_orderpriority") == "5-LOW") & (F.col("rank_in_group") == 150)))
    ghost = o.where(F.col("o_orderpriority") == "1-URGENT").agg(F.max("o_orderkey").alias("k")).select((-F.col("k") - 1).alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    library = library.select("o_orderkey", "o_orderpriority").unionByName(ghost)
    return V.reconcile(ranked, library, ["o_orderkey"], ["o_orderpriority"])


@REGISTRY.add(
    "v7_diff_report",
    f"""WITH {POOL_SQL}, d AS (SELECT abs(overall_rmsd - round(overall_rmsd, 1)) AS a, abs(mean_pae - round(mean_pae, 1)) AS b FROM pool)
SELECT 'overall_rmsd' AS metric, count(*) AS n, round(avg(a), 6) AS mean_diff, round(max(a), 6) AS max_diff, count(*) FILTER (a > 0.01) AS n_over FROM d
UNION ALL SELECT 'mean_pae', count(*), round(avg(b), 6), round(max(b), 6), count(*) FILTER (b > 0.01) FROM d""",
)
def diff_report(spark, sf):
    calc = pool(spark, sf).select("key", "overall_rmsd", "mean_pae")
    stored = calc.withColumns({c: F.round(c, 1) for c in ("overall_rmsd", "mean_pae")})
    return r6(V.diff_report(calc, stored, ["key"], ["overall_rmsd", "mean_pae"]))


@REGISTRY.add(
    "v8_verify_novel",
    f"""WITH {CASED_SQL}, o AS (SELECT id, scaffoldEPITOPE AS s FROM cased),
r AS (SELECT id, CASE id % 4 WHEN 0 THEN s WHEN 1 THEN lower(s) || 'a' ELSE 'Z' || substr(s, 2) END AS t, [0, 3, 5, 100000] AS p FROM o WHERE id % 5 < 4),
j AS (SELECT o.s, r.t, r.p FROM o LEFT JOIN r USING (id)),
k AS (SELECT *, list_filter(p, lambda x: x < least(length(s), length(t))) AS q FROM j)
SELECT count(*) AS n, count(t) AS n_covered, count(*) FILTER (s = t) AS n_identical, count(*) FILTER (s <> t) AS n_different,
  count(*) FILTER (s <> t AND len(q) > 0 AND list_aggregate(list_transform(q, lambda x: upper(s)[x + 1] = upper(t)[x + 1]), 'bool_and')) AS n_epitope_ok FROM k""",
)
def verify_novel(spark, sf):
    from peptarium.catalog.views import cased

    ours = cased(spark, sf).select(F.col("id").alias("token"), F.col("scaffoldEPITOPE").alias("design_seq"))
    s = F.col("design_seq")
    other = F.when(F.col("token") % 4 == 0, s).when(F.col("token") % 4 == 1, F.concat(F.lower(s), F.lit("a"))).otherwise(F.concat(F.lit("Z"), F.substring(s, 2, 1 << 30)))
    positions = F.array(*[F.lit(p) for p in (0, 3, 5, 100000)])
    reference = ours.where(F.col("token") % 5 < 4).select("token", other.alias("ref_seq"), positions.alias("positions"))
    return V.verify_novel(ours, reference)
