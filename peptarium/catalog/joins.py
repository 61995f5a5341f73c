"""Join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from peptarium.catalog import REGISTRY
from peptarium.catalog.predicates import OLIGO_SQL, oligo_views
from peptarium.catalog.scoring import SOFT_BONUS_SQL
from peptarium.catalog.views import POOL_SQL, READOUT_SQL, SEQS_SQL, pool, r6, readout, seqs, table
from peptarium.functions.keys import strip_mutation
from peptarium.functions.sequences import ORDER_PREFIX, ORDER_SUFFIX
from peptarium.operators import joins as J
from peptarium.operators import scoring, sets
from peptarium.plans.presets import PRESETS
from peptarium.session import spread


@REGISTRY.add(
    "j1_first_wins_lookup",
    """WITH f AS (SELECT lower(p_type) AS k, min_by(p_name, p_partkey) AS p_name, min_by(p_retailprice, p_partkey) AS p_retailprice FROM part GROUP BY 1)
SELECT p_partkey, f.p_name, f.p_retailprice FROM part LEFT JOIN f ON lower(part.p_type) = f.k""",
)
def first_wins(spark, sf):
    p = table(spark, sf, "part")
    df = p.select("p_partkey", F.upper("p_type").alias("p_type"))
    return J.lookup_first(df, p, "p_type", ["p_name", "p_retailprice"], ["p_partkey"]).select("p_partkey", "p_name", "p_retailprice")


@REGISTRY.add(
    "j2_ledger_join",
    """WITH led AS (SELECT o_orderkey AS l_orderkey, o_custkey % 7 + 1 AS l_linenumber, o_totalprice FROM orders)
SELECT ledger_status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (
  SELECT CASE WHEN led.l_orderkey IS NULL THEN 'no_ledger_row' ELSE 'ok' END AS ledger_status, o_totalprice FROM lineitem LEFT JOIN led USING (l_orderkey, l_linenumber)) GROUP BY 1""",
)
def ledger(spark, sf):
    led = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 7 + 1).cast("int").alias("l_linenumber"), "o_totalprice")
    joined = J.join_ledger(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), led, ["l_orderkey", "l_linenumber"], ["o_totalprice"])
    return r6(joined.groupBy("ledger_status").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 2)


@REGISTRY.add(
    "j3_expand_predictions",
    """WITH o AS (SELECT l_orderkey AS token, l_linenumber - 1 AS pred, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
SELECT o_orderkey AS token, i::INTEGER AS pred, q, CASE WHEN o.token IS NULL THEN 'missing_pair' ELSE 'ok' END AS pair_status
FROM orders, range(8) t(i) LEFT JOIN o ON o.token = o_orderkey AND o.pred = i""",
)
def expand_predictions(spark, sf):
    out = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("token"), (F.col("l_linenumber") - 1).alias("pred")).agg(F.max("l_quantity").alias("q"))
    return J.expand_preds(table(spark, sf, "orders").select(F.col("o_orderkey").alias("token")), out, 8)


@REGISTRY.add(
    "j4_merge_runs",
    f'WITH {READOUT_SQL} SELECT library_member, "NoAb_1", "Xclik_1X", "NoAb_1" * 2 AS "NoAb_2", "Xerrr_1X" FROM readout',
)
def merge_runs(spark, sf):
    wide = readout(spark, sf)
    a = wide.select("library_member", "NoAb_1", "Xclik_1X")
    b = wide.select("library_member", (F.col("NoAb_1") * 2).alias("NoAb_2"), "Xerrr_1X")
    return J.merge_runs(a, b, "library_member")


@REGISTRY.add(
    "j5_join_on_sequence",
    f"""WITH {SEQS_SQL}, r AS (SELECT seq, min(id) AS ref_id FROM seqs WHERE id % 3 > 0 GROUP BY seq)
SELECT id, ref_id, ref_id IS NOT NULL AS sequence_matched FROM seqs LEFT JOIN r USING (seq)""",
)
def on_sequence(spark, sf):
    s = seqs(spark, sf)
    ref = s.where("id % 3 > 0").select(F.col("id").alias("ref_id"), F.col("seq").alias("other"))
    return J.join_on_sequence(s.select("id", "seq"), ref, "seq", "other", ["ref_id"], ["ref_id"]).select("id", "ref_id", "sequence_matched")


@REGISTRY.add(
    "j7_mark_selected",
    """SELECT o_orderkey, o_totalprice > 300000 AS selected, CASE WHEN o_totalprice > 300000 THEN 'LIB_' || o_orderkey ELSE o_orderpriority END AS member FROM orders""",
)
def mark_selected(spark, sf):
    o = table(spark, sf, "orders")
    lib = o.where("o_totalprice > 300000").select("o_orderkey", F.concat(F.lit("LIB_"), F.col("o_orderkey").cast("string")).alias("member"))
    return J.mark_selected(o, lib, "o_orderkey", ["member"], {"member": "o_orderpriority"}).select("o_orderkey", "selected", "member")


@REGISTRY.add("j8_new_peptides", f"WITH {SEQS_SQL} SELECT id FROM seqs WHERE seq NOT IN (SELECT seq FROM seqs WHERE id % 2 = 0)")
def new_peptides(spark, sf):
    s = seqs(spark, sf).select("id", "seq")
    return J.new_peptides(s, s.where("id % 2 = 0")).select("id")


@REGISTRY.add("j9_pending_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 4)")
def pending(spark, sf):
    out = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.pending(table(spark, sf, "orders").select("o_orderkey"), out, ["o_orderkey"], 4)


@REGISTRY.add(
    "j10_attach_by_position",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_idx FROM orders),
b AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_idx FROM orders) SELECT row_idx, o_orderkey, o_totalprice FROM a JOIN b USING (row_idx)""",
)
def attach_by_position(spark, sf):
    from peptarium.operators.ordering import row_rank

    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    a = row_rank(o.select("o_orderkey"), [], ["o_orderkey"], out="row_idx")
    b = row_rank(o, [], ["o_totalprice", "o_orderkey"], out="row_idx").select("row_idx", "o_totalprice")
    return J.attach_by_position(a, b)


@REGISTRY.add(
    "j11_fill_from",
    "SELECT l_orderkey, l_linenumber, l_shipdate, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, l_extendedprice) AS price FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey",
)
def fill_from(spark, sf):
    other = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("price"))
    filled = J.fill_from(table(spark, sf, "lineitem"), other, ["l_orderkey"], "price", "l_extendedprice")
    return filled.select("l_orderkey", "l_linenumber", "l_shipdate", "price")


@REGISTRY.add(
    "j12_relabel_by_sequence",
    f"""WITH {OLIGO_SQL}, good AS (SELECT CASE k % 97 WHEN 5 THEN 'F' || substr(pep, 2) ELSE pep END AS seq, k, oligo FROM oligos WHERE k % 97 NOT IN (6, 7, 8, 9)),
f AS (SELECT seq, min_by(oligo, k) AS oligo FROM good GROUP BY seq)
SELECT p.name, p.name || CASE WHEN f.oligo IS NULL THEN '_1' ELSE '_00050' END AS id, f.oligo FROM peptides p LEFT JOIN f USING (seq)""",
)
def relabel(spark, sf):
    oligos, peptides = oligo_views(spark, sf)
    return J.relabel_by_sequence(oligos, peptides, ORDER_PREFIX, ORDER_SUFFIX).select("name", "id", "oligo")


@REGISTRY.add(
    "j13_base_rank_filter",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, {SOFT_BONUS_SQL} AS c FROM pool), r AS (SELECT key, row_number() OVER (PARTITION BY id ORDER BY c DESC, key) AS rn FROM s)
SELECT key || '_scaffoldMutX2' AS design_ID FROM r WHERE rn <= 15""",
)
def base_rank_filter(spark, sf):
    rows = pool(spark, sf)
    ranked = scoring.rank_in_group(scoring.score(rows, PRESETS["antibody_softgate"]), ["id"], ["key"]).withColumnRenamed("key", "predID")
    controls = rows.select(F.concat("key", F.lit("_scaffoldMutX2")).alias("design_ID"))
    return J.filter_by_base_rank(controls, ranked, 15, strip_mutation("design_ID"))


@REGISTRY.add("j14_map_attribute", "SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, p_brand FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey")
def map_attribute(spark, sf):
    attrs = table(spark, sf, "part").where("p_size > 10").withColumnRenamed("p_partkey", "l_partkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return J.map_attr(li, attrs, "l_partkey", "p_brand")


@REGISTRY.add("j14_restrict_ids", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def restrict(spark, sf):
    ids = table(spark, sf, "part").where("p_size > 40").select(F.col("p_partkey").alias("l_partkey"))
    return J.restrict_ids(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ids, ["l_partkey"])


@REGISTRY.add(
    "j18_containment",
    """SELECT d.doc_id, instr(d.text, l.piece) - 1 AS start, length(d.text) - length(l.piece) - (instr(d.text, l.piece) - 1) AS trim_c FROM documents d
JOIN (SELECT doc_id, substr(text, length(text) // 4 + 1, greatest(length(text) // 2, 1)) AS piece FROM documents) l USING (doc_id) WHERE d.text <> ''""",
)
def containment(spark, sf):
    d = table(spark, sf, "documents")
    size = F.length("text")
    piece = F.substring(F.col("text"), (size / 4).cast("int") + 1, F.greatest((size / 2).cast("int"), F.lit(1)))
    queries = d.where(size > 0).select("doc_id", piece.alias("q_seq"))
    found = J.containment(queries, d.select("doc_id", F.col("text").alias("c_seq")), ["doc_id"])
    return found.select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("trim_c").cast("bigint").alias("trim_c"))


@REGISTRY.add(
    "j18_containment_wildcard",
    """WITH c AS (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') || lpad(o_custkey::VARCHAR, 6, '0') AS s, substr(lpad(o_orderkey::VARCHAR, 8, '0'), 3, 5) AS q FROM orders),
w AS (SELECT o_orderkey, q, regexp_replace(s, '[13]', 'X', 'g') AS s FROM c),
p AS (SELECT o_orderkey, q, s, i FROM w, range(10) t(i))
SELECT o_orderkey, min(i)::BIGINT AS start FROM p WHERE
  """
    + " AND ".join(f"(substr(s, i::INT + {k}, 1) = 'X' OR substr(s, i::INT + {k}, 1) = substr(q, {k}, 1))" for k in range(1, 6))
    + " GROUP BY o_orderkey",
)
def containment_wildcard(spark, sf):
    o = table(spark, sf, "orders")
    digits = F.lpad(F.col("o_orderkey").cast("string"), 8, "0")
    queries = o.select("o_orderkey", F.substring(digits, 3, 5).alias("q_seq"))
    chains = o.select("o_orderkey", F.regexp_replace(F.concat(digits, F.lpad(F.col("o_custkey").cast("string"), 6, "0")), "[13]", "X").alias("c_seq"))
    return J.containment(queries, chains, ["o_orderkey"], wildcard="X").select("o_orderkey", F.col("start").cast("bigint").alias("start"))


@REGISTRY.add("j18_contained_passages", "SELECT item_id AS p_id, doc_id, instr(d.text, b.text) - 1 AS start FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contained_passages(spark, sf):
    passages = table(spark, sf, "benchmark").select(F.col("item_id").alias("p_id"), F.col("text").alias("p_text"))
    documents = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    found = J.contained_passages(documents, passages)
    return found.withColumn("start", F.col("start").cast("bigint"))


@REGISTRY.add(
    "j19_longest_block",
    """WITH p AS (SELECT a.conv_id, a.turn, a.text AS s, b.text AS t FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
x AS (SELECT conv_id, turn, i AS a_pos, substr(s, i::INT + 1, 5) AS g FROM p, (SELECT unnest(range((SELECT max(length(text)) FROM conversations))) AS i) r WHERE i <= length(s) - 5),
y AS (SELECT conv_id, turn, i AS b_pos, substr(t, i::INT + 1, 5) AS g FROM p, (SELECT unnest(range((SELECT max(length(text)) FROM conversations))) AS i) r WHERE i <= length(t) - 5),
m AS (SELECT conv_id, turn, a_pos, b_pos, b_pos - a_pos AS d FROM x JOIN y USING (conv_id, turn, g)),
n AS (SELECT *, a_pos - row_number() OVER (PARTITION BY conv_id, turn, d ORDER BY a_pos) AS run FROM m),
r AS (SELECT conv_id, turn, count(*) + 4 AS size, min(a_pos) AS a_start, min(b_pos) AS b_start FROM n GROUP BY conv_id, turn, d, run),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY size DESC, a_start, b_start) AS rn FROM r)
SELECT conv_id, turn, size, a_start, b_start FROM z WHERE rn = 1""",
)
def longest_block(spark, sf):
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("a_seq"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b_seq"))
    out = J.longest_block(a, b, ["conv_id", "turn"])
    return out.select("conv_id", "turn", *[F.col(x).cast("bigint").alias(x) for x in ("size", "a_start", "b_start")])


RES_SQL = """a AS (SELECT l_orderkey, l_partkey % 40 AS res_num, min(l_partkey) AS a_idx FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1, 2),
b AS (SELECT l_orderkey, l_partkey % 40 AS res_num, min(l_partkey) AS b_idx FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2)"""


def _residues(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("res_idx"), (F.col("l_partkey") % 40).alias("res_num"))
    return li.where("l_linenumber <= 5"), li.where("l_linenumber >= 3")


@REGISTRY.add(
    "j20_pair_residues",
    f"WITH {RES_SQL}, p AS (SELECT l_orderkey, res_num, a_idx, b_idx, count(*) OVER (PARTITION BY l_orderkey) AS n_shared FROM a JOIN b USING (l_orderkey, res_num)) SELECT * FROM p WHERE n_shared >= 3",
)
def pair_residues(spark, sf):
    return J.pair_residues(*_residues(spark, sf), "l_orderkey").select("l_orderkey", "res_num", "a_idx", "b_idx", "n_shared")


@REGISTRY.add(
    "j20_pair_by_index",
    """WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS res_idx, l_partkey AS num, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_linenumber <= 4),
b AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS res_idx, l_partkey AS num, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem WHERE l_linenumber >= 4)
SELECT l_orderkey, res_idx, a.num AS a_num, b.num AS b_num FROM a JOIN b USING (l_orderkey, res_idx) WHERE a.n = b.n""",
)
def pair_by_index(spark, sf):
    from peptarium.operators.ordering import row_rank

    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    index = lambda df: row_rank(df, ["l_orderkey"], ["l_partkey", "l_suppkey"], out="res_idx").withColumnRenamed("l_partkey", "res_num")
    return J.pair_by_index(index(li.where("l_linenumber <= 4")), index(li.where("l_linenumber >= 4")), "l_orderkey")


@REGISTRY.add(
    "j21_reselected",
    f"""WITH {POOL_SQL}, r AS (SELECT id, key, row_number() OVER (PARTITION BY id ORDER BY mean_pae, key) AS ra, row_number() OVER (PARTITION BY id ORDER BY overall_rmsd, key) AS rb FROM pool)
SELECT id, key FROM r WHERE rb <= 20 AND ra > 20""",
)
def reselected(spark, sf):
    from peptarium.operators.ordering import top_k

    rows = pool(spark, sf).select("id", "key", "mean_pae", "overall_rmsd")
    pick = lambda c: top_k(rows, ["id"], [F.col(c), F.col("key")], 20).select("id", "key")
    return J.reselected(pick("mean_pae"), pick("overall_rmsd"), ["id", "key"])


# ---------------------------------------------------------------- sorts and sets


@REGISTRY.add(
    "o1_mixed_sort",
    "SELECT p_partkey, row_number() OVER (ORDER BY (p_size > 25) DESC, p_size DESC, p_name, p_partkey) AS position FROM part",
)
def mixed_sort(spark, sf):
    from peptarium.operators.ordering import row_rank

    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_name", (F.col("p_size") > 25).alias("keep"))
    return row_rank(p, [], [F.col("keep").desc(), F.col("p_size").desc(), F.col("p_name"), F.col("p_partkey")], out="position").select("p_partkey", "position")


@REGISTRY.add("o2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_n(spark, sf):
    from peptarium.operators import ordering

    return ordering.top_n(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"], 50)


@REGISTRY.add(
    "u1_union_schema",
    "SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::VARCHAR AS brand FROM customer UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part",
)
def union_schema(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    return sets.union_all([c, p])


@REGISTRY.add(
    "u2_dedupe_by_sequence",
    f"""WITH {SEQS_SQL}, c AS (SELECT seq, id, source, CASE source WHEN 'src2' THEN 0 WHEN 'src0' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS pr FROM seqs),
r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY pr, id) AS rn FROM c) SELECT id, source FROM r WHERE rn = 1""",
)
def dedupe(spark, sf):
    rows = seqs(spark, sf).select("id", "source", F.col("source").alias("component"), F.col("seq").alias("sequence"))
    return sets.dedupe_by_sequence(rows, ["src2", "src0", "src1"], ["id"]).select("id", "source")


@REGISTRY.add("u3_disjoint_rest", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def disjoint_rest(spark, sf):
    taken = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return sets.disjoint_rest(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), taken, ["l_orderkey"])


@REGISTRY.add("u4_prefixed_columns", "SELECT s_suppkey, s_suppkey AS lx_s_suppkey, s_name AS lx_s_name, s_nationkey AS lx_s_nationkey, s_acctbal AS lx_s_acctbal FROM supplier")
def prefixed(spark, sf):
    return sets.prefixed(table(spark, sf, "supplier"), "lx_", keep=["s_suppkey"])


@REGISTRY.add(
    "u_key_set_check",
    """WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), b AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'P')
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS "both", count(*) FILTER (b.k IS NULL) AS only_left, count(*) FILTER (a.k IS NULL) AS only_right FROM a FULL JOIN b USING (k)""",
)
def key_set_check(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    b = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"))
    return sets.same_keys(a, b, ["k"])
