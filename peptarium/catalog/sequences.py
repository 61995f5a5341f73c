"""Sequence, contig and construct queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from peptarium.catalog import REGISTRY
from peptarium.catalog.predicates import DIGIT_CODONS, OLIGO_SQL, oligo_views
from peptarium.catalog.scoring import SOFT_BONUS_SQL
from peptarium.catalog.views import CASED_SQL, CONTIGS_SQL, POOL_SQL, SEQS_SQL, cased, contigs, pool, seqs, table
from peptarium.functions import contigs as C
from peptarium.functions import sequences as S
from peptarium.functions.keys import number_from_text, stable_hash
from peptarium.functions.sequences import ORDER_PREFIX, ORDER_SUFFIX
from peptarium.operators import stats
from peptarium.plans import flows


@REGISTRY.add(
    "n1_contig_positions",
    f"""WITH {CONTIGS_SQL} SELECT contig_id, array_to_string(list_concat(range(n, n + f), range(n + f + g, n + f + g + s)), ',') AS design,
  array_to_string(list_concat(range(a - 1, a + f - 1), range(a + 39, a + 39 + s)), ',') AS native FROM contigs""",
)
def contig_positions(spark, sf):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c.split(".")[1])
    return contigs(spark, sf).select("contig_id", C.contig_positions("contig_string").alias("p")).select("contig_id", text("p.design"), text("p.native"))


@REGISTRY.add(
    "n2_island_targets",
    f"""WITH {CONTIGS_SQL} SELECT contig_id, 'A' || a || '-' || (a + f - 1) AS island, 1 AS island_index, f AS island_size, s AS partner_size, f >= 2 AS scaffold FROM contigs
UNION ALL SELECT contig_id, 'A' || (a + 40) || '-' || (a + 39 + s), 2, s, f, s >= 2 FROM contigs""",
)
def island_targets(spark, sf):
    named = contigs(spark, sf).withColumn("id", F.col("contig_id"))
    return C.island_targets(named).select(F.col("id").alias("contig_id"), "island", "island_index", "island_size", "partner_size", "scaffold")


@REGISTRY.add("n3_translate", f"WITH {OLIGO_SQL} SELECT k, pep FROM coded")
def translate(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    digits = F.split(F.lpad((F.col("k") % 100000).cast("string"), 5, "0"), "")
    code = F.array_join(F.transform(digits, lambda d: F.element_at(F.array(*[F.lit(c) for c in DIGIT_CODONS]), d.cast("int") + 1)), "")
    return o.select("k", S.translate(code).alias("pep"))


@REGISTRY.add(
    "n4_case_encode_positions",
    f"""WITH {CASED_SQL} SELECT id, array_to_string(list_transform(string_split(lower(scaffoldEPITOPE), ''), lambda c, i: CASE WHEN i - 1 IN (0, 3, 5, id % 40) THEN upper(c) ELSE c END), '') AS encoded
FROM cased WHERE length(scaffoldEPITOPE) > 0""",
)
def case_encode_positions(spark, sf):
    rows = cased(spark, sf).where(F.length("scaffoldEPITOPE") > 0)
    rows = rows.withColumn("idx", F.array(F.lit(0), F.lit(3), F.lit(5), (F.col("id") % 40).cast("int")))
    return rows.select("id", S.case_encode_positions("scaffoldEPITOPE", "idx").alias("encoded"))


@REGISTRY.add(
    "n4_case_encode_span",
    f"""WITH {SEQS_SQL} SELECT id, lower(substr(seq, 1, id % 50)) || upper(substr(seq, id % 50 + 1, 12)) || lower(substr(seq, id % 50 + 13)) AS encoded FROM seqs""",
)
def case_encode_span(spark, sf):
    return seqs(spark, sf).select("id", S.case_encode_span("seq", (F.col("id") % 50).cast("int"), F.lit(12)).alias("encoded"))


@REGISTRY.add(
    "n4_case_encode_unique",
    f"""WITH {SEQS_SQL}, e AS (SELECT id, seq, substr(seq, length(seq) // 3 + 1, 3 + id % 5) AS epi FROM seqs WHERE seq <> ''),
c AS (SELECT *, (length(seq) - length(replace(seq, epi, ''))) / length(epi) AS hits, instr(seq, epi) AS pos FROM e)
SELECT id, CASE WHEN hits = 1 THEN 'ok' ELSE 'epitope_not_unique' END AS status,
  CASE WHEN hits = 1 THEN lower(substr(seq, 1, pos - 1)) || epi || lower(substr(seq, pos + length(epi))) END AS encoded FROM c""",
)
def case_encode_unique(spark, sf):
    at = (F.length("seq") / 3).cast("int") + 1
    rows = seqs(spark, sf).where("seq <> ''").withColumn("epi", F.substring(F.col("seq"), at, (F.col("id") % 5 + 3).cast("int")))
    return rows.select("id", S.case_encode_unique("seq", "epi").alias("e")).select("id", "e.status", "e.encoded")


@REGISTRY.add(
    "n5_linear_casing",
    f"WITH {SEQS_SQL} SELECT id, lower(substr(seq, 1, greatest(length(seq) - 30, 0))) || right(seq, 30) AS encoded FROM seqs",
)
def linear_casing(spark, sf):
    return seqs(spark, sf).select("id", S.case_encode_linear("seq").alias("encoded"))


@REGISTRY.add(
    "n6_trim",
    f"""WITH {CASED_SQL} SELECT id, CASE WHEN length(s) <= 103 THEN s WHEN regexp_matches(s, '[a-z]$') THEN left(s, length(s) - 1) WHEN regexp_matches(s, '^[a-z]') THEN substr(s, 2) END AS seq,
  CASE WHEN length(s) <= 103 THEN 'already103' WHEN regexp_matches(s, '[a-z]$') THEN 'cterm' WHEN regexp_matches(s, '^[a-z]') THEN 'nterm' ELSE 'both_termini_epitope' END AS note
FROM (SELECT id, CASE id % 4 WHEN 0 THEN scaffoldEPITOPE || 'E' WHEN 1 THEN 'aa' || scaffoldEPITOPE || 'E' ELSE scaffoldEPITOPE END AS s FROM cased)""",
)
def trim(spark, sf):
    s = F.col("scaffoldEPITOPE")
    varied = F.when(F.col("id") % 4 == 0, F.concat(s, F.lit("E"))).when(F.col("id") % 4 == 1, F.concat(F.lit("aa"), s, F.lit("E"))).otherwise(s)
    return cased(spark, sf).select("id", S.trim_to(varied).alias("t")).select("id", "t.seq", "t.note")


@REGISTRY.add(
    "n7_mutate_islands",
    f"""WITH {CASED_SQL}, r AS (SELECT id, scaffoldEPITOPE AS s, regexp_extract(scaffoldEPITOPE, '^([^A-Z]*)([A-Z]+)(.*)$', ['h', 'm', 't']) AS a,
  regexp_extract(scaffoldEPITOPE, '^([^A-Z]*[A-Z]+[^A-Z]+)([A-Z]+)(.*)$', ['h', 'm', 't']) AS b FROM cased)
SELECT id, CASE WHEN a.m <> '' THEN a.h || repeat('A', length(a.m)) || a.t END AS first_island, CASE WHEN b.m <> '' THEN b.h || repeat('A', length(b.m)) || b.t END AS second_island,
  CASE WHEN a.m <> '' THEN a.h || regexp_replace(a.m, '[A-Z]([A-Z]?)', 'A\\1', 'g') || a.t END AS every_other FROM r""",
)
def mutate_islands(spark, sf):
    s = "scaffoldEPITOPE"
    return cased(spark, sf).select("id", S.mutate_island(s, 1).alias("first_island"), S.mutate_island(s, 2).alias("second_island"), S.mutate_island(s, 1, True).alias("every_other"))


def disrupt_sql(source: str, name: str, seed: int, most: int = 4) -> str:
    """CTEs ending in ``name`` (id, seq, placed): hexamer placements spelled out one by one.

    ``source`` has id, key and seq of letters only. Upper-case letters cut a sequence into lower-case pieces;
    starts in a piece keep four residues to a neighbour on either side and none to a sequence end.
    """
    parts, done = [], []
    for n in range(most, 0, -1):
        left = " AND ".join(f"id NOT IN (SELECT id FROM {d})" for d in done) or "true"
        parts.append(f"{name}_{n}_0 AS (SELECT id, key, seq, 0 AS placed FROM {source} WHERE {left})")
        for i in range(1, n + 1):
            at = f"{name}_{n}_{i}"
            parts.append(
                f"""{at}a AS (SELECT id, key, seq, string_split_regex(seq, '[A-Z]') AS pieces FROM {name}_{n}_{i - 1}),
{at}b AS (SELECT id, key, seq, len(pieces) AS np, unnest(list_transform(pieces, lambda c: length(c))) AS n, unnest(range(1, len(pieces) + 1)) AS k FROM {at}a),
{at}c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + k - 1 AS u FROM {at}b),
{at}d AS (SELECT *, CASE WHEN k = 1 THEN u ELSE u + 4 END AS lo, CASE WHEN k = np THEN u + n - 6 ELSE u + n - 10 END AS hi FROM {at}c),
{at}e AS (SELECT *, greatest(hi - lo + 1, 0) AS spots FROM {at}d),
{at}f AS (SELECT *, sum(spots) OVER (PARTITION BY id ORDER BY k)::BIGINT AS cum, sum(spots) OVER (PARTITION BY id)::BIGINT AS total FROM {at}e),
{at}g AS (SELECT *, ('0x' || substr(md5(key || '|{n}|{i}|{seed}'), 1, 15))::BIGINT % greatest(total, 1) AS pick FROM {at}f),
{at} AS MATERIALIZED (SELECT id, key, left(seq, lo + pick - (cum - spots)) || 'PPDDGG' || substr(seq, lo + pick - (cum - spots) + 7) AS seq, {i} AS placed FROM {at}g WHERE total > 0 AND pick >= cum - spots AND pick < cum)"""
            )
        done.append(f"{name}_{n}_{n}")
    union = " UNION ALL ".join(f"SELECT id, seq, placed FROM {d}" for d in done)
    return ", ".join([*parts, f"{name} AS ({union})"])


@REGISTRY.add(
    "n8_scaffold_disruption",
    f"""WITH {CASED_SQL}, src AS (SELECT id, id::VARCHAR AS key, scaffoldEPITOPE AS seq FROM cased), {disrupt_sql("src", "x", 0)}
SELECT id, placed::INTEGER AS placed, x.seq FROM cased LEFT JOIN x USING (id)""",
)
def scaffold_disruption(spark, sf):
    return cased(spark, sf).select("id", S.disrupt("scaffoldEPITOPE", F.col("id").cast("string")).alias("d")).select("id", "d.placed", F.col("d.seq").alias("seq"))


ISLAND_SQL = """SELECT 'd' || id || '_epitopeIsland1Mut>A' AS design_ID, target, m.h || repeat('A', length(m.m)) || m.t AS mutated FROM (SELECT *, regexp_extract(scaffoldEPITOPE, '^([^A-Z]*)([A-Z]+)(.*)$', ['h', 'm', 't']) AS m FROM cased) WHERE m.m <> ''
  UNION ALL SELECT 'd' || id || '_epitopeIsland2Mut>A', target, m.h || repeat('A', length(m.m)) || m.t FROM (SELECT *, regexp_extract(scaffoldEPITOPE, '^([^A-Z]*[A-Z]+[^A-Z]+)([A-Z]+)(.*)$', ['h', 'm', 't']) AS m FROM cased) WHERE m.m <> ''
  UNION ALL SELECT 'd' || id || '_scaffoldMutX' || placed, target, many.seq FROM many JOIN cased USING (id)"""
CONTROL_SRC = "src AS (SELECT id, 'd' || id AS key, scaffoldEPITOPE AS seq FROM cased WHERE scaffoldEPITOPE <> '')"


@REGISTRY.add(
    "n9_control_expansion",
    f"""WITH {CASED_SQL}, {CONTROL_SRC}, {disrupt_sql("src", "one", 0, 1)}, {disrupt_sql("src", "many", 1)},
m AS ({ISLAND_SQL} UNION ALL SELECT 'd' || id || '_scaffoldMutX1', target, one.seq FROM one JOIN cased USING (id))
SELECT left(upper(mutated), 103) AS sequence, 'scaffoldedAbEpitope' AS category, 'RFD' AS model, upper(mutated) AS designedSequence, length(mutated)::INTEGER AS designedSequenceLength,
  design_ID, target, mutated AS scaffoldEPITOPE FROM m""",
)
def control_expansion(spark, sf):
    designs = cased(spark, sf).select(F.concat(F.lit("d"), "id").alias("design_ID"), F.col("scaffoldEPITOPE").alias("designedSequence"), "target")
    return S.build_controls(designs, single_hexamer=True)


TILE_SQL = f"""{SEQS_SQL}, w AS (SELECT id, seq, unnest(range(1, length(seq) - 28, 6)) AS start FROM seqs WHERE length(seq) >= 30
  UNION SELECT id, seq, length(seq) - 29 FROM seqs WHERE length(seq) >= 30)"""


@REGISTRY.add("n10_tiling", f"WITH {TILE_SQL} SELECT id, start::INTEGER AS start, substr(seq, start, 30) AS tile, 'GSGA' || substr(seq, start, 30) AS construct FROM w")
def tiling(spark, sf):
    return S.tile(seqs(spark, sf), "seq", 30, 6, prefix="GSGA").select("id", "start", "tile", "construct")


@REGISTRY.add("n10_tiling_without_cterm", f"WITH {SEQS_SQL} SELECT id, unnest(range(1, length(seq) - 101, 40))::INTEGER AS start FROM seqs WHERE length(seq) >= 103")
def tiling_without_cterm(spark, sf):
    return S.tile(seqs(spark, sf), "seq", 103, 40, cterm=False).select("id", "start")


@REGISTRY.add("a24_tile_summary", f"WITH {TILE_SQL}, c AS (SELECT id, count(*) AS tiles FROM w GROUP BY id) SELECT id, length(seq)::INTEGER AS new_len, coalesce(tiles, 0) AS tiles FROM seqs LEFT JOIN c USING (id)")
def tile_summary(spark, sf):
    s = seqs(spark, sf)
    tiles = S.tile(s, "seq", 30, 6)
    return stats.tile_summary(tiles, s.select("id", F.length("seq").alias("new_len")), ["id"])


NATIVE_SQL = f"""{SEQS_SQL}, q AS (SELECT id, seq, substr(seq, length(seq) // 5 + 1, greatest(length(seq) * 3 // 5, 1)) || CASE WHEN id % 10 = 0 THEN 'QQ' ELSE '' END AS q FROM seqs WHERE seq <> ''),
c AS (SELECT id, q, CASE WHEN id % 3 = 0 THEN 'WWW' || seq || 'FIRST' ELSE seq END AS chain FROM q),
n AS (SELECT id, q, CASE WHEN instr(chain, q) > 0 THEN substr(chain, instr(chain, q)) ELSE q END AS native, instr(chain, q) > 0 AS found FROM c)"""


def _native(spark, sf):
    s = seqs(spark, sf).where("seq <> ''")
    size = F.length("seq")
    piece = F.substring(F.col("seq"), (size / 5).cast("int") + 1, F.greatest((size * 3 / 5).cast("int"), F.lit(1)))
    queries = s.select(F.col("id").alias("target"), F.col("id").alias("entry"), F.when(F.col("id") % 10 == 0, F.concat(piece, F.lit("QQ"))).otherwise(piece).alias("q_seq"))
    # every third entry has two chains that hold the target, the first of them further in
    first = s.where(F.col("id") % 3 == 0).select(F.col("id").alias("entry"), F.concat(F.lit("WWW"), "seq", F.lit("FIRST")).alias("c_seq"), F.lit(0).alias("record"))
    chains = s.select(F.col("id").alias("entry"), F.col("seq").alias("c_seq"), F.lit(1).alias("record")).unionByName(first)
    return flows.native_tiles(queries, chains)


@REGISTRY.add(
    "n11_native_tiling",
    f"""WITH {NATIVE_SQL}, w AS (SELECT id, native, unnest(range(1, length(native) - 28, 6)) AS start FROM n UNION SELECT id, native, length(native) - 29 FROM n WHERE length(native) >= 30)
SELECT id AS target, start::INTEGER AS start, substr(native, start, 30) AS tile FROM w""",
)
def native_tiling(spark, sf):
    return _native(spark, sf)[0].select("target", "start", "tile")


@REGISTRY.add(
    "f7_tiled_controls",
    f"""WITH {NATIVE_SQL} SELECT id AS target, length(q)::INTEGER AS old_len, length(native)::INTEGER AS new_len, (length(native) - length(q))::INTEGER AS recovered,
  CASE WHEN found THEN 'clean' ELSE 'needs_review' END AS status,
  CASE WHEN length(native) < 30 THEN 0 ELSE (length(native) - 30) // 6 + 1 + CASE WHEN (length(native) - 30) % 6 > 0 THEN 1 ELSE 0 END END::BIGINT AS tiles FROM n""",
)
def tiled_controls(spark, sf):
    tiles, windows = _native(spark, sf)
    return stats.tile_summary(tiles, windows.drop("native"), ["target"])


@REGISTRY.add(
    "n12_expand_contigs",
    f"""WITH {CONTIGS_SQL} SELECT id || '__contig' || contig_id || '__seed' || seed || '__rep' || rep AS design_id, seed::INTEGER AS seed, rep::INTEGER AS rep, replace(contig_string, '/', ',') AS contig_rfd3
FROM contigs, (SELECT unnest([0, 1, 5]) AS seed), (SELECT unnest([0, 1]) AS rep)""",
)
def expand_contigs(spark, sf):
    doubled = contigs(spark, sf)
    return C.expand_contigs(doubled.unionByName(doubled), [0, 1, 5], 2).select("design_id", "seed", "rep", "contig_rfd3")


HASH = "('0x' || substr(md5({x}), 1, 15))::BIGINT"


@REGISTRY.add(
    "n13_flank_variants",
    f"""WITH {CONTIGS_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY contig_string) AS k FROM contigs),
i AS (SELECT id, epitope_resindices AS e, 0 AS idx, a, a + f - 1 AS b, f AS size FROM u WHERE k = 1 AND f >= 2 UNION ALL SELECT id, epitope_resindices, 1, a + 40, a + 39 + s, s FROM u WHERE k = 1 AND s >= 2),
v AS (SELECT *, unnest(range(1, 103 - size)) AS nf FROM i),
h AS (SELECT *, row_number() OVER (PARTITION BY id, idx ORDER BY {HASH.format(x="id || '|' || idx || '|' || nf || '|11'")}, nf) AS r FROM v)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY idx, nf) - 1 AS contig_id, nf || '-' || nf || '/A' || a || '-' || b || '/' || (103 - size - nf) || '-' || (103 - size - nf) AS contig_string,
  idx AS island_index, size AS island_size, row_number() OVER (PARTITION BY id, idx ORDER BY nf) - 1 AS variant, len(list_filter(e, lambda x: x >= a - 1 AND x <= b - 1)) AS n_fixed FROM h WHERE r <= 20""",
)
def flank_variants(spark, sf):
    out = C.flank_variants(contigs(spark, sf), 20, seed=11)
    wide = ("contig_id", "variant", "n_fixed")
    return out.select("id", "contig_string", "island_index", "island_size", *[F.col(c).cast("bigint").alias(c) for c in wide])


SHORT_SQL = """CASE WHEN c >= 1 AND c >= n THEN n || '-' || n || '/A' || a || '-' || (a+f-1) || '/' || g || '-' || g || '/A' || (a+40) || '-' || (a+39+s) || '/' || (c-1) || '-' || (c-1)
  ELSE (n-1) || '-' || (n-1) || '/A' || a || '-' || (a+f-1) || '/' || g || '-' || g || '/A' || (a+40) || '-' || (a+39+s) || '/' || c || '-' || c END"""


@REGISTRY.add("n14_shorten_contig", f"WITH {CONTIGS_SQL} SELECT contig_id, {SHORT_SQL} AS contig, CASE WHEN c >= n THEN 'C' ELSE 'N' END AS where_cut FROM contigs")
def shorten(spark, sf):
    return contigs(spark, sf).select("contig_id", C.shorten_contig("contig_string").alias("s")).select("contig_id", "s.contig", F.col("s.where").alias("where_cut"))


@REGISTRY.add(
    "n15_contig_ledger",
    f"""WITH {CONTIGS_SQL}, d AS (SELECT id, contig_string, any_value(n) AS n, any_value(a) AS a, any_value(f) AS f, any_value(g) AS g, any_value(s) AS s, any_value(c) AS c,
  any_value(epitope_resindices) AS e FROM contigs GROUP BY id, contig_string)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY contig_string) - 1)::INTEGER AS contig_id, {SHORT_SQL} AS contig_string, contig_string AS orig_contig_string, len(e)::INTEGER AS n_fixed FROM d""",
)
def contig_ledger(spark, sf):
    rows = contigs(spark, sf)
    return C.contig_ledger(rows.unionByName(rows)).select("id", "contig_id", "contig_string", "orig_contig_string", "n_fixed")


def _targets(spark, sf):
    """A two-island target per brand, spans from its part sizes."""
    p = table(spark, sf, "part").groupBy("p_brand").agg((F.min("p_size") % 9 + 2).alias("one"), (F.max("p_size") % 7 + 1).alias("two"))
    island = lambda start, n: F.struct(F.lit(start).cast("int").alias("a"), (F.lit(start) + n - 1).cast("int").alias("b"))
    return p.select(F.col("p_brand").alias("target"), F.array(island(650, F.col("one")), island(700, F.col("two"))).alias("islands"))


def comp_sql(islands: str, lengths: str, seed: int) -> str:
    """CTE ``r`` (target, n from 0, s1, s2, s3): splits of ``room`` in order, taken by a permutation of their ranks."""
    return f"""p AS ({islands}), t AS (SELECT *, {lengths} AS room FROM p),
e AS (SELECT target, v1, v2, room - v1 - v2 AS v3, row_number() OVER (PARTITION BY target ORDER BY v1, v2) - 1 AS rank, count(*) OVER (PARTITION BY target) AS total
  FROM t, range(200) a(v1), range(200) b(v2) WHERE v1 + v2 <= room),
h AS (SELECT target, any_value(total) AS total, {HASH.format(x=f"target || '|start|{seed}'")} % any_value(total) AS b, any_value(total) // 4 + 1 + {HASH.format(x=f"target || '|step|{seed}'")} % (any_value(total) // 2 + 1) AS a0 FROM e GROUP BY target),
g AS (SELECT target, total, b, min(a0 + k) AS a FROM h, range(1000) r(k) WHERE gcd(a0 + k, total) = 1 GROUP BY ALL),
r AS (SELECT e.target, n, v1 + 3 AS s1, v2 + 3 AS s2, v3 + 3 AS s3 FROM g, range(20) q(n) JOIN e ON e.target = g.target AND e.rank = (b + n * a) % g.total WHERE n < g.total)"""


ISLANDS_OF_BRANDS = "SELECT p_brand AS target, min(p_size) % 9 + 2 AS one, max(p_size) % 7 + 1 AS two FROM part GROUP BY p_brand"
COMP_SQL = comp_sql(ISLANDS_OF_BRANDS, "103 - one - two - 9", 5)


@REGISTRY.add(
    "n16_compositions",
    f"""WITH {COMP_SQL} SELECT n::INTEGER AS contig_id, target, s1 || '-' || s1 || ',C650-' || (649 + one) || ',' || s2 || '-' || s2 || ',C700-' || (699 + two) || ',' || s3 || '-' || s3 AS contig_string,
  s1 || ',' || s2 || ',' || s3 AS scaffold_segs FROM r JOIN p USING (target)""",
)
def compositions(spark, sf):
    return C.compositions(_targets(spark, sf), 20, seed=5).select("contig_id", "target", "contig_string", "scaffold_segs")


@REGISTRY.add(
    "n16_native_gaps",
    f"""WITH p AS ({ISLANDS_OF_BRANDS}), t AS (SELECT *, 47 - two AS room, 48 - two AS total, {HASH.format(x="target || '|start|9'")} % (48 - two) AS b, (48 - two) // 4 + 1 + {HASH.format(x="target || '|step|9'")} % ((48 - two) // 2 + 1) AS a0 FROM p),
g AS (SELECT t.*, (SELECT min(a0 + k) FROM range(1000) r(k) WHERE gcd(a0 + k, total) = 1) AS a FROM t),
r AS (SELECT *, (b + n * a) % total + 3 AS s1, room - (b + n * a) % total + 3 AS s2 FROM g, range(30) q(n) WHERE n < total)
SELECT n::INTEGER AS contig_id, target, s1 || '-' || s1 || ',C650-' || (649 + one) || ',' || (50 - one) || '-' || (50 - one) || ',C700-' || (699 + two) || ',' || s2 || '-' || s2 AS contig_string,
  s1 || ',' || (50 - one) || ',' || s2 AS scaffold_segs FROM r""",
)
def compositions_native_gaps(spark, sf):
    return C.compositions(_targets(spark, sf), 30, seed=9, native_gaps=True).select("contig_id", "target", "contig_string", "scaffold_segs")


@REGISTRY.add("n18_list_length", f"WITH {CONTIGS_SQL} SELECT contig_id, CASE WHEN contig_id % 5 = 0 THEN NULL WHEN contig_id % 5 = 1 THEN 0 ELSE len(epitope_resindices) END::INTEGER AS n FROM contigs")
def list_length(spark, sf):
    from peptarium.functions.keys import list_len

    e = F.col("epitope_resindices")
    listed = F.when(F.col("contig_id") % 5 == 1, F.slice(e, 1, 0)).when(F.col("contig_id") % 5 > 1, e)
    return contigs(spark, sf).select("contig_id", list_len(listed).alias("n"))


@REGISTRY.add("n20_contig_dialect", f"WITH {CONTIGS_SQL} SELECT contig_id, replace(contig_string, '/', ',') AS commas, 104 AS length FROM contigs")
def contig_dialect(spark, sf):
    return contigs(spark, sf).select("contig_id", C.comma_contig("contig_string").alias("commas"), number_from_text("contig_length").alias("length"))


@REGISTRY.add("w19_upper_runs", f"WITH {CASED_SQL} SELECT id, unnest(regexp_extract_all(scaffoldEPITOPE, '[A-Z]+')) AS island FROM cased")
def upper_runs(spark, sf):
    return cased(spark, sf).select("id", F.explode(S.islands("scaffoldEPITOPE")).alias("island"))


@REGISTRY.add(
    "f8_control_mutants",
    f"""WITH {CASED_SQL}, {CONTROL_SRC}, {disrupt_sql("src", "many", 1)}, m AS ({ISLAND_SQL}),
r AS (SELECT 'd' || id AS base, row_number() OVER (PARTITION BY target ORDER BY {HASH.format(x="'d' || id || '|0'")}, 'd' || id) AS rn FROM cased)
SELECT design_ID, target, length(mutated)::INTEGER AS designedSequenceLength, mutated AS scaffoldEPITOPE FROM m JOIN r ON split_part(design_ID, '_', 1) = base WHERE rn <= 15""",
)
def control_mutants(spark, sf):
    designs = cased(spark, sf).select(F.concat(F.lit("d"), "id").alias("design_ID"), F.col("scaffoldEPITOPE").alias("designedSequence"), "target")
    from peptarium.operators.ordering import row_rank

    ranked = row_rank(designs.withColumn("predID", F.col("design_ID")), ["target"], [stable_hash("predID"), F.col("predID")])
    return flows.control_mutants(designs, ranked.select("predID", "rank_in_group"), 15).select("design_ID", "target", "designedSequenceLength", "scaffoldEPITOPE")


# ---------------------------------------------------------------- assembly


def _once(df, column):
    """Work a costly column out once per row: filters and projections are not merged through an explode, which would repeat it."""
    return df.select(*[c for c in df.columns if c != column], F.explode(F.array(column)).alias(column))


def _library_parts(spark, sf):
    """Two scaffold arms and a tile arm over the same documents, so that sequences collide."""
    c = _once(cased(spark, sf), "scaffoldEPITOPE").where(F.length("scaffoldEPITOPE") > 0)
    base = c.select(
        F.concat(F.lit("x"), (F.col("id") % 7).cast("string"), F.lit("_p"), "id").alias("token"),
        "scaffoldEPITOPE",
        "target",
        F.lit("ok").alias("status"),
        (F.col("id") % 30 + 1).cast("int").alias("rank_in_group"),
        (F.col("id") % 997 / 10.0).alias("mean_pae"),
        F.when(F.col("id") % 13 == 0, "too_few_epitope_pairs").otherwise("ok").alias("af3_clash_status"),
    )
    arms = [
        flows.Component("C1", "scaffoldedAbEpitope", base.where("mean_pae < 60"), trim=True, depth=20),
        flows.Component("C5", "metricSpaceTitration", base.where("mean_pae > 30").drop("rank_in_group"), trim=True),
    ]
    tiles = S.tile(_once(seqs(spark, sf), "seq").withColumnRenamed("id", "target"), "seq", 103, 60)
    return [*[flows.component_rows(a) for a in arms], flows.tile_rows(tiles)]


TRIMMED_SQL = "CASE WHEN length(s) <= 103 THEN s WHEN regexp_matches(s, '[a-z]$') THEN left(s, length(s) - 1) WHEN regexp_matches(s, '^[a-z]') THEN substr(s, 2) END"
LIBRARY_SQL = f"""{CASED_SQL}, {SEQS_SQL}, b AS (SELECT id, 'x' || (id % 7) || '_p' || id AS token, scaffoldEPITOPE AS s, target, id % 30 + 1 AS rk, (id % 997) / 10.0::DOUBLE AS mean_pae FROM cased WHERE length(scaffoldEPITOPE) > 0 AND id % 13 <> 0),
a AS (SELECT 'C1' AS component, 0 AS pr, 'C1_' || token || '_r' || rk AS design_ID, {TRIMMED_SQL} AS d, mean_pae FROM b WHERE mean_pae < 60 AND rk <= 20
  UNION ALL SELECT 'C5', 3, 'C5_' || token, {TRIMMED_SQL}, mean_pae FROM b WHERE mean_pae > 30),
w AS (SELECT id, seq, unnest(range(1, length(seq) - 101, 60)) AS st FROM seqs WHERE length(seq) >= 103 UNION SELECT id, seq, length(seq) - 102 FROM seqs WHERE length(seq) >= 103),
l AS (SELECT component, pr, design_ID, upper(d) AS sequence, d, mean_pae FROM a WHERE d IS NOT NULL
  UNION ALL SELECT 'C4', 5, 'C4_' || id || '_t' || st, substr(seq, st, 103), lower(substr(seq, st, 73)) || substr(seq, st + 73, 30), NULL FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY pr, design_ID) AS k FROM l),
lib AS (SELECT 'LIB_' || row_number() OVER (ORDER BY pr, design_ID, sequence) AS library_member, component, design_ID, sequence, d AS designedSequence, length(d)::INTEGER AS designedSequenceLength, mean_pae FROM r WHERE k = 1)"""


@REGISTRY.add("f2_assemble_library", f"WITH {LIBRARY_SQL} SELECT library_member, component, design_ID, designedSequence, designedSequenceLength, mean_pae FROM lib")
def assemble_library(spark, sf):
    return flows.assemble(_library_parts(spark, sf)).select("library_member", "component", "design_ID", "designedSequence", "designedSequenceLength", "mean_pae")


@REGISTRY.add(
    "f3_fold_external",
    """WITH lib AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F'),
ext AS (SELECT p_partkey::VARCHAR AS uuid, upper(p_name) AS sequence, p_brand FROM part WHERE p_size % 3 = 0),
u AS (SELECT 0 AS o, n, 'd' || k AS design_ID, 's' || k AS sequence, NULL AS lx_p_brand, 'kept' AS category FROM lib UNION ALL SELECT 1, NULL, uuid, sequence, p_brand, 'minibinder' FROM ext)
SELECT 'LIB_' || row_number() OVER (ORDER BY o, n NULLS FIRST, design_ID, sequence) AS library_member, design_ID, category, lx_p_brand FROM u""",
)
def fold_external(spark, sf):
    from peptarium.operators.numbering import number_members

    o = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    k = F.col("o_orderkey").cast("string")
    lib = number_members(o.select("o_orderkey", F.concat(F.lit("d"), k).alias("design_ID"), F.concat(F.lit("s"), k).alias("sequence"), F.lit("kept").alias("category")), ["o_orderkey"]).drop("o_orderkey")
    p = table(spark, sf, "part")
    external = p.select(F.col("p_partkey").alias("uuid"), F.col("p_type").alias("target"), F.col("p_name").alias("sequence"), "p_brand", F.when(F.col("p_size") % 3 == 0, " True").otherwise("0").alias("passes"))
    once = flows.fold_external(lib, external, "minibinder")
    return flows.fold_external(once, external, "minibinder").select("library_member", "design_ID", "category", "lx_p_brand")


@REGISTRY.add(
    "f4_superset",
    f"""WITH {POOL_SQL}, s AS (SELECT key, id, {SOFT_BONUS_SQL} AS c, coalesce(overall_rmsd <= 2 AND epitope_chunk_rmsd <= 1 AND mean_pae <= 5 AND af3_n_clash_res = 0, false) AS is_global_pass FROM pool WHERE lower(status) = 'ok'),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY c DESC, key) AS rank_in_group FROM s)
SELECT key, rank_in_group, is_global_pass, rank_in_group <= 5 AS selected, CASE WHEN rank_in_group <= 5 THEN 'M' || key END AS library_member, CASE WHEN rank_in_group <= 5 THEN 'SEQ' || key ELSE key END AS sequence FROM r""",
)
def superset(spark, sf):
    from peptarium.plans.presets import PRESETS

    rows = pool(spark, sf).withColumn("predID", F.col("key"))
    cut = flows.cut_component(rows.where("lower(status) = 'ok'"), PRESETS["antibody_softgate"], ["id"], ["key"], 5)
    library = cut.select(
        F.concat(F.lit("C1_"), "key", F.lit("_r"), F.col("rank_in_group").cast("string")).alias("design_ID"),
        F.lit("scaffoldedAbEpitope").alias("category"),
        F.concat(F.lit("M"), "key").alias("library_member"),
        F.concat(F.lit("SEQ"), "key").alias("sequence"),
        F.lit("x").alias("designedSequence"),
    )
    block = flows.superset_block(rows, library, "C1", "scaffoldedAbEpitope", PRESETS["antibody_softgate"], ["id"], ["key"], seq_col="key")
    return block.select("key", "rank_in_group", "is_global_pass", "selected", "library_member", "sequence")


@REGISTRY.add("f4_extend_superset", "SELECT o_orderpriority AS component, count(*) AS n, round(sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE o_totalprice END), 2) AS total FROM orders GROUP BY 1")
def extend_superset(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("component"), "o_orderkey", "o_totalprice")
    block = o.where("component = '5-LOW'").withColumn("o_totalprice", F.lit(1.0))
    twice = flows.extend_superset(flows.extend_superset(o, block, "5-LOW"), block, "5-LOW")
    return twice.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@REGISTRY.add(
    "f5_order_job",
    f"""WITH {OLIGO_SQL}, good AS (SELECT CASE k % 97 WHEN 5 THEN 'F' || substr(pep, 2) ELSE pep END AS seq, k, oligo FROM oligos WHERE k % 97 NOT IN (6, 7, 8, 9)),
f AS (SELECT seq, min_by(oligo, k) AS oligo FROM good GROUP BY seq)
SELECT 'LIB_' || CASE WHEN length(substr(name, 5)) >= 6 THEN substr(name, 5) ELSE lpad(substr(name, 5), 6, '0') END AS name, oligo AS sequence FROM peptides JOIN f USING (seq)""",
)
def order_job(spark, sf):
    oligos, peptides = oligo_views(spark, sf)
    return flows.order_job(peptides, _encoded(peptides), oligos, ORDER_PREFIX, ORDER_SUFFIX, 6)["quote"]


@REGISTRY.add("f5_order_delta", f"WITH {OLIGO_SQL} SELECT name, seq FROM peptides WHERE seq NOT IN (SELECT seq FROM peptides WHERE substr(name, 5)::BIGINT % 3 = 0)")
def order_delta(spark, sf):
    oligos, peptides = oligo_views(spark, sf)
    return flows.order_job(peptides, _encoded(peptides), oligos, ORDER_PREFIX, ORDER_SUFFIX, 6)["delta"].select("name", "seq")


def _encoded(peptides):
    """Peptides ordered before: every third by number."""
    return peptides.where(F.substring("name", 5, 20).cast("bigint") % 3 == 0)


@REGISTRY.add(
    "f5_order_violations",
    f"""WITH {OLIGO_SQL}, good AS (SELECT CASE k % 97 WHEN 5 THEN 'F' || substr(pep, 2) ELSE pep END AS seq FROM oligos WHERE k % 97 NOT IN (6, 7, 8, 9))
SELECT name AS subject, 'no_encoding' AS reason FROM peptides WHERE seq NOT IN (SELECT seq FROM good)""",
)
def order_violations(spark, sf):
    oligos, peptides = oligo_views(spark, sf)
    return flows.order_job(peptides, _encoded(peptides), oligos, ORDER_PREFIX, ORDER_SUFFIX, 6)["violations"]


@REGISTRY.add(
    "f6_binding_join",
    """WITH r AS (SELECT user_id AS m, user_id % 3 AS t, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS base, sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS a,
  sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS b, count(*) AS n FROM events GROUP BY user_id)
SELECT m AS library_member, (n % 5 < 3 AND n % 7 < 5) AS is_pass, CASE t WHEN 0 THEN 'clik' WHEN 1 THEN 'errr' END AS cognate_ab,
  round(CASE t WHEN 0 THEN log10(1 + a) - log10(1 + base) WHEN 1 THEN log10(1 + b) - log10(1 + base * 2) END, 6) AS enrichment FROM r""",
)
def binding(spark, sf):
    from peptarium.catalog.views import r6, readout
    from peptarium.operators.predicates import Condition
    from peptarium.sources.tables import assay_map

    wide = readout(spark, sf).withColumn("designedSequence", F.concat(F.lit("S"), "library_member"))
    a = wide.select("library_member", "Target", "designedSequence", "NoAb_1", "Xclik_1X")
    b = wide.select("library_member", (F.col("NoAb_1") * 2).alias("NoAb_2"), "Xerrr_1X")
    counts = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    metrics = counts.select(F.concat(F.lit("S"), "user_id").alias("designedSequence"), (F.col("n") % 5).alias("overall_rmsd"), (F.col("n") % 7).alias("mean_pae"))
    limits = (Condition("overall_rmsd", "<", 3), Condition("mean_pae", "<", 5))
    out = flows.binding_join(a, b, metrics, assay_map(a, b), ["overall_rmsd", "mean_pae"], conditions=limits)
    return r6(out.select("library_member", "is_pass", "cognate_ab", F.col("cognate_log_enrichment").alias("enrichment")))
