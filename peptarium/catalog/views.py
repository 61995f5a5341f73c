"""Design-shaped views of the driver tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptarium.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pool(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate design per line item; clash and epitope error are missing on line 7."""
    li = table(spark, sf, "lineitem")
    known = F.col("l_linenumber") != 7
    key = F.concat_ws(
        "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], F.date_format("l_shipdate", "yyyyMMdd")
    )
    return li.select(
        key.alias("key"),
        F.col("l_suppkey").alias("id"),
        F.col("l_returnflag").alias("antigen"),
        F.col("l_linenumber").alias("island_index"),
        F.when(known, F.col("l_quantity")).alias("af3_n_clash_res"),
        F.col("l_quantity").alias("cylinder_ca_clashes"),
        F.greatest(F.col("l_quantity") - F.col("l_linenumber"), F.lit(0.0)).alias("cylinder_native_aware"),
        (F.col("l_discount") * 20).alias("epitope_chunk_rmsd"),
        (F.col("l_tax") * 40).alias("overall_rmsd"),
        (F.col("l_tax") * 60).alias("scaffold_rmsd"),
        F.when(known, F.col("l_extendedprice") / 10000).alias("epitope_pae"),
        (F.col("l_extendedprice") / 8000).alias("mean_pae"),
        (F.col("l_extendedprice") / 9000).alias("scaffold_pae"),
        F.when(F.col("l_linenumber") == 5, "Failed").otherwise("OK").alias("status"),
        (F.col("l_linestatus") == "F").alias("label"),
    )


POOL_SQL = """pool AS (SELECT
  concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y%m%d')) AS key,
  l_suppkey AS id, l_returnflag AS antigen, l_linenumber AS island_index,
  CASE WHEN l_linenumber <> 7 THEN l_quantity END AS af3_n_clash_res,
  l_quantity AS cylinder_ca_clashes, greatest(l_quantity - l_linenumber, 0.0) AS cylinder_native_aware,
  l_discount * 20 AS epitope_chunk_rmsd, l_tax * 40 AS overall_rmsd, l_tax * 60 AS scaffold_rmsd,
  CASE WHEN l_linenumber <> 7 THEN l_extendedprice / 10000 END AS epitope_pae,
  l_extendedprice / 8000 AS mean_pae, l_extendedprice / 9000 AS scaffold_pae,
  CASE WHEN l_linenumber = 5 THEN 'Failed' ELSE 'OK' END AS status,
  l_linestatus = 'F' AS label FROM lineitem)"""

PASS_SQL = "coalesce(overall_rmsd <= 2 AND epitope_chunk_rmsd <= 1 AND mean_pae < 5 AND af3_n_clash_res = 0, false)"
# whole counts never reach 0 in the data, so queries that need passers accept a few clashes
NEAR_SQL = "coalesce(overall_rmsd <= 2 AND epitope_chunk_rmsd <= 1 AND mean_pae < 5 AND af3_n_clash_res <= 12, false)"


def near_pass():
    from peptarium.operators.predicates import FOUR_FILTER, Condition

    return (*FOUR_FILTER[:3], Condition("af3_n_clash_res", "<=", 12.0))


def points(spark: SparkSession, sf: str) -> DataFrame:
    """21 points per vector from its first 63 floats, scaled to a protein's size and moved along x by the last one; the first 6 are the epitope."""
    e = table(spark, sf, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("design_id"), F.col("label").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("res_idx"), "embedding"
    )
    at = lambda k: (F.get("embedding", F.col("res_idx") * 3 + k).cast("double") * 40.0)
    return rows.select("design_id", "id", "res_idx", (at(0) + F.get("embedding", F.lit(63)).cast("double")).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("res_idx") < 6).alias("is_epitope"))


POINTS_SQL = """points AS (SELECT vec_id AS design_id, label AS id, r AS res_idx,
  CAST(embedding[r*3+1] AS DOUBLE) * 40.0 + CAST(embedding[64] AS DOUBLE) AS x, CAST(embedding[r*3+2] AS DOUBLE) * 40.0 AS y,
  CAST(embedding[r*3+3] AS DOUBLE) * 40.0 AS z, r < 6 AS is_epitope
  FROM embeddings, (SELECT unnest(range(21)) AS r))"""


def mirrored(spark: SparkSession, sf: str) -> DataFrame:
    """A second point set per design: the same vector read backwards. Serves as the native structure."""
    e = table(spark, sf, "embeddings")
    rows = e.select(F.col("vec_id").alias("design_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("res_idx"), "embedding")
    at = lambda k: (F.get("embedding", F.lit(63) - F.col("res_idx") * 3 - k).cast("double") * 40.0)
    return rows.select("design_id", "res_idx", (at(0) + F.get("embedding", F.lit(0)).cast("double")).alias("x"), at(1).alias("y"), at(2).alias("z"), (F.col("res_idx") < 6).alias("is_epitope"))


MIRROR_SQL = """mirror AS (SELECT vec_id AS design_id, r AS res_idx,
  CAST(embedding[64-r*3] AS DOUBLE) * 40.0 + CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[63-r*3] AS DOUBLE) * 40.0 AS y,
  CAST(embedding[62-r*3] AS DOUBLE) * 40.0 AS z, r < 6 AS is_epitope
  FROM embeddings, (SELECT unnest(range(21)) AS r))"""


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    """Two-island contigs of 104 residues from parts."""
    p = table(spark, sf, "part")
    n = F.col("p_size")
    a = F.col("p_partkey") % 50 + 1
    first, second = n % 9 + 1, n % 20 + 2
    gap = n % 7 + 3
    rest = F.lit(104) - n % 30 - first - second - gap
    shape = F.concat_ws(
        "/",
        F.format_string("%d-%d", n % 30, n % 30),
        F.format_string("A%d-%d", a, a + first - 1),
        F.format_string("%d-%d", gap, gap),
        F.format_string("A%d-%d", a + 40, a + 39 + second),
        F.format_string("%d-%d", rest, rest),
    )
    contacts = F.array(*[(x - 1).cast("int") for x in (a, a + first - 1, a + 40, a + 39 + second)])
    return p.select(
        F.concat(F.lit("t"), (F.col("p_partkey") % 400).cast("string")).alias("id"),
        F.col("p_partkey").alias("contig_id"),
        shape.alias("contig_string"),
        F.lit("104-104").alias("contig_length"),
        F.array_distinct(contacts).alias("epitope_resindices"),
        F.lit(2).alias("epitope_chunks"),
        F.concat(F.lit("/data/"), F.col("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".pdb")).alias("input_pdb"),
    )


CONTIGS_SQL = """contigs AS (SELECT 't' || (p_partkey % 400) AS id, p_partkey AS contig_id,
  n || '-' || n || '/A' || a || '-' || (a+f-1) || '/' || g || '-' || g || '/A' || (a+40) || '-' || (a+39+s) || '/' || c || '-' || c AS contig_string,
  '104-104' AS contig_length, CASE WHEN f = 1 THEN [a-1, a+39, a+38+s] ELSE [a-1, a+f-2, a+39, a+38+s] END AS epitope_resindices, 2 AS epitope_chunks,
  '/data/' || p_brand || '/' || p_partkey || '.pdb' AS input_pdb, n, a, f, g, s, c
  FROM (SELECT *, p_size % 30 AS n, p_partkey % 50 + 1 AS a, p_size % 9 + 1 AS f, p_size % 20 + 2 AS s, p_size % 7 + 3 AS g,
    104 - p_size % 30 - (p_size % 9 + 1) - (p_size % 20 + 2) - (p_size % 7 + 3) AS c FROM part))"""


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts as peptide-like strings: ASCII letters only, upper case."""
    d = spread(table(spark, sf, "documents"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.upper(F.regexp_replace("text", "[^A-Za-z]+", "")).alias("seq"), "lang", "source")


SEQS_SQL = "seqs AS (SELECT doc_id AS id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq, lang, source FROM documents)"


def cased(spark: SparkSession, sf: str) -> DataFrame:
    """Whole document texts as case-encoded strings: ASCII letters with their own case."""
    d = spread(table(spark, sf, "documents"), "doc_id")
    return d.select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^A-Za-z]+", "").alias("scaffoldEPITOPE"), F.col("source").alias("target"))


CASED_SQL = "cased AS (SELECT doc_id AS id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS scaffoldEPITOPE, source AS target FROM documents)"


def readout(spark: SparkSession, sf: str) -> DataFrame:
    """Assay table: one member per user, event values as signals, views as the baseline."""
    e = table(spark, sf, "events")
    kinds = ("click", "error", "purchase", "signup", "view")
    wide = e.groupBy("user_id").agg(*[F.round(F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)), 6).alias(k) for k in kinds])
    return wide.select(
        F.col("user_id").alias("library_member"),
        F.concat(F.element_at(F.array(F.lit("clik"), F.lit("errr"), F.lit("none")), (F.col("user_id") % 3 + 1).cast("int")), F.lit("_0p")).alias("Target"),
        F.col("view").alias("NoAb_1"),
        F.col("click").alias("Xclik_1X"),
        F.col("error").alias("Xerrr_1X"),
    )


READOUT_SQL = """readout AS (SELECT user_id AS library_member,
  CASE user_id % 3 WHEN 0 THEN 'clik' WHEN 1 THEN 'errr' ELSE 'none' END || '_0p' AS "Target",
  round(sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END), 6) AS "NoAb_1",
  round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 6) AS "Xclik_1X",
  round(sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END), 6) AS "Xerrr_1X"
  FROM events GROUP BY user_id)"""


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that summation order does not show."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c), digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])
