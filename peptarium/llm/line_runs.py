"""Line de-duplication with levelled sorted runs of line hashes.

Documents arrive in batches, ascending in ``doc_id``. A run is a table of (h1, h2, first): the
128-bit hash of each line key seen for the first time in some batch and the smallest document that
holds it, bucketed and sorted by the hash. A new batch is reduced to its own distinct keys,
merge-anti-joined against every live run, and what is left becomes a new run. When a level holds
``fanout`` runs they are compacted into one run of the next level, so a batch meets at most
``fanout`` runs per level and there are log(batches) levels. Runs hold disjoint keys.

A line goes when its key is first seen in a smaller document. All of it is DataFrame work.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code points always
stay; all copies of a line inside the smallest document stay; rows that repeat a doc_id are one
document; a null doc_id comes first; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptarium.llm.common import id_key, partitions, stored
from peptarium.session import shared_scratch

MIN_CHARS = 10
BATCHES = 4
FANOUT = 2
_BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The stripped line with A-Z lower-cased, in a form that is equal for equal keys only.

    ``lower`` alone would also change other capitals. Lines with other letters are therefore lowered as
    Latin-1 readings of their UTF-8 bytes: that moves A-Z and, among the rest, only lead bytes C0-DE to
    E0-FE. A moved lead byte is still told from a true one by the number of continuation bytes after it,
    so different lines stay different. ``translate`` says the same ten times slower.
    """
    bare = F.trim(line, F.lit(_BLANK))
    latin = F.lower(F.decode(bare.cast("binary"), "ISO-8859-1"))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(latin)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One narrow row per line that can be a duplicate: id key, row hash, line number from 1, key hash."""
    return (
        docs.select(id_key().alias("_id"), F.xxhash64("text").alias("_row"), F.posexplode(lines_of(F.col("text"))).alias("_pos", "_line"))
        .where(F.char_length(F.trim("_line", F.lit(_BLANK))) >= min_chars)
        .select("_id", "_row", (F.col("_pos") + 1).alias("_pos"), line_key(F.col("_line")).alias("_key"))
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit("second"), F.col("_key")).alias("h2"))
    )


@dataclass
class RunStore:
    """Live runs by level; each is a bucketed table, one sorted file a bucket, of a database of its own.

    The database lies in the shared folder; ``close`` drops it with its tables and files.
    """

    spark: SparkSession
    fanout: int = FANOUT
    levels: list[list[str]] = field(default_factory=list)
    name: str = field(default_factory=lambda: f"line_runs_{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        place = shared_scratch(self.spark, self.name).replace("'", "\\'")
        self.spark.sql(f"CREATE DATABASE {self.name} LOCATION '{place}'")

    def close(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.name} CASCADE")

    def _write(self, keys: DataFrame) -> str:
        """``keys`` must be dealt as the buckets are, so that a bucket is one file."""
        run, n = f"{self.name}.run_{uuid.uuid4().hex}", partitions(self.spark)
        keys.write.bucketBy(n, "h1", "h2").sortBy("h1", "h2").format("parquet").saveAsTable(run)
        return run

    def add(self, batch: DataFrame) -> None:
        """``batch``: hashed lines of the next documents."""
        fresh = batch.groupBy("h1", "h2").agg(F.min("_id").alias("first"))
        for run in self.live():
            fresh = fresh.join(self.spark.table(run).hint("merge"), ["h1", "h2"], "left_anti")
        self._put(0, self._write(fresh.repartition(partitions(self.spark), "h1", "h2")))

    def _put(self, level: int, run: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self._write(self.merged(self.levels[level]))
            for old in self.levels[level]:
                self.spark.sql(f"DROP TABLE IF EXISTS {old}")
            self.levels[level] = []
            self._put(level + 1, merged)

    def merged(self, runs: list[str]) -> DataFrame:
        """Bucket meets bucket in a merge join that keeps the keys of both sides; two runs need no shuffle."""
        out = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).withColumnRenamed("first", "other").hint("merge")
            out = out.join(other, ["h1", "h2"], "full_outer").select("h1", "h2", F.least("first", "other").alias("first"))
        return out

    def live(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, [self.spark.table(run) for run in self.live()])


def batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """Id keys that start the second, third, ... batch; near-equal counts, never through equal ids."""
    if batches < 2:
        return []
    row = docs.select(F.percentile_approx(id_key(), [k / batches for k in range(1, batches)], 10_000).alias("e")).first()
    return sorted(set(row["e"] or []))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with ``text`` cut to the lines that stay, and ``n_lines``, ``n_dropped``.

    If the input has columns of those two names they are replaced. ``text`` is never null afterwards.
    """
    hashed = stored(hashed_lines(docs, min_chars), "lines")
    edges = batch_edges(docs, batches)
    store = RunStore(docs.sparkSession, fanout)
    try:
        for low, high in zip([None, *edges], [*edges, None], strict=True):
            batch = hashed
            if low is not None:
                batch = batch.where(F.col("_id") >= low)
            if high is not None:
                batch = batch.where(F.col("_id") < high)
            store.add(batch)
        late = stored(
            hashed.join(store.rows(), ["h1", "h2"]).where(F.col("first") < F.col("_id")).groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_late")),
            "late",
        )
    finally:
        store.close()
    # the input row travels as one struct, so its column names cannot clash with ours
    wide = docs.select(F.struct(*docs.columns).alias("_doc"), id_key().alias("_id"), F.xxhash64("text").alias("_row"))
    joined = wide.join(late, ["_id", "_row"], "left").withColumn("_lines", lines_of(F.col("_doc.text")))
    at = F.array_except(F.sequence(F.lit(1), F.size("_lines")), F.coalesce("_late", F.array().cast("array<int>")))
    left = F.array_join(F.transform(at, lambda p: F.element_at("_lines", p)), "\n")
    text = F.when(F.col("_late").isNull(), F.coalesce("_doc.text", F.lit(""))).otherwise(left)
    kept = [text.alias(c) if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    n_dropped = F.when(F.col("_late").isNull(), F.lit(0)).otherwise(F.size("_late"))
    return joined.select(*kept, F.size("_lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"))
