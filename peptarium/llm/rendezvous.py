"""Sharding by weighted rendezvous hashing of stable record keys.

Every (key, shard) pair draws a number u in (0, 1) from the md5 of the two names; a key lives on the
shard with the smallest ``-ln(u) / weight``, so a shard gets a share of the keys in proportion to its
weight. A new shard only ever wins keys for itself: no key moves between old shards, and an expected
``w / total`` of all keys move. The same holds for raising one weight. Nothing but the key and the
weights decides, so any reader can find a record without a table of places.

Slots number the records of a shard from 0 in the order of their keys. They are prefix sums over range
slices, so neither a heavy shard nor a key that owns a third of all rows is numbered in one task.

Defined cases: a null key is the key with the empty name and comes first; rows that repeat a key share
its shard and get slots of their own; a null text has size 1; a weight of 0 takes no keys; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import stored
from peptarium.operators.ordering import row_rank

SHARDS = 8
_DIGITS = 13  # hexadecimal digits of the digest: 52 bits, which a double holds exactly


def draw(key: Column, shard: Column) -> Column:
    """The number in (0, 1) of a key and a shard."""
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary")), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key; ``weights[s]`` is the weight of shard s."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be at least 0 and one of them above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))
    live = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(float(w)).alias("weight")) for s, w in enumerate(weights) if w > 0])
    race = F.transform(live, lambda s: F.struct((-F.log(draw(name, s["shard"])) / s["weight"]).alias("time"), s["shard"].alias("shard")))
    return F.array_min(race)["shard"]


def shard_records(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard after one more of weight ``added`` (``grown_shard``).

    Texts are read once; numbering works on the narrow rows, written to the shared folder first.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), [*weights, added]).alias("grown_shard"),
    )
    rows = stored(narrow, "shards").withColumn("_row", F.monotonically_increasing_id())
    placed = row_rank(rows, ["shard"], ["doc_id", "text_crc32", "size", "_row"], out="_rank")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, weights: Sequence[float] = (1.0,) * SHARDS) -> DataFrame:
    """Write whole rows below ``path``, one folder a shard, and return them as read back with ``shard``.

    A map-only job: every task writes its own file into each folder. If ``docs`` has a column ``shard`` it
    is replaced.
    """
    docs.withColumn("shard", shard_of(F.col("doc_id"), weights)).write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
