"""Near-duplicate documents with b-bit MinHash.

1. Each text becomes its set of 5-word shingle hashes; texts with equal sets are one class from here on.
2. ``BANDS * ROWS`` minima per class. Bands of the full minima give candidate keys; of the minima
   themselves only the low ``BITS`` bits stay, packed into longs.
3. In each band bucket every member is paired with the bucket's smallest class only. Pairs are scored
   from the packed bits: with collision chance c = 2**-BITS per position, J = (E - c) / (1 - c) for the
   share E of equal positions. Pairs more than ``SLACK`` (eight standard errors) under the threshold go;
   the rest are confirmed on the full sets. Confirmed links give components.
4. Buckets whose members, the smallest aside, are still in different components are opened again, and
   members of different components are compared inside the tasks, in blocks streamed past each other: first
   on bands and packed bits alone, which leaves the members with a likely partner; only those bring their
   texts to a second such pass, and only links come out of it. So no link between components is missed, and
   no bucket emits its pairs as rows.

A pair at similarity 0.75 shares none of the 48 bands with probability (1 - 0.75**5)**48 = 2e-6.

Defined cases: null, empty or blank texts have the empty set, are linked with nothing and always kept;
texts of one to four words are one shingle; a null id sorts first; rows that repeat an id are one
document and share its fate unless their texts differ, then each text is linked on its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import MULTIPLIERS, Words, id_key, id_of, mixed, partitions, run_hashes, slices, stored
from peptarium.llm.components import components

SHINGLE = 5
BANDS, ROWS, BITS = 48, 5, 4
#: members of a block and of a run streamed past it, when texts travel with them and when only bits do
BLOCK, RUN = 512, 8192
BITS_BLOCK, BITS_RUN = 4096, 65_536
NEED, OF = 75, 100
SLACK = 0.25

_rng = np.random.Generator(np.random.PCG64(31))
_A = _rng.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: pa.LargeStringArray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Words(texts)
    h = words.hashes(folded=True)
    runs = run_hashes(h, SHINGLE)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(mixed(np.sum(h[a:b] * MULTIPLIERS[8 : 8 + b - a], keepdims=True) + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, BANDS) and packed low bits (n, longs), both int64; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(sets), BANDS * ROWS), np.uint64)
    y = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.multiply(x, _A[k], out=y)
        np.add(y, _B[k], out=y)
        minima[:, k] = np.minimum.reduceat(y, starts)
    minima = mixed(minima + (np.arange(BANDS * ROWS, dtype=np.uint64) << np.uint64(32)))
    keys = mixed((minima.reshape(len(sets), BANDS, ROWS) * MULTIPLIERS[:ROWS]).sum(axis=2))
    per = 64 // BITS
    low = (minima & np.uint64(2**BITS - 1)).reshape(len(sets), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return keys.view(np.int64), np.bitwise_or.reduce(low, axis=2).view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """_id, _row (text hash), node (class of the set, null if empty), n_shingles, bands, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            sets = shingle_sets(piece.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            node: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            packed: list = [None] * len(sets)
            if full:
                keys, bits = signatures([sets[i] for i in full])
                for i, k, p in zip(full, keys, bits, strict=True):
                    node[i] = int.from_bytes(hashlib.blake2b(sets[i].tobytes(), digest_size=8).digest(), "little", signed=True)
                    bands[i], packed[i] = k, p
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("_id"),
                    piece.column("_row"),
                    pa.array(node, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(packed, pa.list_(pa.int64())),
                ],
                ["_id", "_row", "node", "n_shingles", "bands", "packed"],
            )

    source = docs.select(id_key().alias("_id"), F.xxhash64("text").alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "_id bigint, _row bigint, node bigint, n_shingles bigint, bands array<bigint>, packed array<bigint>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits, corrected for chance collisions."""
    chance = 2.0**-BITS

    def unequal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        any_bit = z
        for k in range(1, BITS):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(z, k))
        ones = sum(1 << (BITS * i) for i in range(64 // BITS))
        return F.bit_count(any_bit.bitwiseAND(F.lit(ones)))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, v: s + v)
    return (1 - differ / F.lit(BANDS * ROWS) - chance) / (1 - chance)


def confirm(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for whole in batches:
            for piece in slices(iter([whole]), "text_b"):
                left, right = piece.column("a").to_pylist(), piece.column("b").to_pylist()
                hubs = piece.column(piece.schema.get_field_index("text_a"))
                keep_a, keep_b = [], []
                for i, (a, b, other) in enumerate(zip(left, right, shingle_sets(piece.column("text_b")), strict=True)):
                    if last[0] != a:
                        last = (a, shingle_sets(pa.array([hubs[i].as_py()], pa.large_string()))[0])
                    both = len(np.intersect1d(last[1], other, assume_unique=True))
                    if OF * both >= NEED * (len(last[1]) + len(other) - both):
                        keep_a.append(a)
                        keep_b.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], ["a", "b"])

    bits = classes.select("node", "packed")
    scored = (
        pairs.join(bits.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a")
        .join(bits.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")
        .where(estimate(F.col("pa"), F.col("pb")) >= NEED / OF - SLACK)
        .select("a", "b")
    )
    full = (
        scored.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )
    return full.mapInArrow(run, "a bigint, b bigint")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members to compare again, with their component: key, band, node, c.

    The smallest class of a bucket has met all others there and stays out; buckets whose other members are
    in one component are done.
    """
    rows = members.where("node != hub").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    ends = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    return rows.join(ends, "key", "left_semi").select("key", "band", "node", "c")


def dealt(left: DataFrame, wide: DataFrame, block: int, run: int) -> DataFrame:
    """Members of open buckets with the columns of ``wide``, dealt and sorted for streaming past blocks.

    In each bucket the largest component is the bulk; members of it need not meet each other. The rest is
    cut into blocks, all members into runs, and each (block, run) is one group whose run is streamed past
    the block.
    """
    parts = left.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "c")).alias("top"), F.sum("k").alias("all"))
    sized = parts.select("key", F.col("top.c").alias("bulk"), F.ceil((F.col("all") - F.col("top.k")) / block).cast("int").alias("blocks"), F.ceil(F.col("all") / run).cast("int").alias("runs"))
    rows = left.join(sized.where("blocks > 0"), "key").withColumn("rest", F.col("c") != F.col("bulk"))
    at = F.xxhash64(F.lit("block"), "node")
    block_no, run_no = F.pmod(at, F.col("blocks")).cast("int"), F.pmod(at, F.col("runs")).cast("int")
    sides = F.array_union(
        F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("runs") - 1), lambda r: F.struct(block_no.alias("b"), r.alias("r"), F.lit(0).alias("side")))).otherwise(
            F.array().cast("array<struct<b:int,r:int,side:int>>")
        ),
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.alias("b"), run_no.alias("r"), F.lit(1).alias("side"))),
    )
    more = [c for c in wide.columns if c != "node"]
    spread = rows.join(wide, "node").select("key", "band", "node", "c", "rest", *more, F.explode(sides).alias("at"))
    named = spread.select(F.xxhash64("key", "at.b", "at.r").alias("g"), "at.side", "key", "band", "node", "c", "rest", *more)
    return named.repartition(partitions(left.sparkSession), "g").sortWithinPartitions("g", "side", "node")


def partnered(left: DataFrame, classes: DataFrame) -> DataFrame:
    """(key, node) of the members whose bands and packed bits speak for a link across components."""
    bits = dealt(left, classes.select("node", "bands", "packed"), BITS_BLOCK, BITS_RUN)
    return bits.mapInArrow(_partners_past_blocks, "key bigint, node bigint").distinct()


def open_links(left: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components in open buckets; one per block member and component is reported.

    A pair is looked at in its first common band only, scored from the packed bits, then confirmed on the
    full sets.
    """
    near = stored(left.join(partnered(left, classes), ["key", "node"], "left_semi"), "near")
    return dealt(near, classes.select("node", "bands", "packed").join(texts, "node"), BLOCK, RUN).mapInArrow(_links_past_blocks, "a bigint, b bigint")


@dataclass
class Side:
    key: np.ndarray
    node: np.ndarray
    c: np.ndarray
    rest: np.ndarray
    band: np.ndarray
    bands: np.ndarray
    packed: np.ndarray
    sets: list[np.ndarray]

    def cut(self, a: int, b: int) -> Side:
        return Side(self.key[a:b], self.node[a:b], self.c[a:b], self.rest[a:b], self.band[a:b], self.bands[a:b], self.packed[a:b], self.sets[a:b])

    def plus(self, other: Side) -> Side:
        return Side(*(np.concatenate([getattr(self, f), getattr(other, f)]) for f in ("key", "node", "c", "rest", "band", "bands", "packed")), self.sets + other.sets)


def _past_blocks(pieces: Iterator[pa.RecordBatch]) -> Iterator[tuple[Side, Side]]:
    """Each block with each piece of the run that is streamed past it; ``sets`` are empty without texts."""
    group, block = None, None
    for piece in pieces:
        column = lambda name: piece.column(piece.schema.get_field_index(name))  # noqa: B023, E731
        wide = lambda name: column(name).flatten().to_numpy().reshape(piece.num_rows, -1)  # noqa: B023, E731
        g, side = column("g").to_numpy(), column("side").to_numpy()
        now = Side(
            column("key").to_numpy(),
            column("node").to_numpy(),
            column("c").to_numpy(),
            column("rest").to_numpy(zero_copy_only=False),
            column("band").to_numpy(),
            wide("bands"),
            wide("packed").view(np.uint64),
            shingle_sets(column("text")) if "text" in piece.schema.names else [],
        )
        cuts = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(g)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if side[a] == 0:
                block = block.plus(now.cut(a, b)) if block is not None and group == g[a] else now.cut(a, b)
                group = g[a]
            elif group == g[a]:
                yield block, now.cut(a, b)


def _likely(block: Side, run: Side) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Slices of the block (their start) with index pairs (in the slice, in the run) that score high enough."""
    ones, chance = np.uint64(sum(1 << (BITS * i) for i in range(64 // BITS))), 2.0**-BITS
    step = max(1, (1 << 22) // max(1, len(run.node) * BANDS))
    for a in range(0, len(block.node), step):
        x = block.cut(a, a + step)
        equal = x.bands[:, None, :] == run.bands[None, :, :]
        near = (equal.argmax(axis=2) == x.band[:, None]) & equal.any(axis=2) & (x.c[:, None] != run.c) & (~run.rest | (x.node[:, None] < run.node))
        i, j = np.nonzero(near)
        z = x.packed[i] ^ run.packed[j]
        any_bit = z
        for k in range(1, BITS):
            any_bit = any_bit | (z >> np.uint64(k))
        share = 1 - np.bitwise_count(any_bit & ones).sum(axis=1) / (BANDS * ROWS)
        good = (share - chance) / (1 - chance) >= NEED / OF - SLACK
        yield a, i[good], j[good]


def _partners_past_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, run in _past_blocks(b for b in batches if b.num_rows):
        mine, theirs = np.zeros(len(block.node), bool), np.zeros(len(run.node), bool)
        for a, i, j in _likely(block, run):
            mine[a + i], theirs[j] = True, True
        if theirs.any():
            found = [np.concatenate([getattr(block, f)[mine], getattr(run, f)[theirs]]) for f in ("key", "node")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["key", "node"])


def _links_past_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, run in _past_blocks(slices(batches)):
        sizes, out_a, out_b = np.array([len(s) for s in run.sets]), [], []
        for a, i, j in _likely(block, run):
            for k in np.unique(i).tolist():
                own, others = block.sets[a + k], j[i == k]
                flat = np.concatenate([run.sets[m] for m in others.tolist()])
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
                linked = others[OF * both >= NEED * (len(own) + sizes[others] - both)]
                _, first = np.unique(run.c[linked], return_index=True)
                out_a += [int(block.node[a + k])] * len(first)
                out_b += run.node[linked[first]].tolist()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out_a, out_b)], ["a", "b"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """_id, _row, n_shingles, component (an id key); one row per input row."""
    signed = stored(sign(docs), "signatures")
    classes = stored(
        signed.where("node is not null")
        .groupBy("node")
        .agg(F.min(F.struct("_id", "_row")).alias("rep"), F.first("bands").alias("bands"), F.first("packed").alias("packed"))
        .select("node", "rep._id", "rep._row", "bands", "packed"),
        "classes",
    )
    keyed = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(buckets, "key"), "members")
    starred = members.where("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    needed = classes.select("node", "_id", "_row").join(members.select("node").distinct(), "node", "left_semi")
    whole = docs.select(id_key().alias("_id"), F.xxhash64("text").alias("_row"), "text")
    # rows that repeat an id and a text meet here on one key: one of them stands for the class
    texts = stored(whole.join(needed, ["_id", "_row"]).dropDuplicates(["_id", "_row", "node"]).select("node", "text"), "texts")

    links = stored(confirm(starred, classes, texts), "links")
    left = stored(open_members(members, components(links)), "open")
    links = stored(links.union(open_links(left, classes, texts)), "links")

    joined = components(links).join(classes.select("node", "_id"), "node")
    least = joined.groupBy("component").agg(F.min("_id").alias("least"))
    moved = joined.join(least, "component").select("node", "least")
    named = classes.select("node", "_id").join(moved, "node", "left").select("node", F.coalesce("least", "_id").alias("component"))
    rows = signed.select("_id", "_row", "node", "n_shingles").join(named, "node", "left")
    return rows.select("_id", "_row", "n_shingles", F.coalesce("component", "_id").alias("component"))


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select(id_of("_id").alias("doc_id"), "n_shingles", id_of("component").alias("component_id"), (F.col("_id") == F.col("component")).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of the first document of each group; columns unchanged."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("_id != component").select("_id", "_row").distinct()
    wide = docs.select(F.struct(*docs.columns).alias("_doc"), id_key().alias("_id"), F.xxhash64("text").alias("_row"))
    left = wide.join(gone, ["_id", "_row"], "left_anti")
    return left.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])
