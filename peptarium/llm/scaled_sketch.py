"""Threshold-scaled document sketches.

A sketch keeps every shingle hash below ``2**64 / SCALE``. The threshold is the same for all
documents, so the sketch grows with the text, the union of two sketches is the sketch of both texts
together (but for the fallback hash below, which a union should leave out), and the share of one sketch found in another estimates containment even when one text is a
hundred times longer. Shingles are windows of ``WIDTH`` UTF-8 bytes (a shorter text is one shingle).

Defined cases: an empty or null text has the empty sketch; a non-empty text none of whose hashes falls
under the threshold keeps its smallest hash, so only empty texts have empty sketches; likeness is 1 for
equal sketches, 0 if exactly one is empty; rows with equal ids are ordered by text; a single row is its
own next document.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import BYTE_CODE, SLICE_BYTES, _power, id_key, mixed, offsets_of, partitions, slices

SCALE = 32
WIDTH = 24


def sketches(texts: pa.LargeStringArray, scale: int = SCALE, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct retained hashes, one array per text."""
    offsets = offsets_of(texts)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    limit = np.uint64(2**64 // scale - 1)
    full = mixed((sums[width:] - sums[:-width]) * down[: max(0, len(data) + 1 - width)]) if len(data) >= width else np.zeros(0, np.uint64)
    low = np.flatnonzero(full <= limit)
    first, last = np.searchsorted(low, bounds[:-1]), np.searchsorted(low, bounds[1:] - width + 1)
    out = []
    for i in range(len(bounds) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if a == b:
            out.append(np.zeros(0, np.uint64))
        elif b - a < width:
            out.append(mixed((sums[b : b + 1] - sums[a : a + 1]) * down[a : a + 1]))
        elif last[i] > first[i]:
            out.append(np.unique(full[low[first[i] : last[i]]]))
        else:
            out.append(full[a : b - width + 1].min(keepdims=True))
    return out


def encoded(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller sketch in the larger."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, n_hashes for each row, in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            got = sketches(piece.column(1))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array([encoded(s) for s in got], pa.string()), pa.array([len(s) for s in got], pa.int64())],
                ["doc_id", "fingerprint", "n_hashes"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, fingerprint string, n_hashes bigint")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, part, tail in runs of descending ids.

    Ids are cut into ranges of near-equal counts; each range is one part and also gets, as tail, the
    first row of the range below it (of the highest range for the lowest). Only the highest id of each
    range, as many as there are shuffle partitions, is known to the driver.
    """
    spark = docs.sparkSession
    base = docs.select(id_key().alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    row = base.select(F.percentile_approx("_id", [k / n for k in range(1, n)], 10_000).alias("e")).first() if n > 1 else None
    edges = np.array(sorted(set((row and row["e"]) or [])), np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(), "right").astype(np.int32))

    parted = base.withColumn("part", part_of("_id"))
    heads = sorted((r["part"], r["top"]) for r in base.select("_id", part_of("_id").alias("part")).groupBy("part").agg(F.max("_id").alias("top")).collect())
    tails = spark.createDataFrame([(heads[i - 1][1], heads[i][0]) for i in range(len(heads))], "_id bigint, part int")
    rows = parted.withColumn("tail", F.lit(0)).unionByName(base.join(F.broadcast(tails), "_id").withColumn("tail", F.lit(1)))
    return rows.repartition(n, "part").sortWithinPartitions("part", "tail", F.desc("_id"), "text")


def fingerprints_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and both likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # last row not yet paired: part, id, text, sketch
        for piece in slices(batches, "text", SLICE_BYTES // 2):
            part, ids, tail = (piece.column(c).to_pylist() for c in ("part", "_id", "tail"))
            texts, got = piece.column("text").to_pylist(), sketches(piece.column("text"))
            pairs = []
            for now in zip(part, ids, texts, got, tail, strict=True):
                if held is not None and held[0] == now[0]:
                    pairs.append((held, now))
                held = None if now[4] else now
            changed = [edited(a[2], b[2]) for a, b in pairs]
            after = sketches(pa.array(changed, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[1] for a, _ in pairs], pa.int64()),
                    pa.array([len(a[2]) for a, _ in pairs], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                    pa.array([encoded(a[3]) for a, _ in pairs], pa.string()),
                    pa.array([encoded(s) for s in after], pa.string()),
                    pa.array([likeness(a[3], s) for (a, _), s in zip(pairs, after, strict=True)], pa.float64()),
                    pa.array([likeness(a[3], b[3]) for a, b in pairs], pa.float64()),
                    pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                ],
                ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes"],
            )

    out = with_next(docs).select("part", "_id", "text", "tail").mapInArrow(
        run,
        "_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, n_hashes bigint",
    )
    return out.select(F.when(F.col("_id") != -(2**63), F.col("_id")).alias("doc_id"), *out.columns[1:])
