"""Shared pieces: table access, written intermediate tables, and word grids over Arrow batches.

Conventions of every operator here:

- A null ``doc_id`` (or ``page_id``) is a valid id that sorts before all others; it comes back as null.
- A null text is an empty text.
- Rows that repeat an id are one document as far as "earlier" and "another document" go; each row
  still gets its own result.
- Input columns the operator does not need are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptarium.session import shared_scratch

NULL_ID = -(2**63)
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_key(column: str = "doc_id") -> Column:
    """The id as a never-null long; null sorts first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_of(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``limit`` bytes a piece; one long text stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        if not pa.types.is_large_string(batch.column(at).type):
            batch = batch.set_column(at, column, batch.column(at).cast(pa.large_string()))
        ends = np.cumsum(np.diff(offsets_of(batch.column(at))))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def offsets_of(texts: pa.LargeStringArray) -> np.ndarray:
    raw = np.frombuffer(texts.buffers()[1], np.int64) if texts.buffers()[1] is not None else np.zeros(1, np.int64)
    return raw[texts.offset : texts.offset + len(texts) + 1]


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
FOLD = np.arange(256)
FOLD[65:91] += 32
BYTE_CODE_FOLDED = BYTE_CODE[FOLD]
MULTIPLIERS = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a piece of an Arrow text column, as flat arrays.

    ``starts``/``ends`` are byte places in ``data``; ``first`` has, per text, the index of its first
    word, with the word count as last entry.
    """

    def __init__(self, texts: pa.LargeStringArray):
        offsets = offsets_of(texts)
        base = int(offsets[0])
        raw = texts.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[base : int(offsets[-1])] if raw is not None else np.zeros(0, np.uint8)
        self.bounds = offsets - base
        inside = np.zeros(len(self.data) + 1, bool)
        np.logical_not(SPACE[self.data], out=inside[:-1])
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        cuts = self.bounds[:-1]
        starts[cuts] = inside[cuts]
        ends = np.zeros(len(self.data) + 1, bool)
        ends[1:] = inside[:-1] & ~inside[1:]
        later = cuts[cuts > 0]
        ends[later] = inside[later - 1]
        self.starts, self.ends = np.flatnonzero(starts), np.flatnonzero(ends)
        self.first = np.searchsorted(self.starts, self.bounds)
        self.first[-1] = len(self.starts)

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, folded: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``folded`` takes A-Z as a-z."""
        up, down = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((BYTE_CODE_FOLDED if folded else BYTE_CODE)[self.data] * up[: len(self.data)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def ids(self) -> tuple[np.ndarray, pa.Array]:
        """Exact small integers for the words, and the distinct words they stand for."""
        keep = ~SPACE[self.data]
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        flat = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[keep])])
        coded = flat.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring word hashes (runs may cross texts; the caller masks those)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = words[:n] * MULTIPLIERS[0]
    for k in range(1, size):
        total += words[k : k + n] * MULTIPLIERS[k]
    return mixed(total)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if t is None else t for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
