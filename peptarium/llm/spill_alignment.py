"""Cross-tokenizer alignment with external spill counting.

1. Texts are encoded by two tokenizers. Byte offsets at which tokens of both end cut a text into groups;
   the A token and the B token that end there are linked.
2. Links become records (pair of ids, document, how often). Tasks collect records of a bounded chunk of
   text, radix-partition them by B id and write one sorted zstd run a bucket: its pairs with totals, and
   apart from them the documents of each pair.
3. Count runs of a bucket are merged through a heap, at most about ``FAN_IN`` runs at a time, level by
   level, until a bucket has one run with the exact count of every pair. Runs are in B-major order, so the
   highest count of a B id is known when its last pair leaves the heap.
4. The final runs, at most (A ids x B ids) pairs whatever the corpus, are dealt to groups of chunks. Each
   group streams its document runs past them, bucket by bucket, and adds what every document gains.

Runs and levels are tables in the shared folder; a lost executor costs its tasks only. No pair, token or
document is gathered in one place: a hot pair is one entry per chunk, a hot B id at most one entry per
A id in a merge.

Both tokenizers treat a word and the space before it apart from the rest (checked for the given files), so
very long texts are encoded in segments that end before a word. Where that does not hold they are encoded
whole.

Defined cases: texts that are null or empty, or that a tokenizer does not give back byte for byte, have no
tokens, all counts 0 and an empty digest; long texts take part whole; rows that repeat an id or a text are
documents of their own; ties for the highest count are all best; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import id_key, id_of, offsets_of, partitions, slices, stored

BUCKETS = 32
CHUNK_BYTES, CHUNK_DOCS = 1 << 24, 1 << 14
FAN_IN = 64
FRAME = 1 << 13
A_BITS = 24  # a pair of ids is b << A_BITS | a; with the place in a chunk it fits a long
SEGMENT = 1 << 16
CUT = re.compile(r"(?<=\S) (?=\S)")

_POINTS = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _POINTS} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _POINTS)}


class TokenPair:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_b = self.b.get_piece_size()
        names_a = {i: t for t, i in self.a.get_vocab().items()}
        self.bytes_a = [self._level(names_a.get(i, "")) for i in range(max(names_a) + 1)]
        self.bytes_b = [self._piece(i) for i in range(size_b)]
        self.table_a, self.table_b = self._table(self.bytes_a), self._table(self.bytes_b)
        self.names = [f"{i}{end}" for side, last in ((self.bytes_a, "|"), (self.bytes_b, ";")) for i in range(len(side)) for end in (",", last)]
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        if max(len(self.bytes_a), size_b) >= 1 << A_BITS:
            raise ValueError(f"a vocabulary has more than 2**{A_BITS} tokens")
        plain = self._plain_a(spec)
        self.fast_a = self._ranked(spec) if plain else None
        self.by_words = plain and self._plain_b(size_b)

    @staticmethod
    def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(x) for x in tokens], np.int64)
        return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(size) - size, size

    @staticmethod
    def _level(token: str) -> bytes:
        return bytes(_BYTE_OF[c] for c in token) if all(c in _BYTE_OF for c in token) else token.encode()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @staticmethod
    def _plain_a(spec: dict) -> bool:
        """No normalizer, and byte-level words that begin at a space."""
        pre = spec.get("pre_tokenizer") or {}
        return not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)

    def _plain_b(self, size: int) -> bool:
        """A space added in front, no text changed, and no piece with a space after another character."""
        pieces = [self.b.id_to_piece(i) for i in range(size)]
        probe = "a  b½ Ａé 　x "
        return not any("▁" in p.lstrip("▁") for p in pieces) and self.b.decode(self.b.encode(probe)) == probe

    def segments(self, text: str) -> list[str]:
        """Pieces of ``text`` that join to it by one space, each coded by itself; only long texts have several.

        A cut needs a single space with no white space of any kind beside it: there a word of A begins, and no
        piece of B goes across.
        """
        out, at = [], 0
        while self.by_words and len(text) - at > SEGMENT:
            cut = CUT.search(text, at + SEGMENT)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat A ids and B ids of all texts, and how many of each a text has."""
        parts = [self.segments(t) if t else [] for t in texts]
        n = np.array([len(p) for p in parts], np.int64)
        flat = [x for p in parts for x in p]
        out = []
        for ids in ([self._code_a(" " + x) for x in flat], self.b.encode(flat, num_threads=1) if flat else []):
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            ends = np.cumsum(n)
            joined = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)])
            out += [joined.astype(np.int64), sizes[ends] - sizes[ends - n]]
        return out[0], out[2], out[1], out[3]

    def _code_a(self, text: str) -> list[int]:
        if self.fast_a is not None:
            return self.fast_a.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def _ranked(self, spec: dict):
        """A faster coder with the same merges, where ids rank them and words are split the usual way; else None.

        In a vocabulary made by merging, two tokens that lie side by side and spell a third are its own merge.
        """
        import public_tokenizers
        import tiktoken

        vocab, merges = spec["model"]["vocab"], spec["model"].get("merges", [])
        first = len(vocab) - len(merges) - len([t for t in spec.get("added_tokens", []) if t["content"] in vocab])
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if first != 256 or any(vocab.get(x + y) != first + k for k, (x, y) in enumerate(pairs)):
            return None
        ranks = {self.bytes_a[i]: i for i in range(first + len(merges))}
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def spell(self, ids: np.ndarray, table: tuple) -> np.ndarray:
        """The bytes of these tokens one after another."""
        data, first, size = table
        sizes = size[ids]
        return data[np.repeat(first[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]

    def align(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray]:
        """Per text (n_a, n_b, n_links, digest of its groups); the pairs (B id, A id) of all links, and their texts."""
        a, b, n_a, n_b = self.encode(texts)
        raw = [(" " + t).encode() if t else b"" for t in texts]
        bytes_a, bytes_b = self.table_a[2][a], self.table_b[2][b]
        own = np.repeat(np.arange(len(texts)), n_a)
        size = np.array([len(x) for x in raw], np.int64)
        good = size > 0
        for ids, counts, sizes, table in ((a, n_a, bytes_a, self.table_a), (b, n_b, bytes_b, self.table_b)):
            sums = np.concatenate([[0], np.cumsum(sizes)])
            ends = np.cumsum(counts)
            spelled, first = self.spell(ids, table).tobytes(), sums[ends - counts].tolist()
            good &= np.array([spelled[p : p + len(x)] == x for p, x in zip(first, raw, strict=True)], bool) & (sums[ends] - sums[ends - counts] == size)
        if not good.all():  # texts that do not come back have no tokens
            a, b = a[good[own]], b[np.repeat(good, n_b)]
            n_a, n_b, own = n_a * good, n_b * good, own[good[own]]
        ends_a, ends_b = np.cumsum(self.table_a[2][a]), np.cumsum(self.table_b[2][b])
        at_a = np.flatnonzero(np.isin(ends_a, ends_b, assume_unique=True, kind="table"))
        at_b = np.searchsorted(ends_b, ends_a[at_a])
        # tokens in the order of the digest: A ids, then B ids of each group, each with what follows it
        sizes_a, sizes_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        n_links = np.bincount(own[at_a], minlength=len(texts))
        order = np.empty(len(a) + len(b), np.int64)
        name = 2 * a
        name[at_a] += 1
        order[np.arange(len(a)) + np.repeat(np.cumsum(sizes_b) - sizes_b, sizes_a)] = name
        name = 2 * b
        name[at_b] += 1
        order[np.arange(len(b)) + np.repeat(np.cumsum(sizes_a), sizes_b)] = name + 2 * len(self.bytes_a)
        names = self.names
        words, at, out = order.tolist(), 0, []
        for k, (x, y, links) in enumerate(zip(n_a.tolist(), n_b.tolist(), n_links.tolist(), strict=True)):
            digest = ""
            if links:
                text = "".join([names[w] for w in words[at : at + x + y]])
                digest = hashlib.sha256(text[:-1].encode()).hexdigest()
                at += x + y
            out.append((x, y, links, digest))
        return out, b[at_b] << A_BITS | a[at_a], own[at_a]


@cache
def _pair(path_a: str, path_b: str) -> TokenPair:
    """One per Python worker, kept from task to task."""
    return TokenPair(path_a, path_b)


def _zip(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def _unzip(blob: bytes, *kinds: type) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    at, out = 8 * (len(kinds) + 1), []
    for kind, size in zip(kinds, np.frombuffer(raw, np.int64, len(kinds), 8).tolist(), strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def frames(pairs: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A count run: sorted pairs, as steps from the one before, and their counts."""
    out = []
    for k in range(0, len(pairs), FRAME):
        out.append(_zip(np.diff(pairs[k : k + FRAME], prepend=0), counts[k : k + FRAME]))
    return out


def unframed(run: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for blob in run:
        steps, counts = _unzip(blob, np.int64, np.int64)
        yield np.cumsum(steps), counts


class Chunk:
    """Records of the documents met since the last spill."""

    def __init__(self, name: int):
        self.name, self.docs, self.bytes = name, 0, 0
        self.pairs: list[np.ndarray] = []  # of every link
        self.held: list[np.ndarray] = []

    def add(self, pairs: np.ndarray, texts: np.ndarray) -> None:
        """Take the links of the next documents."""
        self.pairs.append(pairs)
        self.held.append((self.docs + texts).astype(np.uint16))

    def runs(self) -> list[tuple[int, list[bytes], bytes]]:
        """(bucket, count run, document run) for every bucket with records."""
        if not self.pairs:
            return []
        key = np.concatenate(self.pairs) * CHUNK_DOCS + np.concatenate(self.held)
        key.sort()
        if not len(key):
            return []
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, times = key[first], np.diff(first, append=len(key))
        pair, doc = key // CHUNK_DOCS, (key % CHUNK_DOCS).astype(np.uint16)
        starts = np.diff(pair, prepend=-1) != 0
        names, place = pair[starts], np.cumsum(starts) - 1
        totals = np.bincount(place, times, len(names)).astype(np.int64)  # far below 2**53 in a chunk
        sizes = np.bincount(place, minlength=len(names))
        bucket = (names >> A_BITS) % BUCKETS
        out = []
        for k in np.unique(bucket).tolist():
            own = bucket == k
            rows = own[place]
            first = np.cumsum(sizes[own]) - sizes[own]
            steps = np.diff(doc[rows], prepend=np.uint16(0))
            steps[first] = doc[rows][first]
            out.append((k, frames(names[own], totals[own]), _zip(sizes[own].astype(np.uint16), steps, times[rows].astype(np.uint32))))
        return out


_ALIGNED = (
    "chunk bigint, local int, _id bigint, n_a bigint, n_b bigint, n_links bigint, groups_sha256 string, "
    "bucket int, counts array<binary>, docs binary"
)


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Two kinds of rows from one pass: a document's own columns, or (``bucket`` set) the run of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = _pair(path_a, path_b), TaskContext.get().partitionId() << 32
        chunk = Chunk(first)

        def rows(local: list, ids: list, own: list[tuple], spilled: list[tuple]) -> pa.RecordBatch:
            n, m = len(ids), len(spilled)
            columns = list(zip(*own, strict=True)) if own else [()] * 4
            none = [None] * n
            arrays = [
                pa.array([chunk.name] * (n + m), pa.int64()),
                pa.array([*local, *[None] * m], pa.int32()),
                pa.array([*ids, *[None] * m], pa.int64()),
                *(pa.array([*c, *[None] * m], pa.int64()) for c in columns[:3]),
                pa.array([*columns[3], *[None] * m], pa.string()),
                pa.array([*none, *(s[0] for s in spilled)], pa.int32()),
                pa.array([*none, *(s[1] for s in spilled)], pa.list_(pa.binary())),
                pa.array([*none, *(s[2] for s in spilled)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["chunk", "local", "_id", "n_a", "n_b", "n_links", "groups_sha256", "bucket", "counts", "docs"])

        for piece in slices(batches):
            sizes = np.diff(offsets_of(piece.column(piece.schema.get_field_index("text"))))
            at = 0
            while at < piece.num_rows:
                take = min(piece.num_rows - at, CHUNK_DOCS - chunk.docs)
                ids, texts = piece.column(0).slice(at, take).to_pylist(), piece.column(1).slice(at, take).to_pylist()
                own, pairs, held = pair.align(texts)
                chunk.add(pairs, held)
                yield rows(list(range(chunk.docs, chunk.docs + take)), ids, own, [])
                chunk.docs += take
                chunk.bytes += int(sizes[at : at + take].sum())
                at += take
                if chunk.docs >= CHUNK_DOCS or chunk.bytes >= CHUNK_BYTES:
                    yield rows([], [], [], chunk.runs())
                    first += 1
                    chunk = Chunk(first)
        if chunk.docs:
            yield rows([], [], [], chunk.runs())

    source = docs.select(id_key().alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, _ALIGNED)


def merged(runs: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """(pair, count) in order, from sorted count runs; one frame of each run is open at a time."""

    def entries(run: list[bytes]) -> Iterator[tuple[int, int]]:
        for pairs, counts in unframed(run):
            yield from zip(pairs.tolist(), counts.tolist(), strict=True)

    last, total = -1, 0
    for pair, count in heapq.merge(*map(entries, runs)):
        if pair != last:
            if total:
                yield last, total
            last, total = pair, 0
        total += count
    if total:
        yield last, total


def _merge_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, part, counts) in order; one merged run for each (bucket, part)."""
    held: list[list[bytes]] = []
    key: tuple | None = None

    def close() -> pa.RecordBatch:
        flat = np.fromiter((x for entry in merged(held) for x in entry), np.int64).reshape(-1, 2)
        arrays = [pa.array([key[0]], pa.int32()), pa.array([frames(flat[:, 0], flat[:, 1])], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "counts"])

    for batch in batches:
        for bucket, part, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "counts")), strict=True):
            if key != (bucket, part):
                if held:
                    yield close()
                held, key = [], (bucket, part)
            held.append(counts)
    if held:
        yield close()


def pair_counts(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(bucket, counts): one run per bucket with the corpus-wide count of each pair. ``runs`` has those columns."""
    spark = runs.sparkSession
    while True:
        most = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return runs
        parts = -(-most // fan_in)
        dealt = runs.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
        ordered = dealt.repartition(max(1, min(partitions(spark), BUCKETS * parts)), "bucket", "part").sortWithinPartitions("bucket", "part")
        runs = stored(ordered.mapInArrow(_merge_groups, "bucket int, counts array<binary>"), "pair_runs")


def _highest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether each pair of a whole bucket has the highest count of its B id; pairs are in B-major order."""
    starts = np.flatnonzero(np.diff(pairs >> A_BITS, prepend=-1))
    return counts == np.repeat(np.maximum.reduceat(counts, starts), np.diff([*starts, len(pairs)]))


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, bucket, chunk, counts, docs) in order, the final run of a bucket (no chunk) first."""
    part, gains, final = None, {}, None

    def close() -> Iterator[pa.RecordBatch]:
        for chunk, (best, total) in gains.items():
            rows = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), chunk)), pa.array(rows, pa.int32()), pa.array(best[rows]), pa.array(total[rows])],
                ["chunk", "local", "n_best", "count_sum"],
            )

    for batch in batches:
        for row in range(batch.num_rows):
            now, chunk, counts, docs = (batch.column(c)[row].as_py() for c in ("part", "chunk", "counts", "docs"))
            if now != part:
                yield from close()
                part, gains = now, {}
            if chunk is None:
                pairs, totals = (np.concatenate(x) for x in zip(*unframed(counts), strict=True))
                final = (pairs, totals, _highest(pairs, totals))
                continue
            if chunk not in gains:
                gains[chunk] = (np.zeros(CHUNK_DOCS, np.int64), np.zeros(CHUNK_DOCS, np.int64))
            own = np.concatenate([p for p, _ in unframed(counts)])
            sizes, steps, times = _unzip(docs, np.uint16, np.uint16, np.uint32)
            at = np.repeat(np.searchsorted(final[0], own), sizes)
            # steps restart at each pair: running sum less the sum before the pair
            run = np.cumsum(steps, dtype=np.int64)
            first = np.cumsum(sizes, dtype=np.int64) - sizes
            doc = run - np.repeat(run[first] - steps[first], sizes)
            best, total = gains[chunk]
            np.add.at(best, doc, final[2][at] * times.astype(np.int64))
            np.add.at(total, doc, final[1][at] * times)
    yield from close()


def alignment_report(docs: DataFrame, path_a: str, path_b: str, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row per input row."""
    spark = docs.sparkSession
    both = stored(aligned(docs.select("doc_id", "text"), path_a, path_b), "aligned")
    runs = both.where("bucket is not null").select("chunk", "bucket", "counts", "docs")
    chunks = runs.select("chunk").distinct().count()
    final = pair_counts(runs.select("bucket", "counts"), fan_in)
    parts = max(1, min(chunks, max(partitions(spark), -(-chunks // fan_in))))
    here = F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = runs.withColumn("part", here).unionByName(final.withColumn("part", every), allowMissingColumns=True)
    ordered = dealt.repartition(min(parts, partitions(spark)), "part").sortWithinPartitions("part", "bucket", F.col("chunk").asc_nulls_first())
    gained = ordered.select("part", "chunk", "counts", "docs").mapInArrow(_gains, "chunk bigint, local int, n_best bigint, count_sum bigint")
    own = both.where("local is not null").select("chunk", "local", "_id", "n_a", "n_b", "n_links", "groups_sha256")
    return own.join(gained, ["chunk", "local"], "left").select(
        id_of("_id").alias("doc_id"),
        "n_a",
        "n_b",
        F.col("n_links").alias("n_groups"),
        "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
