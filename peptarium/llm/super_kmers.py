"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Its minimiser is the least hash of the ``MINIMISER``-word runs
inside it; neighbouring windows mostly share it, so a stretch of windows with one minimiser travels as
one packed string (its words joined by a space) to the bucket of that minimiser, where equal windows must
meet. There the windows are sorted by hash, equal neighbours are compared word for word, and every window
but the first in (doc_id, start) order is reported, as runs of starts.

Map tasks collect their strings in an outbox and fold equal ones, so that a passage in a third of all
documents sends one string per outbox; later copies are reported at once. A minimiser that heads
more than ``HOT_SHARE`` of the windows of some batch is hot: its windows leave their string and are dealt by
their own hash instead, so that one bucket never holds all contexts of a common phrase. Which minimisers are
hot changes only where windows meet, not the result.

Defined cases: null, empty and short texts have no windows and keep all words; a null id sorts first; rows
that repeat an id are one document, so equal windows at equal places in them are both first; texts are
whole and windows are judged on the input.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import SPACE, Words, id_key, partitions, run_hashes, slices

WINDOW = 20
MINIMISER = 3
HOT_SHARE = 1 / 500
HOT_LIST = 20_000
MAP_BYTES = 2 << 20
OUTBOX_BYTES = 24 << 20
BUCKETS_PER_PARTITION = 4
_HOT_SALT = np.uint64(0x5851F42D4C957F2D)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours."""
    done, y = 1, x
    while done < width:
        step = min(done, width - done)
        y = np.minimum(y[:-step], y[step:])
        done += step
    return y


class Stretches:
    """Super-k-mers of a piece of texts: ``start`` (word index), ``windows`` and ``key`` (minimiser)."""

    def __init__(self, words: Words):
        h = words.hashes()
        self.words, self.h = words, h
        n = len(h) - WINDOW + 1
        if n <= 0:
            self.start = self.windows = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            self.text = np.zeros(0, np.int64)
            return
        least = sliding_min(run_hashes(h, MINIMISER), WINDOW - MINIMISER + 1)
        text = words.text_of()
        inside = text[:n] == text[WINDOW - 1 :]
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1])
        new &= inside
        self.start = np.flatnonzero(new)
        stop = np.flatnonzero(inside & np.concatenate([new[1:] | ~inside[1:], [True]]))
        self.windows = stop - self.start + 1
        self.key = least[self.start]
        self.text = text[self.start]


def packed_words(words: Words) -> tuple[bytes, np.ndarray]:
    """All words joined by one space, and the place of each word in it."""
    sizes = words.ends - words.starts
    places = np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes + 1, out=places[1:])
    out = np.full(int(places[-1]), 0x20, np.uint8)
    letters = np.ones(int(places[-1]), bool)
    letters[places[1:] - 1] = False
    out[letters] = words.data[~SPACE[words.data]]
    return out.tobytes(), places


def hot_minimisers(docs: DataFrame, share: float = HOT_SHARE) -> np.ndarray:
    """Minimisers above ``share`` of the windows of some map batch; at most ``HOT_LIST``, the heaviest.

    Any minimiser with that share of all windows has it in some batch. The list only spreads work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=MAP_BYTES):
            s = Stretches(Words(piece.column(0)))
            keys, at = np.unique(s.key, return_inverse=True)
            weight = np.bincount(at, s.windows, len(keys)).astype(np.int64)
            big = weight > max(64, share * weight.sum())
            yield pa.RecordBatch.from_arrays([pa.array(keys[big].view(np.int64), pa.int64()), pa.array(weight[big], pa.int64())], ["key", "n"])

    counted = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "key").limit(HOT_LIST).collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


# a travelling record: bucket, and a compressed block of (id, row, start, words in the string, string)
_HEAD = np.dtype([("id", "<i8"), ("row", "<i8"), ("start", "<i4"), ("windows", "<i4"), ("bytes", "<i4")])


class Outbox:
    """Strings on their way, by bucket, folding equal ones; flushed at ``OUTBOX_BYTES``."""

    def __init__(self, hot: np.ndarray, buckets: int):
        self.hot, self.buckets = hot, buckets
        self._empty()

    def _empty(self) -> None:
        self.blocks: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        self.known: dict[bytes, tuple[int, int]] = {}
        self.bytes = 0

    def add(self, words: Words, ids: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Takes a piece in; returns (_id, _row, start, n) of windows already known to repeat."""
        s = Stretches(words)
        text, places = packed_words(words)
        start, windows, key, owner = s.start, s.windows, s.key, s.text
        hot = self.hot
        if len(hot) and len(start):
            is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
            if is_hot.any():  # hot ones travel window by window, by the hash of the whole window
                first, many = start[is_hot], windows[is_hot]
                each = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
                start = np.concatenate([start[~is_hot], each])
                windows = np.concatenate([windows[~is_hot], np.ones(len(each), np.int64)])
                owner = np.concatenate([owner[~is_hot], np.repeat(owner[is_hot], many)])
                key = np.concatenate([key[~is_hot], run_hashes(s.h, WINDOW)[each] ^ _HOT_SALT])
        bucket = (key % np.uint64(self.buckets)).astype(np.int64)
        begin, end = places[start], places[start + windows + WINDOW - 1] - 1
        local = start - words.first[owner]
        late = []
        for b, x, y, i, row, at, n in zip(
            *(v.tolist() for v in (bucket, begin, end, ids[owner], rows[owner], local, windows)), strict=True
        ):
            string = text[x:y]
            first = self.known.setdefault(string, (i, at))
            if first < (i, at):
                if late and late[-1][:2] == (i, row) and late[-1][2] + late[-1][3] == at:
                    late[-1] = (i, row, late[-1][2], late[-1][3] + n)  # the next stretch of one long repeat
                else:
                    late.append((i, row, at, n))
                continue
            self.known[string] = (i, at)  # an earlier one sent later: the bucket sees both
            heads, strings = self.blocks[b]
            heads.append((i, row, at, n, y - x))
            strings.append(string)
            self.bytes += y - x
        return late

    def flush(self, least: int = 0) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, strings in it, compressed block), if there are ``least`` bytes."""
        if self.bytes < least:
            return
        for b, (heads, strings) in self.blocks.items():
            yield b, len(heads), zstandard.compress(np.array(heads, _HEAD).tobytes() + b"".join(strings), 3)
        self._empty()


def travel(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """bucket, n, block; or, for windows already known to repeat, any bucket with _id, _row, start, n."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox(shared.value, buckets)

        def rows_of(sent: list[tuple]) -> pa.RecordBatch:
            names = ["bucket", "n", "block", "_id", "_row", "start"]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*sent, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for piece in slices(batches):
            late = box.add(Words(piece.column("text")), piece.column("_id").to_numpy(), piece.column("_row").to_numpy())
            yield rows_of([(i % buckets, n, None, i, row, at) for i, row, at, n in late])
            yield rows_of([(*block, None, None, None) for block in box.flush(OUTBOX_BYTES)])
        yield rows_of([(*block, None, None, None) for block in box.flush()])

    return keyed(docs).mapInArrow(run, "bucket bigint, n bigint, block binary, _id bigint, _row bigint, start bigint")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(id_key().alias("_id"), F.xxhash64("text").alias("_row"), F.coalesce("text", F.lit("")).alias("text"))


def _later_windows(blocks: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(_id, _row, start, n) of windows of one bucket that are not the first of their kind."""
    ids, rows, starts, hashes, sources, firsts, datas, places_of = [], [], [], [], [], [], [], []
    for block in blocks:
        raw = zstandard.decompress(block[8:])
        count = int.from_bytes(block[:8], "little")
        heads = np.frombuffer(raw, _HEAD, count)
        text = raw[count * _HEAD.itemsize :]
        ends = np.cumsum(heads["bytes"], dtype=np.int64)
        offsets = np.concatenate([[0], ends])
        column = pa.LargeStringArray.from_buffers(count, pa.py_buffer(offsets), pa.py_buffer(text))
        words = Words(column)
        h = run_hashes(words.hashes(), WINDOW)
        many = heads["windows"].astype(np.int64)
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(words.first[:-1], many) + step
        hashes.append(h[at])
        ids.append(np.repeat(heads["id"], many))
        rows.append(np.repeat(heads["row"], many))
        starts.append(np.repeat(heads["start"], many) + step)
        sources.append(np.full(len(at), len(datas)))
        firsts.append(at)
        datas.append(text)
        places_of.append((words.starts, words.ends))
    if not hashes:
        return []
    hashes, ids, rows, starts, sources, firsts = map(np.concatenate, (hashes, ids, rows, starts, sources, firsts))
    order = np.lexsort((starts, ids, hashes))
    h = hashes[order]
    same = np.concatenate([[False], h[1:] == h[:-1]])
    if not same.any():
        return []
    group = np.cumsum(~same)
    shared = same | np.concatenate([same[1:], [False]])

    def words_of(i: int) -> bytes:
        s, e = places_of[sources[i]]
        return datas[sources[i]][s[firsts[i]] : e[firsts[i] + WINDOW - 1]]

    late, seen, now = [], {}, -1
    for at in np.flatnonzero(shared).tolist():
        i = int(order[at])
        if group[at] != now:
            now, seen = group[at], {}
        place = (int(ids[i]), int(starts[i]))
        if seen.setdefault(words_of(i), place) != place:
            late.append((place[0], int(rows[i]), place[1]))
    late.sort()
    out: list[list[int]] = []
    for i, row, start in late:
        if out and out[-1][0] == i and out[-1][1] == row and out[-1][2] + out[-1][3] == start:
            out[-1][3] += 1
        else:
            out.append([i, row, start, 1])
    return [tuple(x) for x in out]


def later_windows(sent: DataFrame, parts: int) -> DataFrame:
    """_id, _row, start, n: runs of windows that also start earlier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, known = None, [], []

        def done(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_id", "_row", "start", "n"])

        for batch in batches:
            for bucket, n, block, i, row, start in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "block", "_id", "_row", "start")), strict=True):
                if block is None:
                    known.append((i, row, start, n))
                    continue
                if bucket != now and blocks:
                    yield done(_later_windows(blocks))
                    blocks = []
                now = bucket
                blocks.append(n.to_bytes(8, "little") + block)
            yield done(known)
            known = []
        if blocks:
            yield done(_later_windows(blocks))

    dealt = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "_id bigint, _row bigint, start bigint, n bigint")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), one row per input row."""
    spark = docs.sparkSession
    parts = partitions(spark)
    sent = travel(docs, hot_minimisers(docs), parts * BUCKETS_PER_PARTITION)
    covers = later_windows(sent, parts).groupBy("_id", "_row").agg(F.collect_set(F.struct("start", "n")).alias("covers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            words = Words(piece.column("text"))
            counts, removed, kept = [], [], []
            for i, cover in enumerate(piece.column("covers").to_pylist()):
                first, last = words.first[i], words.first[i + 1]
                text = words.data[words.bounds[i] : words.bounds[i + 1]].tobytes().split()
                assert len(text) == last - first
                if cover:
                    edge = np.zeros(len(text) + 1, np.int64)
                    np.add.at(edge, [c["start"] for c in cover], 1)
                    np.add.at(edge, [c["start"] + c["n"] + WINDOW - 1 for c in cover], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    text = [w for w, stay in zip(text, stays.tolist(), strict=True) if stay]
                counts.append(last - first)
                removed.append(last - first - len(text))
                kept.append(b" ".join(text).decode())
            yield pa.RecordBatch.from_arrays(
                [piece.column("_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                ["_id", "n_words", "n_removed", "kept"],
            )

    whole = keyed(docs).join(covers, ["_id", "_row"], "left").select("_id", "text", "covers")
    out = whole.mapInArrow(run, "_id bigint, n_words bigint, n_removed bigint, kept string")
    return out.select(F.when(F.col("_id") != -(2**63), F.col("_id")).alias("doc_id"), "n_words", "n_removed", "kept")
