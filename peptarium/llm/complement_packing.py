"""Packing of token pieces by exact complements.

Lengths are whole numbers up to the capacity, so the plan is made on the histogram of lengths, at most
``capacity`` counts whatever the corpus size. For the longest length that is left, the gap it leaves is
looked up among single lengths, then pair sums, then triple sums; a combination that fills the gap
exactly is consumed as often as the availability counts allow. Lengths with no exact complement go
best-fit into what room remains. The plan says, for a run of ranks of one length, which sequences and
which offset they get; pieces are numbered within their length in parallel and look their place up.

Defined cases: a null text is an empty document, which still has its end token; repeated rows are packed
each on its own; texts are cut only beyond the capacity; an empty table packs into nothing.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peptarium.llm.common import Words, id_key, id_of, slices, stored

CAPACITY = 2048
END_ID = 0
CACHE = 600_000
SALTS = 1024
PIECE_BYTES = 1 << 22

# The parts of a tokenizer file under which words are coded by themselves.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class TokenBytes:
    """Little-endian 32-bit ids of texts, remembering the ids of words.

    The tokenizers this is made for drop white space before anything else, lower-case, and split letters from
    all else (their file is checked). So ids of a text are the ids of its space-separated words one after
    another. Words are remembered for two generations of ``cache`` each: what is met again moves to the new
    one, and the old one is dropped when the new one is full. For any other file texts are encoded whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.by_words = (spec.get("normalizer"), spec.get("pre_tokenizer")) == (NORMALIZER, PRE_TOKENIZER) and not spec.get("post_processor")
        self.plain = self._plain_coder(spec["model"]) if self.by_words else None
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.cache = cache
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True

    def encode(self, texts: pa.LargeStringArray) -> list[bytes]:
        if not self.by_words:
            return self._each(texts.to_pylist())
        found = Words(texts)  # cut at ASCII white space only
        at, distinct = found.ids()
        known = self._ids_of(distinct.to_pylist())
        size = np.array([len(x) // 4 for x in known], np.int64)
        flat = np.frombuffer(b"".join(known), "<u4")
        first = (np.cumsum(size) - size)[at] if len(at) else at
        sizes = size[at] if len(at) else at
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(first - ends + sizes, sizes) + np.arange(len(ends) and ends[-1])]
        cuts = np.concatenate([[0], ends])[found.first]
        return [ids[p:q].tobytes() for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        found = list(map(self.new.get, words))
        missing = [w for w, ids in zip(words, found, strict=True) if ids is None]
        if not missing:
            return found
        known = {w: ids for w in missing if (ids := self.old.get(w)) is not None}
        known.update(self._words({w for w in missing if w not in known}))
        if len(self.new) >= self.cache:
            self.old, self.new = self.new, {}
        self.new.update(known)
        return [known[w] if ids is None else ids for w, ids in zip(words, found, strict=True)]

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. Letters and the punctuation after them are coded apart, as the tokenizer splits there.

        Runs of letters are coded many at once and cut after each word-end token; that is several times cheaper
        than a call for each.
        """
        parts: dict[bytes, tuple[bytes, bytes]] = {}
        rest: list[bytes] = []
        for w in words:
            if found := ASCII_WORD(w):
                parts[w] = (found[1].lower(), found[2])
            else:
                core = w.rstrip(b".,;:!?")
                if letters_only(core.decode()):
                    parts[w] = (core, w[len(core) :])
                else:
                    rest.append(w)
        out = dict(zip(rest, self._each([w.decode() for w in rest]), strict=True))
        core_ids = {c: self._known(c) for c, _ in parts.values()}  # often known without the punctuation
        cores, tails = [c for c, ids in core_ids.items() if ids is None], list({t for _, t in parts.values()} - {b""})
        tail_ids = dict(zip([b"", *tails], [b"", *self._each([t.decode() for t in tails])], strict=True))
        plain = [c for c in cores if self.plain is not None and c.isascii()]
        for some, code in ((plain, self._code_plain), ([c for c in cores if self.plain is None or not c.isascii()], self._code)):
            for k in range(0, len(some), 1000):
                core_ids.update(zip(some[k : k + 1000], self._many(some[k : k + 1000], code), strict=True))
        out.update((w, core_ids[c] + tail_ids[t]) for w, (c, t) in parts.items())
        return out

    def _many(self, cores: list[bytes], code) -> list[bytes]:
        ids = np.array(code(cores), "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(cores) or cuts[-1] != len(ids):  # a letter the tokenizer takes for something else
            return self._each([c.decode() for c in cores])
        raw, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def _code(self, cores: list[bytes]) -> list[int]:
        return self.tokenizer.encode(b" ".join(cores).decode(), add_special_tokens=False).ids

    def _code_plain(self, cores: list[bytes]) -> list[int]:
        return self.plain.encode_ordinary(b"|".join([*cores, b""]).decode())

    @staticmethod
    def _plain_coder(model: dict):
        """A faster coder of words of a-z with the same merges, where ids rank them; else None.

        The mark of a word's end is one letter of its own here, joined to the last one before any other merge. In
        a vocabulary made by merging, two tokens that lie side by side and spell a third are its own merge.
        """
        import tiktoken

        vocab, mark = model["vocab"], model.get("end_of_word_suffix")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if not mark or any(vocab.get(x + y) != 512 + k for k, (x, y) in enumerate(pairs)):
            return None
        names = {t: i for t, i in vocab.items() if PLAIN_TOKEN(t.removesuffix(mark))}
        ranks = {(t.removesuffix(mark) + "|" if t.endswith(mark) else t).encode(): i for t, i in names.items()}
        if any(not 0 <= ranks.get(c.encode(), -1) < 256 <= ranks.get(f"{c}|".encode(), -1) < 512 for c in string.ascii_lowercase):
            return None
        return tiktoken.Encoding("plain", pat_str=r"[a-z]+\|", mergeable_ranks=ranks | {b"|": 1 << 20}, special_tokens={})

    def _known(self, word: bytes) -> bytes | None:
        return self.new.get(word) or self.old.get(word)


ASCII_WORD = re.compile(rb"([A-Za-z]+)([.,;:!?]*)").fullmatch
PLAIN_TOKEN = re.compile("[a-z]+").fullmatch


def letters_only(core: str) -> bool:
    """Whether the tokenizer sees one run of letters, after composing and lower-casing each character."""
    return "".join([c.lower() for c in unicodedata.normalize("NFC", core)]).isalpha()


@cache
def _coder(path: str) -> TokenBytes:
    """One coder per Python worker, kept from task to task."""
    return TokenBytes(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """_id, _row, piece, start, length, ids_crc32; ids are made and dropped inside the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tokenizer_path)
        end = np.array([END_ID], "<u4").tobytes()
        for part in slices(batches, limit=PIECE_BYTES):
            out: list[tuple] = []
            for i, row, ids in zip(part.column("_id").to_pylist(), part.column("_row").to_pylist(), coder.encode(part.column("text")), strict=True):
                ids += end
                out += [
                    (i, row, k, k * capacity, len(cut) // 4, zlib.crc32(cut))
                    for k, cut in enumerate(ids[p : p + 4 * capacity] for p in range(0, len(ids), 4 * capacity))
                ]
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_id", "_row", "piece", "start", "length", "ids_crc32"])

    # _row tells repeated rows apart; it is read only within the written table, so it may be arbitrary
    source = docs.select(id_key().alias("_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "_id bigint, _row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


@dataclass
class Plan:
    """Slots: ranks [rank, next rank) of ``length`` go to sequence + (rank - slot rank), at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    used = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int]] = []
    opened = 0

    def take(lengths: list[int], times: int) -> None:
        nonlocal opened
        offset = 0
        for n in lengths:
            slots.append((n, int(used[n]), opened, offset))
            used[n] += times
            left[n] -= times
            offset += n
        opened += times

    def times_of(lengths: list[int]) -> int:
        return min(int(left[n]) // lengths.count(n) for n in set(lengths))

    def pair_for(total: int, largest: int) -> list[int] | None:
        """Two available lengths with this sum, the larger one as large as possible."""
        if total < 2:
            return None
        a = np.arange(min(largest, total - 1), (total - 1) // 2, -1)
        hit = np.flatnonzero((left[a] > 0) & (left[total - a] > 0) & ((2 * a != total) | (left[a] > 1)))
        return [int(a[hit[0]]), int(total - a[hit[0]])] if len(hit) else None

    residual: list[tuple[int, int]] = []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            gap = capacity - longest
            left[longest] -= 1  # the piece in hand is not its own complement
            found = [] if gap == 0 else [gap] if left[gap] else pair_for(gap, gap)
            if found is None:
                for third in range(min(gap - 2, longest), (gap - 1) // 3, -1):
                    if left[third]:
                        left[third] -= 1
                        rest = pair_for(gap - third, min(third, gap - third))
                        left[third] += 1
                        if rest:
                            found = [third, *rest]
                            break
            left[longest] += 1
            if found is None:
                residual.append((longest, int(left[longest])))
                left[longest] = 0
                break
            take([longest, *found], times_of([longest, *found]))

    # residuals: best fit, longest first; open sequences of equal room and history are one entry
    rooms: dict[int, list[list[int]]] = {}  # room -> [first sequence, how many]
    for length, n in residual:
        while n:
            room = min((r for r in rooms if r >= length), default=None)
            if room is None:
                per = capacity // length
                for share, times in ((per, n // per), (n % per, 1)):
                    if share and times:
                        for k in range(share):
                            slots.append((length, int(used[length]), opened, k * length))
                            used[length] += times
                        rooms.setdefault(capacity - share * length, []).append([opened, times])
                        opened += times
                break
            first, many = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            times = min(many, n)
            slots.append((length, int(used[length]), first, capacity - room))
            used[length] += times
            n -= times
            rooms.setdefault(room - length, []).append([first, times])
            if many > times:
                rooms.setdefault(room, []).append([first + times, many - times])
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], opened)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = stored(pieces(docs, tokenizer_path, capacity), "pieces")
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("_id", "_row", "piece"), F.lit(SALTS)).cast("int"))
    groups = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = cut.sparkSession.sparkContext.broadcast(plan(counts, capacity))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = made.value
        big = np.int64(1) << 48
        at = np.searchsorted(p.length * big + p.rank, length.to_numpy() * big + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": p.sequence[at] + rank.to_numpy() - p.rank[at], "offset": p.offset[at]})

    inside = Window.partitionBy("length", "_salt").orderBy("_id", "_row", "piece")
    ranked = salted.withColumn("_in", F.row_number().over(inside) - 1).join(bases, ["length", "_salt"])
    placed = ranked.withColumn("_at", place("length", (F.col("_base") + F.col("_in")).cast("long")))
    return placed.select(id_of("_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "_at.sequence_id", "_at.offset")
