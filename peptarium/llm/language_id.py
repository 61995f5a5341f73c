"""Language identification, words first, then ever shorter character n-grams.

The model holds, per language, log frequencies of known words and of character n-grams of length 5 to
1 (with word edges marked). A known word scores by its own log frequency; an unseen word by the longest
n-gram length of which at least one n-gram is known; a word with nothing known scores nothing.

Training uses at most ``sample_per_lang`` labelled rows per language, picked by the hash of the id. A
language keeps every entry of a length whose share of that length's occurrences in its sample is at least
``least_share``; 0 keeps all there are. Both are parameters. A share also bounds the model that is
broadcast: at most languages x lengths / share entries. Everything else covers all rows.

Defined cases: ``und`` with score 0 for null, empty and letterless texts, and for all texts if nothing
could be learned; ties go to the smallest language name; rows with a null id are never trained on and
count as held out; repeated rows get the same answer.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.llm.common import slices, stored

LONGEST = 5
SAMPLE_PER_LANG = 5_000
LEAST_SHARE = 5e-6
CACHE = 400_000
RUN = re.compile(r"[^\W\d_]+")


def words_in(text: str) -> list[str]:
    """Runs of letters, in lower case. Numbers that count as word characters, such as ½ or Ⅷ, are no letters."""
    runs = RUN.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in "".join([c if c.isalpha() else " " for c in run]).split()]


def grams(word: str, n: int) -> list[str]:
    marked = f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """``tables[0]`` is for words, ``tables[n]`` for n-grams: entry to row of ``rows[n]``, log frequencies per language."""

    langs: list[str]
    tables: list[dict[str, int]]
    rows: list[np.ndarray]

    def score_words(self, words: list[str]) -> np.ndarray:
        """One row per word: its own log frequencies, else the mean over its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)))
        own = self.tables[0]
        found: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in range(LONGEST + 1)]  # word, first gram, gram rows
        for k, word in enumerate(words):
            row = own.get(word)
            if row is not None:
                found[0][0].append(k)
                found[0][2].append(row)
                continue
            marked = f"_{word}_"
            for n in range(min(LONGEST, len(marked)), 0, -1):
                table = self.tables[n]
                hits = [r for i in range(len(marked) - n + 1) if (r := table.get(marked[i : i + n])) is not None]
                if hits:
                    at, first, flat = found[n]
                    at.append(k)
                    first.append(len(flat))
                    flat += hits
                    break
        if found[0][0]:
            out[found[0][0]] = self.rows[0][found[0][2]]
        for n, (at, first, flat) in enumerate(found):
            if n and at:
                sizes = np.diff([*first, len(flat)])
                out[at] = np.add.reduceat(self.rows[n][flat].astype(np.float64), first) / sizes[:, None]
        return out


class Scorer:
    """Scores of words met before, kept from piece to piece and task to task in a Python worker."""

    def __init__(self, model: Model, size: int = CACHE):
        self.model, self.size = model, size
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(model.langs)))

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """Summed scores of each text's words; no text may be empty."""
        if len(self.place) > self.size:
            self.place, self.known = {}, self.known[:0]
        fresh = list({w for words in texts for w in words if w not in self.place})
        self.place.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        self.known = np.concatenate([self.known, self.model.score_words(fresh)])
        flat = np.fromiter(map(self.place.__getitem__, (w for words in texts for w in words)), np.int64)
        return np.add.reduceat(self.known[flat], np.cumsum([0, *map(len, texts)])[:-1])


_scorers: dict[int, Scorer] = {}


def sample(docs: DataFrame, per_lang: int) -> DataFrame:
    """Labelled rows outside the held-out fold; the ids are picked on narrow rows, then texts are fetched."""
    fold = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    ids = fold.select("doc_id", "lang", F.xxhash64(F.lit("train"), "doc_id").alias("_h")).distinct()
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    picked = ids.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_lang).select("doc_id", "lang")
    return fold.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"], "left_semi")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, least_share: float = LEAST_SHARE) -> Model:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=1 << 24):
            words: Counter = Counter()
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist(), strict=True):
                words.update((lang, w) for w in words_in(text))
            got: Counter = Counter()
            for (lang, w), k in words.items():
                got[lang, 0, w] += k
                for n in range(1, LONGEST + 1):
                    for g in grams(w, n):
                        got[lang, n, g] += k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in got], pa.string()),
                    pa.array([k[1] for k in got], pa.int32()),
                    pa.array([k[2] for k in got], pa.string()),
                    pa.array(list(got.values()), pa.int64()),
                ],
                ["lang", "n", "entry", "k"],
            )

    source = sample(docs, per_lang).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    counts = source.mapInArrow(count, "lang string, n int, entry string, k bigint").groupBy("lang", "n", "entry").agg(F.sum("k").alias("k"))
    counts = stored(counts, "entries")
    totals = counts.groupBy("lang", "n").agg(F.sum("k").alias("_all"))  # six rows a language
    rows = counts.join(F.broadcast(totals), ["lang", "n"]).where(F.col("k") >= least_share * F.col("_all")).select("lang", "n", "entry", "k").toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    place = {lang: i for i, lang in enumerate(langs)}
    counted: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    totals = np.zeros((LONGEST + 1, len(langs)))
    for lang, n, entry, k in zip(*(rows.column(c).to_pylist() for c in ("lang", "n", "entry", "k")), strict=True):
        counted[n].setdefault(entry, np.zeros(len(langs), np.float32))[place[lang]] = k
        totals[n, place[lang]] += k
    logs = [
        np.log((np.array(list(entries.values()), float).reshape(len(entries), len(langs)) + 0.5) / (totals[n] + 0.5 * len(entries))).astype(np.float32)
        for n, entries in enumerate(counted)
    ]
    return Model(langs, [{entry: k for k, entry in enumerate(entries)} for entries in counted], logs)


def detect(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _scorers:
            _scorers.clear()
            _scorers[id(model)] = Scorer(model)
        scorer = _scorers[id(model)]
        for piece in slices(batches):
            words = [words_in(t) for t in piece.column("text").to_pylist()]
            names, scores = ["und"] * len(words), np.zeros(len(words))
            full = [i for i, w in enumerate(words) if w and model.langs]
            if full:
                total = scorer.totals([words[i] for i in full])
                best = total.argmax(axis=1)
                top = total[np.arange(len(full)), best]
                scores[full] = 1 / np.exp(np.maximum(total - top[:, None], -700)).sum(axis=1)
                for i, k in zip(full, best.tolist(), strict=True):
                    names[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
