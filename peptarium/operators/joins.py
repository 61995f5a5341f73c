"""Lookup, ledger, delta, relabel and sequence-matching joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.functions.keys import strip_encoding
from peptarium.functions.numeric import log10_1p, log_enrichment, num
from peptarium.functions.sequences import translate
from peptarium.operators.ordering import first_per, lookup
from peptarium.session import freeze


def lookup_first(df: DataFrame, ref: DataFrame, on: str, columns: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Left join on a lower-cased key where the first reference row of each key wins."""
    keyed = ref.withColumn("_key", F.lower(F.col(on).cast("string"))).select("_key", *columns, *[o for o in order if isinstance(o, str) and o not in columns])
    one = first_per(keyed.where(F.col("_key").isNotNull()), ["_key"], order).select("_key", *columns)
    return lookup(df.withColumn("_key", F.lower(F.col(on).cast("string"))), one, ["_key"]).drop("_key")


def join_ledger(df: DataFrame, ledger: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Composite-key ledger join that keeps unmatched rows under ``ledger_status``."""
    one = first_per(ledger, keys, order).withColumn("_hit", F.lit(True))
    joined = lookup(df, one, keys)
    return joined.withColumn("ledger_status", F.when(F.col("_hit"), "ok").otherwise("no_ledger_row")).drop("_hit")


def expand_preds(df: DataFrame, outputs: DataFrame, n: int, keys: Sequence[str] = ("token",)) -> DataFrame:
    """Every token with predictions 0..n-1; those without an output stay as ``missing_pair``."""
    wanted = df.withColumn("pred", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = outputs.withColumn("_hit", F.lit(True))
    joined = wanted.join(found, [*keys, "pred"], "left")
    return joined.withColumn("pair_status", F.when(F.col("_hit"), "ok").otherwise("missing_pair")).drop("_hit")


def merge_runs(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Outer merge of two runs of the same library; any key on one side only, or twice, is an error."""
    merged = a.join(b, key, "full_outer")
    counts = (
        a.select(key, F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(b.select(key, F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy(key)
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    bad = counts.where((F.col("a") != 1) | (F.col("b") != 1)).limit(5).collect()
    if bad:
        raise ValueError(f"runs do not hold the same {key} values once each, e.g. {[r[0] for r in bad]}")
    return merged


def join_on_sequence(
    df: DataFrame, ref: DataFrame, left_seq: str, ref_seq: str, columns: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """Left join on equal sequence; reference rows are deduplicated first. ``sequence_matched`` says which hit."""
    picked = ref.where(F.col(ref_seq).isNotNull()).withColumnRenamed(ref_seq, left_seq)
    one = first_per(picked, [left_seq], order).select(left_seq, *columns, F.lit(True).alias("_hit"))
    return lookup(df, one, [left_seq]).withColumn("sequence_matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def cognate_readout(df: DataFrame, ab_map: dict[str, tuple[str, str]], target: str = "Target") -> DataFrame:
    """Per row, the signal column its target names and that run's baseline, with log read-outs.

    ``ab_map`` maps an antibody to (signal column, baseline column); it is as small as the header.
    """
    name = F.lower(F.element_at(F.split(F.col(target), "_"), 1))

    def pick(i: int) -> Column:
        return F.coalesce(*[F.when(name == ab, num(cols[i])) for ab, cols in ab_map.items()], F.lit(None).cast("double"))

    out = df.withColumn("cognate_ab", F.when(name.isin(list(ab_map)), name))
    out = out.withColumn("cognate_ab_signal", pick(0)).withColumn("cognate_noab", pick(1))
    return (
        out.withColumn("cognate_log_ab", log10_1p("cognate_ab_signal"))
        .withColumn("cognate_log_noab", log10_1p("cognate_noab"))
        .withColumn("cognate_log_enrichment", log_enrichment("cognate_ab_signal", "cognate_noab"))
    )


def long_readout(df: DataFrame, key: str, ab_map: dict[str, tuple[str, str]]) -> DataFrame:
    """Wide assay table to (key, ab, signal, baseline)."""
    rows = F.array(
        *[F.struct(F.lit(ab).alias("ab"), num(s).alias("signal"), num(b).alias("baseline")) for ab, (s, b) in ab_map.items()]
    )
    return df.select(key, F.inline(rows))


def mark_selected(pool: DataFrame, library: DataFrame, key: str, fill: Sequence[str], fallback: dict[str, str] | None = None) -> DataFrame:
    """Flag pool rows that shipped and carry library values; ``fallback`` fills what is still null."""
    shipped = library.select(key, *[F.col(c).alias(f"_l_{c}") for c in fill], F.lit(True).alias("_hit"))
    out = lookup(pool, shipped, [key]).withColumn("selected", F.coalesce("_hit", F.lit(False)))
    for c in fill:
        sources = [F.col(f"_l_{c}")] + ([F.col(fallback[c])] if fallback and c in fallback else [])
        out = out.withColumn(c, F.coalesce(*sources))
    return out.drop("_hit", *[f"_l_{c}" for c in fill])


def new_peptides(current: DataFrame, encoded: DataFrame, seq: str = "seq") -> DataFrame:
    """Peptides whose sequence has no encoding yet; names play no part."""
    return current.join(encoded.select(seq).distinct(), seq, "left_anti")


def pending(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Inputs that do not yet have ``k`` outputs."""
    done = outputs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k)
    return inputs.join(done, list(keys), "left_anti")


def attach_by_position(a: DataFrame, b: DataFrame, row: str = "row_idx") -> DataFrame:
    """Attach two row-aligned tables by an explicit row index; unequal lengths are an error."""
    n_a, n_b = a.count(), b.count()
    if n_a != n_b:
        raise ValueError(f"row count mismatch: {n_a} vs {n_b}")
    return a.join(b, row, "inner")


def fill_from(df: DataFrame, other: DataFrame, on: Sequence[str], column: str, fallback: str) -> DataFrame:
    """Take ``column`` from ``other`` (unique on the key), or ``fallback`` where it has none."""
    value = other.select(*on, F.col(column).alias("_v"))
    return lookup(df, value, on).withColumn(column, F.coalesce("_v", F.col(fallback))).drop("_v")


def relabel_by_sequence(oligos: DataFrame, peptides: DataFrame, prefix: str, suffix: str) -> DataFrame:
    """Give each current peptide the first oligo that encodes its sequence, under its current name.

    ``oligos`` is (id, oligo, row), ``peptides`` is (name, seq). A peptide without an oligo keeps a
    null oligo; callers treat that as an error.
    """
    oligo = F.col("oligo")
    core = F.substring(oligo, len(prefix) + 1, F.length(oligo) - len(prefix) - len(suffix))
    # exploded, not filtered: a filter on the protein would work it out again
    protein = F.explode(F.array_compact(F.array(translate(core))))
    framed = oligos.where(oligo.startswith(prefix) & oligo.endswith(suffix)).withColumn("seq", protein)
    first = first_per(framed, ["seq"], ["row"])
    index = F.when(F.col("id").contains("_"), F.element_at(F.split("id", "_"), -1)).otherwise("1")
    return (
        peptides.join(first.select("seq", "oligo", index.alias("_i")), "seq", "left")
        .select("name", "seq", F.concat("name", F.lit("_"), F.coalesce("_i", F.lit("1"))).alias("id"), "oligo")
    )


def filter_by_base_rank(controls: DataFrame, ranked: DataFrame, depth: int, base: Column) -> DataFrame:
    """Keep controls whose parent design ranks within ``depth``; parents unknown to the ranking drop out."""
    ranks = ranked.select(F.col("predID").alias("_base"), "rank_in_group")
    joined = controls.withColumn("_base", base).join(ranks, "_base", "left")
    return joined.where(F.col("rank_in_group") <= depth).drop("_base", "rank_in_group")


def map_attr(df: DataFrame, attrs: DataFrame, on: str, column: str) -> DataFrame:
    return lookup(df, attrs.select(on, column), [on])


def restrict_ids(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(ids, list(on), "left_semi")


def reselected(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``b`` that ``a`` did not select."""
    return b.join(a, list(keys), "left_anti")


def containment(queries: DataFrame, chains: DataFrame, on: Sequence[str], wildcard: str | None = None) -> DataFrame:
    """Chains of the same entry that contain the query sequence, with the first offset and both trims.

    ``queries`` has ``q_seq``, ``chains`` has ``c_seq``. With ``wildcard`` that letter in a chain
    matches any residue of the query.
    """
    joined = lookup(chains, queries, on, "inner") if on else chains
    q, c = F.col("q_seq"), F.col("c_seq")
    if wildcard is None:
        start = F.instr(c, q)
        hit = joined.withColumn("start", F.when(start > 0, start - 1))
    else:
        hit = joined.withColumn("start", _first_fit(wildcard)(c, q))
    return (
        hit.where(F.col("start").isNotNull())
        .withColumn("trim_n", F.col("start"))
        .withColumn("trim_c", F.length(c) - F.length(q) - F.col("start"))
    )


def _first_fit(wildcard: str):
    """Arrow batches of (chain, query) to the first place the query fits: bit i of the state says that the last
    i + 1 letters of the chain fit the first i + 1 of the query, so one step per chain letter is enough."""

    def first(chain: str, query: str) -> int | None:
        all_fit = (1 << len(query)) - 1
        masks: dict[str, int] = {wildcard: all_fit}
        for i, letter in enumerate(query):
            if letter != wildcard:
                masks[letter] = masks.get(letter, 0) | 1 << i
        state, done = 0, 1 << max(len(query) - 1, 0)
        if not query:
            return 0
        for i, letter in enumerate(chain):
            state = (state << 1 | 1) & masks.get(letter, 0)
            if state & done:
                return i - len(query) + 1
        return None

    @F.pandas_udf("int")
    def place(chains: pd.Series, queries: pd.Series) -> pd.Series:
        found = [None if c is None or q is None else first(c, q) for c, q in zip(chains, queries, strict=True)]
        return pd.Series(found, dtype="Int32")

    return place


CHUNK = 256
BROADCAST_HASHES = 1_000_000
SHIP_CHARS = 2_000_000


def kmer_index(df: DataFrame, key: Sequence[str], seq: str, k: int, pos: str = "pos") -> DataFrame:
    """One row per k-mer position (0-based) of every whole sequence.

    Sequences are cut into overlapping chunks first: a substring costs its offset, so windows over one
    long string would cost the square of its length.
    """
    n = F.length(seq) - k + 1
    chunks = df.where(n > 0).withColumn("_at", F.explode(F.sequence(F.lit(0), n - 1, F.lit(CHUNK))))
    chunks = chunks.select(*key, "_at", F.substring(F.col(seq), F.col("_at") + 1, F.lit(CHUNK + k - 1)).alias("_chunk"))
    inside = chunks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.length("_chunk") - k)))
    return inside.select(
        *key, (F.col("_at") + F.col("_i")).alias(pos), F.substring(F.col("_chunk"), F.col("_i") + 1, F.lit(k)).alias("kmer")
    )


def windows_of(df: DataFrame, key: Sequence[str], seq: str, widths: Sequence[int]) -> DataFrame:
    """(key, gram): hashes of the windows of several widths at every place, from one pass over the texts."""
    longest = max(widths)
    chunks = df.where(F.length(seq) > 0).withColumn("_at", F.explode(F.sequence(F.lit(0), F.length(seq) - 1, F.lit(CHUNK))))
    chunks = chunks.select(*key, F.substring(F.col(seq), F.col("_at") + 1, F.lit(CHUNK + longest - 1)).alias("_chunk"))
    inside = chunks.withColumn("_i", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.length("_chunk")))))
    fits = F.filter(F.array(*[F.lit(w) for w in widths]), lambda w: F.col("_i") + w - 1 <= F.length("_chunk"))
    hashes = F.transform(fits, lambda w: F.xxhash64(F.substring(F.col("_chunk"), F.col("_i"), w), w))
    return inside.select(*key, F.explode(hashes).alias("gram"))


def contained_passages(documents: DataFrame, passages: DataFrame, words: int = 4, ship: int = SHIP_CHARS) -> DataFrame:
    """Which whole passages (``p_id, p_text``) occur inside which whole documents (``doc_id, text``), and where first.

    Passages of at most ``ship`` characters together (checked) become one automaton that every task gets, and
    all of them are found in one pass over each text. More are met by anchors: the inner words of a passage
    are whole words of any text that contains it, so both sides meet on its rarest run of up to ``words`` inner
    words; passages without inner words meet on their first characters, as many as the power of two that fits.
    Only candidates are compared. Empty passages are in no document.
    """
    chars = passages.agg(F.sum(F.length("p_text"))).first()[0] or 0
    return _scan_for(documents, passages) if chars <= ship else _meet_on_anchors(documents, passages, words)


def _scan_for(documents: DataFrame, passages: DataFrame) -> DataFrame:
    wanted = passages.where(F.length("p_text") > 0).select("p_id", "p_text").toArrow()  # at most SHIP_CHARS characters
    places: dict[str, list[int]] = {}
    for k, text in enumerate(wanted.column("p_text").to_pylist()):
        places.setdefault(text, []).append(k)
    ids = wanted.column("p_id").combine_chunks()
    shared = documents.sparkSession.sparkContext.broadcast((places, ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        places, ids = shared.value
        automaton = ahocorasick.Automaton()
        for text, held in places.items():
            automaton.add_word(text, (len(text), held))
        automaton.make_automaton()
        for batch in batches:
            rows, hits, starts = [], [], []
            for row, text in enumerate(batch.column(1).to_pylist() if places else ()):
                first: dict[int, int] = {}
                for end, (size, held) in automaton.iter(text or ""):
                    if held[0] not in first:
                        first.update(dict.fromkeys(held, end - size + 1))
                rows += [row] * len(first)
                hits += first.keys()
                starts += first.values()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(hits, pa.int64())), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32())],
                ["p_id", "doc_id", "start"],
            )

    kinds = {"p_id": passages.schema["p_id"].dataType, "doc_id": documents.schema["doc_id"].dataType}
    schema = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds.items()) + ", start int"
    return documents.select("doc_id", "text").mapInArrow(scan, schema)


def _meet_on_anchors(documents: DataFrame, passages: DataFrame, words: int) -> DataFrame:
    tokens = lambda c: F.split(F.col(c), r"\s+")

    def shingles(array: str, n: int) -> Column:
        # the word array must be a column of its own: an expression would be split again per position
        last = F.size(array) - n
        return F.when(
            last >= 0,
            F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col(array), i + j) for j in range(n)])),
        )

    cut = passages.withColumn("_w", tokens("p_text"))
    cut = cut.withColumn("_inner", F.slice("_w", 2, F.greatest(F.size("_w") - 2, F.lit(0))))
    cut = cut.withColumn("_n", F.least(F.size("_inner"), F.lit(words)))
    sizes = [r[0] for r in cut.select("_n").distinct().orderBy("_n").collect()]  # at most words + 1 values
    candidates = []
    for n in sizes:
        mine = cut.where(F.col("_n") == n)
        if n:
            grams = mine.select("p_id", F.explode(shingles("_inner", n)).alias("gram"))
            worded = documents.select("doc_id", tokens("text").alias("_w"))
            in_docs = worded.select("doc_id", F.explode(F.array_distinct(shingles("_w", n))).alias("gram"))
        else:
            width = F.lit(2) ** F.floor(F.log2(F.length("p_text")))
            exact = mine.where(F.length("p_text") > 0).withColumn("_len", width.cast("int"))
            widths = [r[0] for r in exact.select("_len").distinct().orderBy("_len").collect()]  # powers of two
            if not widths:
                continue
            grams = exact.select("p_id", F.xxhash64(F.expr("left(p_text, _len)"), "_len").alias("gram"))
            in_docs = windows_of(documents, ["doc_id"], "text", widths).distinct()
        wanted = grams.select("gram").distinct()
        if wanted.count() <= BROADCAST_HASHES:  # 8 bytes each; a larger set is shuffled against the documents
            wanted = F.broadcast(wanted)
        # written once: only document runs that some passage has are left
        in_docs = freeze(in_docs.join(wanted, "gram", "left_semi"))
        seen = in_docs.groupBy("gram").agg(F.count(F.lit(1)).alias("_seen"))
        anchor = (
            grams.join(seen, "gram", "left")
            .fillna(0, ["_seen"])
            .groupBy("p_id")
            .agg(F.min(F.struct("_seen", "gram")).alias("a"))
            .select("p_id", F.col("a.gram").alias("gram"))
        )
        candidates.append(lookup(in_docs, anchor, ["gram"], "inner").select("p_id", "doc_id"))
    pairs = reduce(DataFrame.unionByName, candidates)
    texts = pairs.join(passages, "p_id").join(documents.select("doc_id", "text"), "doc_id")
    start = F.instr(F.col("text"), F.col("p_text"))
    return texts.withColumn("start", start - 1).where(F.col("start") >= 0).select("p_id", "doc_id", "start")


def longest_block(a: DataFrame, b: DataFrame, on: Sequence[str], min_len: int = 5) -> DataFrame:
    """Longest run two paired sequences share (at least ``min_len``) and where it starts in each.

    Sequences of a pair meet in one row and are compared there, in memory in proportion to their length
    whatever repeats in them. A plain row function gets them in lots of 100 pairs, so a Python worker never
    holds the 10,000 texts of an Arrow batch. Ties go to the earliest start in a, then in b. ``on`` must pair at most one row
    of each side.
    """
    on = list(on)

    @F.udf("size int, a_start int, b_start int", useArrow=False)
    def block(left: str, right: str) -> tuple[int | None, int | None, int | None]:
        return _longest_common(left, right, min_len)

    long_enough = lambda df, seq: df.where(F.length(seq) >= min_len).select(*on, seq)
    met = long_enough(a, "a_seq").join(long_enough(b, "b_seq"), on).withColumn("_found", block("a_seq", "b_seq"))
    return met.select(*on, "_found.*").where(F.col("size").isNotNull())


def _longest_common(a: str, b: str, least: int) -> tuple[int | None, int | None, int | None]:
    """(size, start in a, start in b) of the longest common run of at least ``least`` letters.

    Every place gets the rank of the 2**k letters from there, k rising while both texts share one; a run of
    any length up to the next power of two is told by the ranks at its two ends. Ranks are exact, no hashes.
    """
    letters = np.frombuffer((a + b).encode("utf-32-le"), np.uint32)
    split, n = len(a), len(a) + len(b)
    rank = np.unique(letters, return_inverse=True)[1].astype(np.int64)
    width = 1

    def starts(size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all runs of this size, of a and of b."""
        key = rank[: n - size + 1] * (n + 1) + rank[size - width : n - width + 1]
        return key[: max(split - size + 1, 0)], key[split:]

    def shared(size: int) -> bool:
        left, right = starts(size)
        return bool(len(left) and len(right) and np.isin(left, right).any())

    if not shared(1):
        return None, None, None
    while 2 * width <= min(split, n - split) and shared(2 * width):
        key = rank[: n - 2 * width + 1] * (n + 1) + rank[width : n - width + 1]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        width *= 2
    low, high = width, min(2 * width, split, n - split) + 1  # shared at low, not at high
    if high <= 2 * width and shared(high - 1):
        low = high - 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if shared(middle) else (low, middle)
    if low < least:
        return None, None, None
    left, right = starts(low)
    at = int(np.flatnonzero(np.isin(left, right))[0])
    return low, at, int(np.flatnonzero(right == left[at])[0])


def pair_residues(a: DataFrame, b: DataFrame, key: str, min_shared: int = 3) -> DataFrame:
    """Residue pairs by shared residue number (first occurrence), for keys with enough of them."""
    pair = F.col("res_num")
    left = first_per(a, [key, "res_num"], ["res_idx"]).select(key, pair, F.col("res_idx").alias("a_idx"))
    right = first_per(b, [key, "res_num"], ["res_idx"]).select(key, pair, F.col("res_idx").alias("b_idx"))
    pairs = left.join(right, [key, "res_num"])
    enough = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n_shared")).where(F.col("n_shared") >= min_shared)
    return lookup(pairs, enough, [key], "inner")


def pair_by_index(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Residue pairs by position, for keys where both sides have the same number of residues."""
    n = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    same = n(a, "_na").join(n(b, "_nb"), key).where(F.col("_na") == F.col("_nb")).select(key)
    left = a.join(same, key, "left_semi").select(key, "res_idx", F.col("res_num").alias("a_num"))
    return left.join(b.select(key, "res_idx", F.col("res_num").alias("b_num")), [key, "res_idx"])


def oligo_peptide(oligo_id: str | Column) -> Column:
    return strip_encoding(oligo_id)
