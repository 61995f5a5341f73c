"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per text. The ledger row holds the measurements and one integer whose
bit i says that rule i failed. A policy is a versioned set of rules, hence a mask: applying it is one
bitwise AND, and ablations are sums over the few distinct bit patterns.

Defined cases: a null, empty or blank text has zero words and fails ``few_words``; repeated rows are
judged one by one; an empty table gives an empty ledger. Ratios are compared as integer products, so
nothing divides by zero.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.llm.common import SPACE, Words, slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_ascii_letters")

#: bit number = place in this list; a rule is true where the text fails
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    ("shouting", "100 * n_upper > 60 * n_ascii_letters"),
    ("word_length", "word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words"),
)

#: policies never change once published; a new choice of rules gets a new version
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols"),
    "v2": ("few_words", "repeated_words", "symbols", "repeated_lines", "shouting", "word_length"),
}
PRODUCTION = "v2"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_CODE_POINT = np.zeros(256, bool)
_CODE_POINT[:] = (np.arange(256) & 0xC0) != 0x80


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _line_counts(text: bytes) -> tuple[int, int]:
    seen, lines, repeats = set(), 0, 0
    for line in text.split(b"\n"):
        if line.split():
            lines += 1
            repeats += line in seen
            seen.add(line)
    return lines, repeats


def _repeated(ids: np.ndarray) -> int:
    """Words covered by 3-word windows that occur at least twice; ids are exact, so the count is."""
    if len(ids) < 4:
        return 0
    _, pair = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    _, at, counts = np.unique(pair[:-1] * (ids.max() + 1) + ids[2:], return_inverse=True, return_counts=True)
    hit = counts[at] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(texts: pa.LargeStringArray) -> dict[str, np.ndarray]:
    words = Words(texts)
    ids, _ = words.ids()
    data, bounds = words.data, words.bounds
    n = len(bounds) - 1
    lines = np.array([_line_counts(data[bounds[i] : bounds[i + 1]].tobytes()) for i in range(n)], np.int64).reshape(-1, 2)
    return {
        "n_words": np.diff(words.first),
        "word_chars": _per_text(_CODE_POINT[data] & ~SPACE[data], bounds),
        "n_symbols": _per_text(_SYMBOL[data], bounds),
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": np.array([_repeated(ids[words.first[i] : words.first[i + 1]]) for i in range(n)], np.int64),
        "n_lines": lines[:, 0],
        "n_upper": _per_text(_UPPER[data], bounds),
        "n_ascii_letters": _per_text(_LETTER[data], bounds),
    }


def mask_of(rules: Sequence[str]) -> int:
    bits = {name: 1 << i for i, (name, _) in enumerate(RULES)}
    return sum(bits[r] for r in rules)


def _measured(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Carried columns as _c0, _c1, ..., then the measurements and ``fail_bits``."""
    source = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    fields = [(f"_c{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(carry)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            got = measure(piece.column(piece.schema.get_field_index("_text")))
            kept = [piece.column(piece.schema.get_field_index(f"_c{i}")) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(got[m], pa.int64()) for m in MEASURES)], [*(f for f, _ in fields), *MEASURES])

    schema = ", ".join([f"{f} {t}" for f, t in fields] + [f"{m} bigint" for m in MEASURES])
    bits = F.lit(0)
    for i, (_, failed) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(failed), F.lit(1 << i)).otherwise(F.lit(0)))
    return source.mapInArrow(run, schema).withColumn("fail_bits", bits)


def ledger(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``carry`` columns, the measurements and ``fail_bits``, one row per input row.

    A carried column that is named like a measurement is left out.
    """
    entries = _measured(docs, carry)
    named = [F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c not in (*MEASURES, "fail_bits")]
    return entries.select(*named, *MEASURES, "fail_bits")


def passes(policy: str = PRODUCTION, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(mask_of(POLICIES[policy]))) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """Per policy and rule: documents kept, rejected, failing the rule, and lost by this rule alone.

    The ledger is first counted per bit pattern, at most 2**rules rows, so nothing large is shuffled.
    """
    patterns = entries.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"))
    rows = [
        F.struct(F.lit(policy).alias("policy"), F.lit(rule).alias("rule"), F.lit(mask_of(rules)).alias("mask"), F.lit(mask_of([rule])).alias("bit"))
        for policy, rules in POLICIES.items()
        for rule in rules
    ]
    failed = F.col("fail_bits").bitwiseAND(F.col("c.mask"))
    return (
        patterns.withColumn("c", F.explode(F.array(*rows)))
        .groupBy(F.col("c.policy").alias("policy"), F.col("c.rule").alias("rule"))
        .agg(
            F.sum(F.when(failed == 0, F.col("n")).otherwise(0)).alias("kept"),
            F.sum(F.when(failed != 0, F.col("n")).otherwise(0)).alias("rejected"),
            F.sum(F.when(failed.bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(failed == F.col("c.bit"), F.col("n")).otherwise(0)).alias("lost_by_rule_alone"),
        )
    )


def keep_good(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Rows whose ledger entry passes ``policy``; columns unchanged."""
    kept = _measured(docs, docs.columns).where(passes(policy))
    return kept.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
