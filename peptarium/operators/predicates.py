"""Filters, predicate columns, alias resolution and contract projections."""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peptarium.functions.keys import stable_hash
from peptarium.functions.numeric import num
from peptarium.operators.ordering import row_rank

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq}


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


@dataclass(frozen=True)
class Condition:
    """``column op threshold``; a null value fails, or takes ``if_null`` first when that is given."""

    column: str
    op: str
    threshold: float
    if_null: float | None = None

    def test(self) -> Column:
        value = num(self.column)
        if self.if_null is not None:
            value = F.coalesce(value, F.lit(float(self.if_null)))
        return F.coalesce(COMPARE[self.op](value, F.lit(float(self.threshold))), F.lit(False))


def all_of(conditions: Sequence[Condition]) -> Column:
    return reduce(operator.and_, (c.test() for c in conditions), F.lit(True))


def row_filter(df: DataFrame, condition: Condition) -> Column:
    """The condition as a filter. On a numeric column it is a bare comparison, which the file scan can take.

    NaN sorts above every number in Spark, so it fails ``<``, ``<=`` and ``==`` by itself.
    """
    numeric = dict(df.dtypes)[condition.column] in ("double", "float", "int", "bigint", "smallint", "tinyint")
    if not numeric or condition.if_null is not None:
        return condition.test()
    value = F.col(condition.column)
    test = COMPARE[condition.op](value, F.lit(float(condition.threshold)))
    return test if condition.op in ("<", "<=", "==") else test & ~F.isnan(value)


def gate(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Keep rows with ``column <= threshold``; nulls go, an absent column is an error."""
    require_columns(df, [column])
    return df.where(row_filter(df, Condition(column, "<=", threshold)))


def gates(df: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """Apply every condition whose column exists."""
    for c in conditions:
        if c.column in df.columns:
            df = df.where(row_filter(df, c))
    return df


# The published pass criteria and their variants.
FOUR_FILTER = (
    Condition("overall_rmsd", "<=", 2.0),
    Condition("epitope_chunk_rmsd", "<=", 1.0),
    Condition("mean_pae", "<", 5.0),
    Condition("af3_n_clash_res", "==", 0.0),
)
PASS_VARIANTS: dict[str, tuple[Condition, ...]] = {
    "standard": FOUR_FILTER,
    "inclusive_pae": (*FOUR_FILTER[:2], Condition("mean_pae", "<=", 5.0), FOUR_FILTER[3]),
    "strict_no_clash": (
        Condition("overall_rmsd", "<", 2.0),
        Condition("epitope_chunk_rmsd", "<", 1.0),
        Condition("mean_pae", "<", 5.0),
    ),
    "strict_max_clash": (
        Condition("overall_rmsd", "<", 2.0),
        Condition("epitope_chunk_rmsd", "<", 1.0),
        Condition("mean_pae", "<", 5.0),
        Condition("af3_n_clash_res", "<=", 5.0),
    ),
    "swapped": (Condition("epitope_chunk_rmsd", "<", 2.0), Condition("overall_rmsd", "<", 1.0)),
    "relaxed": (
        Condition("mean_pae", "<", 7.0),
        Condition("overall_rmsd", "<", 3.0),
        Condition("epitope_chunk_rmsd", "<", 2.0),
        Condition("af3_n_clash_res", "==", 1.0),
    ),
}


def four_filter(df: DataFrame, conditions: Sequence[Condition] = FOUR_FILTER, out: str = "is_pass") -> DataFrame:
    require_columns(df, [c.column for c in conditions])
    return df.withColumn(out, all_of(conditions))


def _fold_conditions(epitope_rmsd, scaffold_rmsd, epitope_pae, scaffold_pae) -> tuple[Condition, ...]:
    return (
        Condition("epitope_chunk_rmsd", "<=", epitope_rmsd),
        Condition("scaffold_rmsd", "<=", scaffold_rmsd),
        Condition("epitope_pae", "<", epitope_pae),
        Condition("scaffold_pae", "<", scaffold_pae),
        Condition("af3_n_clash_res", "==", 0.0, if_null=1.0),
    )


# Rigid and flexible limits on each half of the design.
FOLD_CONDITIONS = {
    "rigid_rigid": _fold_conditions(1.0, 2.0, 5.0, 5.0),
    "rigid_epitope_flexible_scaffold": _fold_conditions(1.0, 5.0, 5.0, 10.0),
    "flexible_epitope_rigid_scaffold": _fold_conditions(3.0, 2.0, 10.0, 5.0),
    "flexible_flexible": _fold_conditions(3.0, 5.0, 10.0, 10.0),
}


def fold_conditions(df: DataFrame) -> DataFrame:
    return df.withColumns({name: all_of(c) for name, c in FOLD_CONDITIONS.items()})


def fold_condition_counts(df: DataFrame) -> DataFrame:
    """One row per condition: passing rows and their percentage of the table."""
    flags = fold_conditions(df)
    totals = flags.agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in FOLD_CONDITIONS]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("condition"), F.coalesce(F.col(c), F.lit(0)).alias("n_pass")) for c in FOLD_CONDITIONS])
    return totals.select("_n", F.explode(rows).alias("r")).select(
        "r.condition", "r.n_pass", (F.lit(100.0) * F.col("r.n_pass") / F.greatest("_n", F.lit(1))).alias("pct")
    )


def status_ok(df: DataFrame, columns: Sequence[str] = ("status",)) -> DataFrame:
    """Keep rows whose status columns, where present, all say ok in any case."""
    for c in columns:
        if c in df.columns:
            df = df.where(F.lower(F.col(c)) == "ok")
    return df


def exclude_prefix(df: DataFrame, column: str, prefixes: Sequence[str]) -> DataFrame:
    value = F.lower(F.col(column).cast("string"))
    hit = reduce(operator.or_, (value.startswith(p.lower()) for p in prefixes), F.lit(False))
    return df.where(~F.coalesce(hit, F.lit(False)))


def exclude_values(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Drop exact matches in any case; serves ids and categories alike."""
    value = F.lower(F.col(column).cast("string"))
    return df.where(~F.coalesce(value.isin([v.lower() for v in values]), F.lit(False)))


def drop_uncomputable(df: DataFrame, column: str = "af3_clash_status") -> DataFrame:
    if column not in df.columns:
        return df
    return df.where(F.coalesce(F.col(column) != "too_few_epitope_pairs", F.lit(True)))


def first_present(columns: Sequence[str], aliases: Sequence[str]) -> str | None:
    return next((a for a in aliases if a in columns), None)


def resolve_aliases(df: DataFrame, spec: dict[str, tuple[Sequence[str], float]]) -> dict[str, tuple[str, float]]:
    """``term: (aliases, weight)`` to ``term: (column, weight)`` over present terms, weights summing to 1."""
    found = {t: (first_present(df.columns, names), w) for t, (names, w) in spec.items()}
    found = {t: (c, w) for t, (c, w) in found.items() if c}
    total = sum(w for _, w in found.values())
    return {t: (c, w / total) for t, (c, w) in found.items()}


CONTRACT = ("id", "contig_id", "contig_string", "contig_length", "epitope_resindices", "epitope_chunks", "assay_scaffolded_epitope_id")


def project_contract(df: DataFrame, contract: Sequence[str] = CONTRACT) -> DataFrame:
    return df.select(*[c for c in contract if c in df.columns])


# Internal metric name to shipped column name.
SHIPPED = {
    "epitope_chunk_rmsd": "epitope_rmsd",
    "overall_rmsd": "overall_rmsd",
    "epitope_pae": "epitope_pae",
    "scaffold_pae": "scaffold_pae",
    "mean_pae": "mean_pae",
    "ptm": "ptm",
    "af3_n_clash_res": "af3_clashes",
    "cylinder_native_aware": "cylinder_clashes",
}
# The output columns of the library table.
IDENTITY_COLS = ("sequence", "category", "model", "designedSequence", "designedSequenceLength", "design_ID", "target")
EXTRA_COLS = ("composite", "rank_in_group", "is_global_pass", "island_index")
LIBRARY_TYPES = {
    **{c: "string" for c in IDENTITY_COLS},
    "designedSequenceLength": "int",
    **{c: "double" for c in SHIPPED.values()},
    "composite": "double",
    "rank_in_group": "int",
    "is_global_pass": "boolean",
    "island_index": "int",
}


def to_library_schema(df: DataFrame, types: dict[str, str] = LIBRARY_TYPES, keep: Sequence[str] = ()) -> DataFrame:
    """Rename metrics to their shipped names and reindex; absent columns become null, never zero."""
    df = df.withColumnsRenamed({k: v for k, v in SHIPPED.items() if k in df.columns})
    return df.select(
        *keep, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
    )


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """A seeded sample of n rows: the n smallest hashes of (key, seed)."""
    hashed = df.withColumn("_h", stable_hash(*key, seed=seed))
    if n <= 100_000:
        return hashed.orderBy("_h", *key).limit(n).drop("_h")
    # a limit gathers n rows of every partition in one task, so a large sample is cut by rank
    return row_rank(hashed, [], ["_h", *key], out="_n").where(F.col("_n") <= n).drop("_h", "_n")


def even_sample(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Rows at positions ``int(i·len/n)`` for i in 0..n-1 of the given order."""
    total = df.count()
    if total <= n:
        return df
    numbered = row_rank(df, [], [F.col(c) for c in order], out="_pos")
    # position p is chosen exactly when some i in 0..n-1 has floor(i*total/n) = p
    p = F.col("_pos") - 1
    i = F.ceil(p * F.lit(n) / F.lit(total))
    chosen = (i < n) & (F.floor(i * F.lit(total) / F.lit(n)) == p)
    return numbered.where(chosen).drop("_pos")
