"""Peptide and nucleotide strings. UPPER case is epitope, lower case is scaffold."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peptarium.functions.keys import stable_hash
from peptarium.functions.numeric import as_col, let

# Fixed values.
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W",
    "TYR": "Y", "VAL": "V",
}
GENETIC_CODE_BASES = "TCAG"
GENETIC_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
HEXAMER = "PPDDGG"
ORDER_PREFIX = "ACCTATACTTCCAAGGCGCA"
ORDER_SUFFIX = "GGTGACTCTCTGTCTTGGCT"
SYNTHESIS_LENGTH = 103
EPITOPE_MARGIN = 4

CODONS = {"".join(b): a for b, a in zip(product(GENETIC_CODE_BASES, repeat=3), GENETIC_CODE)}


def _literal_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def letters(c: str | Column) -> Column:
    return F.upper(F.regexp_replace(as_col(c), "[^A-Za-z]", ""))


def residue_letter(res_name: str | Column) -> Column:
    """Three-letter residue name to one letter; unknown names become X."""
    return F.coalesce(F.try_element_at(_literal_map(THREE_TO_ONE), F.upper(as_col(res_name))), F.lit("X"))


def translate(c: str | Column) -> Column:
    """Protein of a coding sequence, or null for a partial or unknown codon."""
    dna = as_col(c)
    amino = F.transform(
        F.regexp_extract_all(dna, F.lit("(?s).{3}"), F.lit(0)), lambda t: F.try_element_at(_literal_map(CODONS), t)
    )
    joined = let(amino, lambda found: F.when(~F.exists(found, lambda a: a.isNull()), F.array_join(found, "")))
    return F.when(F.length(dna) % 3 == 0, joined)


def case_encode_positions(seq: str | Column, positions: str | Column) -> Column:
    """Lower-case everything but the 0-based ``positions``."""
    chars = F.split(F.lower(as_col(seq)), "")
    return F.array_join(
        F.transform(chars, lambda ch, i: F.when(F.array_contains(as_col(positions), i), F.upper(ch)).otherwise(ch)), ""
    )


def case_encode_span(seq: str | Column, start: Column | int, length: Column | int) -> Column:
    """Lower-case everything but ``length`` residues from 0-based ``start``."""
    s, a, n = as_col(seq), (F.lit(start) if isinstance(start, int) else start), (F.lit(length) if isinstance(length, int) else length)
    rest = F.greatest(F.length(s) - a - n, F.lit(0))
    return F.concat(F.lower(F.left(s, a)), F.upper(F.substring(s, a + 1, n)), F.lower(F.right(s, rest)))


def case_encode_unique(seq: str | Column, epitope: str | Column) -> Column:
    """Struct(status, encoded): the epitope must occur exactly once, counted without overlap."""
    s, e = as_col(seq), as_col(epitope)
    hits = (F.length(s) - F.length(F.replace(s, e, F.lit("")))) / F.length(e)
    ok = hits == 1
    return F.struct(
        F.when(s.isNull() | e.isNull(), "missing").when(ok, "ok").otherwise("epitope_not_unique").alias("status"),
        F.when(ok, case_encode_span(s, F.instr(s, e) - 1, F.length(e))).alias("encoded"),
    )


def case_encode_linear(seq: str | Column, tail: int = 30) -> Column:
    """Linear construct: filler lower, the last ``tail`` residues upper."""
    s = as_col(seq)
    return F.concat(F.lower(F.left(s, F.greatest(F.length(s) - tail, F.lit(0)))), F.upper(F.right(s, F.lit(tail))))


def islands(c: str | Column) -> Column:
    """The upper-case runs, in order."""
    return F.regexp_extract_all(as_col(c), F.lit("[A-Z]+"), F.lit(0))


def trim_to(c: str | Column, length: int = SYNTHESIS_LENGTH) -> Column:
    """Struct(seq, note): drop one scaffold residue from an end, never an epitope residue."""
    s = as_col(c)
    short, c_lower, n_lower = F.length(s) <= length, s.rlike("[a-z]$"), s.rlike("^[a-z]")
    return F.struct(
        F.when(short, s)
        .when(c_lower, F.left(s, F.length(s) - 1))
        .when(n_lower, F.right(s, F.length(s) - 1))
        .alias("seq"),
        F.when(short, F.lit(f"already{length}"))
        .when(c_lower, F.lit("cterm"))
        .when(n_lower, F.lit("nterm"))
        .otherwise(F.lit("both_termini_epitope"))
        .alias("note"),
    )


def mutate_island(c: str | Column, n: int, every_other: bool = False) -> Column:
    """Replace the n-th upper run by alanine (all, or every other residue); null without such a run."""
    s = as_col(c)
    head = "[^A-Z]*" + "[A-Z]+[^A-Z]+" * (n - 1)
    pattern = f"(?s)^({head})([A-Z]+)(.*)$"
    run = F.regexp_extract(s, pattern, 2)
    swapped = F.regexp_replace(run, "[A-Z]([A-Z]?)" if every_other else "[A-Z]", "A$1" if every_other else "A")
    return F.when(s.rlike(pattern), F.concat(F.regexp_extract(s, pattern, 1), swapped, F.regexp_extract(s, pattern, 3)))


# A spot is six lower-case residues with no upper-case residue within the margin on either side.
# Fixed-length look-behinds are tried one by one: much cheaper than one of variable length.
_SPOT = (
    f"(?=[a-z]{{6}}(?:[^A-Z]{{{EPITOPE_MARGIN}}}|[^A-Z]{{0,{EPITOPE_MARGIN - 1}}}$))"
    + "".join(f"(?<![A-Z]{'.' * d})" for d in range(EPITOPE_MARGIN))
)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _place_hexamers(seq: Column, key: Column, count: Column, seed: int) -> Column:
    """Struct(seq, placed) after up to ``count`` sequential placements at hash-picked spots."""

    def step(state: Column, i: Column) -> Column:
        def place(marked: Column) -> Column:
            spots = F.length(marked) - F.length(state["seq"])
            pick = F.pmod(stable_hash(key, count, i, seed=seed), F.greatest(spots, F.lit(1))).cast("int")
            at = F.length(F.call_function("substring_index", marked, F.lit("|"), pick + 1)) - pick
            placed = F.concat(F.left(state["seq"], at), F.lit(HEXAMER), F.right(state["seq"], F.length(state["seq"]) - at - 6))
            return F.when(spots > 0, F.struct(placed.alias("seq"), (state["placed"] + 1).alias("placed"))).otherwise(state)

        # once a placement failed, later ones fail too
        return F.when(state["placed"] == i - 1, _let(F.regexp_replace(state["seq"], _SPOT, "|"), place)).otherwise(state)

    start = F.struct(seq.alias("seq"), F.lit(0).alias("placed"))
    return F.aggregate(F.sequence(F.lit(1), count), start, step)


def disrupt(c: str | Column, key: str | Column, seed: int = 0, most: int = 4, least: int = 1) -> Column:
    """Struct(seq, placed): the largest hexamer count from ``most`` down that fits; null when none does."""
    none = F.lit(None).cast("struct<seq:string,placed:int>")

    def attempt(found: Column, n: Column) -> Column:
        fresh = _let(_place_hexamers(as_col(c), as_col(key), n, seed), lambda r: F.when(r["placed"] == n, r))
        return F.when(found.isNotNull(), found).otherwise(fresh)

    return F.aggregate(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), none, attempt)


def build_controls(
    df: DataFrame,
    id_col: str = "design_ID",
    seq_col: str = "designedSequence",
    target_col: str = "target",
    seed: int = 0,
    every_other: bool = False,
    single_hexamer: bool = False,
    least: int = 1,
) -> DataFrame:
    """Up to four mutated controls per design; flavours that cannot be made are left out."""
    name, seq = F.col(id_col), F.col(seq_col)
    flavours = [
        F.struct(F.concat(name, F.lit(f"_epitopeIsland{n}Mut>A")).alias("design_ID"), mutate_island(seq, n, every_other).alias("mutated"))
        for n in (1, 2)
    ]
    if single_hexamer:
        one = disrupt(seq, name, seed, 1, 1)
        flavours.append(F.struct(F.concat(name, F.lit("_scaffoldMutX1")).alias("design_ID"), one["seq"].alias("mutated")))
    many = F.col("_disrupted")
    flavours.append(
        F.struct(F.concat(name, F.lit("_scaffoldMutX"), many["placed"].cast("string")).alias("design_ID"), many["seq"].alias("mutated"))
    )
    rows = (
        df.where(F.length(seq) > 0)
        .withColumn("_disrupted", disrupt(seq, name, seed + 1, 4, least))
        .select(F.col(target_col).alias("target"), F.explode(F.array(*flavours)).alias("f"))
        .where(F.col("f.mutated").isNotNull())
    )
    whole = F.upper("f.mutated")
    return rows.select(
        F.left(whole, F.lit(SYNTHESIS_LENGTH)).alias("sequence"),
        F.lit("scaffoldedAbEpitope").alias("category"),
        F.lit("RFD").alias("model"),
        whole.alias("designedSequence"),
        F.length(whole).alias("designedSequenceLength"),
        F.col("f.design_ID").alias("design_ID"),
        "target",
        F.col("f.mutated").alias("scaffoldEPITOPE"),
    )


_WINDOWS_PER_CHUNK = 64


def tile(
    df: DataFrame, seq_col: str, mer: int, step: int, cterm: bool = True, prefix: str = "", start_col: str = "start"
) -> DataFrame:
    """One row per window: ``start`` (1-based), ``tile`` and ``construct`` (constant prefix + tile).

    Windows start at 1, 1+step, ...; with ``cterm`` a last window ends at the C-terminus when the grid
    stops short of it. Sequences shorter than ``mer`` give none. Windows are cut from chunks, since a
    substring costs its offset, and by bytes where a chunk has one per letter, since letters are counted anew.
    """
    last = F.length(seq_col) - mer + 1
    reach = step * (_WINDOWS_PER_CHUNK - 1)
    at = lambda start, span: F.struct(start.cast("int").alias("at"), span.cast("int").alias("span"))
    chunks = F.transform(
        F.sequence(F.lit(1), last, F.lit(step * _WINDOWS_PER_CHUNK)), lambda s: at(s, F.least(F.lit(reach), last - s))
    )
    if cterm:
        chunks = F.when((last - 1) % step > 0, F.concat(chunks, F.array(at(last, F.lit(0))))).otherwise(chunks)
    cut = df.where(last >= 1).withColumn("_c", F.explode(chunks))
    cut = cut.withColumn("_chunk", F.substring(F.col(seq_col), F.col("_c.at"), F.lit(reach + mer)))
    cut = cut.withColumns({"_plain": F.octet_length("_chunk") == F.length("_chunk"), "_chunk": F.col("_chunk").cast("binary")})
    cut = cut.withColumn("_off", F.explode(F.sequence(F.lit(0), F.col("_c.span"), F.lit(step))))
    window = lambda text: F.substring(text, F.col("_off") + 1, F.lit(mer)).cast("string")
    return (
        cut.withColumn(start_col, F.col("_c.at") + F.col("_off"))
        .withColumn("tile", F.when(F.col("_plain"), window(F.col("_chunk"))).otherwise(window(F.col("_chunk").cast("string"))))
        .withColumn("construct", F.concat(F.lit(prefix), F.col("tile")))
        .drop("_c", "_chunk", "_plain", "_off")
    )
