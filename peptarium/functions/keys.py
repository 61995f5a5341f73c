"""Design keys, paths, index lists and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from peptarium.functions.numeric import as_col


def stable_hash(*parts: str | Column, seed: int = 0) -> Column:
    """60-bit hash of the parts and a seed, the same on every engine that has md5."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def collapse_id(c: str | Column) -> Column:
    """``name_name_0_model`` to ``name_0_model``."""
    name = as_col(c)
    # the search for a repeated part is slow, and only names with the rest of the pattern can hold one
    return F.when(name.contains("_model"), F.regexp_replace(name, r"(.+?)_\1(_\d+_model)", "$1$2")).otherwise(name)


# The naming schemes of the design files. Group names become struct fields.
KEY_PATTERNS: dict[str, tuple[str, tuple[tuple[str, str], ...]]] = {
    "tile": (
        r"(?i)^([^_]+)_res(\d+)_split(\d+)_model(\d+)_fixed_dldesign_(\d+)$",
        (("antigen", "string"), ("res", "int"), ("split", "int"), ("model", "int"), ("dldesign", "int")),
    ),
    "contig": (
        r"(?i)^(.+?)__contig(\d+)__seed(\d+)__rep(\d+).*_fixed_dldesign_(\d+)$",
        (("id", "string"), ("contig_id", "int"), ("seed", "int"), ("rep", "int"), ("dldesign", "int")),
    ),
    "token": (r"(?i)^([0-9a-f]{32}).*_0_model_(\d+)", (("token", "string"), ("pred", "int"))),
    "member": (r"^(.+_(\d+))_(\d+)$", (("member", "string"), ("number", "int"), ("encoding", "int"))),
}


def parse_key(c: str | Column, pattern: str) -> Column:
    """Struct of the named parts, or null when the key does not follow the scheme."""
    regex, fields = KEY_PATTERNS[pattern]
    value = as_col(c)
    parts = [F.regexp_extract(value, regex, i + 1).try_cast(t).alias(name) for i, (name, t) in enumerate(fields)]
    return F.when(value.rlike(regex), F.struct(*parts))


def strip_library_key(c: str | Column) -> Column:
    """Drop a leading ``C<digit>_`` and a trailing ``_r<digits>``."""
    return F.regexp_replace(F.regexp_replace(as_col(c), r"^C\d+_", ""), r"_r\d+$", "")


def strip_encoding(c: str | Column) -> Column:
    """Drop the last ``_<part>``, the encoding index of an oligo name."""
    return F.regexp_replace(as_col(c), r"_[^_]*$", "")


def strip_mutation(c: str | Column) -> Column:
    return F.regexp_replace(as_col(c), r"(_epitopeIsland[12]Mut>A|_scaffoldMutX[1-4])$", "")


def remap_prefix(c: str | Column, old: str, new: str) -> Column:
    value = as_col(c)
    return F.when(value.startswith(old), F.concat(F.lit(new), F.substring(value, len(old) + 1, 1 << 30))).otherwise(value)


def basename(c: str | Column) -> Column:
    return F.element_at(F.split(as_col(c), "/"), -1)


def parse_index_list(c: str | Column) -> Column:
    """``"[1 2 3]"`` or any text with integers to ``array<int>``; null text gives an empty list."""
    found = F.regexp_extract_all(F.coalesce(as_col(c).cast("string"), F.lit("")), F.lit(r"-?\d+"), F.lit(0))
    return F.transform(found, lambda s: s.cast("int"))


def list_len(c: str | Column) -> Column:
    """Size of a list where null stays null: no prediction is not the same as an empty list."""
    value = as_col(c)
    return F.when(value.isNotNull(), F.size(value))


def number_from_text(c: str | Column) -> Column:
    """Length text ``a-b`` or ``a``: the upper number."""
    return F.element_at(F.split(F.trim(as_col(c)), "-"), -1).try_cast("int")
