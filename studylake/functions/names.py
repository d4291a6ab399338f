"""Legal names (xsd:NCName) for tables, datasets and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studylake.functions.text import trim_blank

# The characters a name may start with and consist of.
START_CHARS = r"_\p{L}"
NAME_CHARS = r"\p{L}\p{N}\p{Mc}\p{Mn}\p{Pc}\p{Lm}"


def _allowed(strict: bool) -> str:
    return NAME_CHARS if strict else NAME_CHARS + r"\-."


def legal_name(name: Column, strict: bool = False) -> Column:
    """Nearest legal name. Strict names also avoid `-` and `.`."""
    out = F.regexp_replace(trim_blank(name), f"[^{_allowed(strict)}]", "_")
    out = F.regexp_replace(out, f"^([^{START_CHARS}])", "_$1")
    out = F.regexp_replace(out, "_{2,}", "_")
    out = F.when(out == "", F.lit("_x")).otherwise(out)
    return F.regexp_replace(out, "^((?i)xml)", "_$1")


def is_legal_name(name: Column, strict: bool = False) -> Column:
    return name.rlike(rf"^[{START_CHARS}][{_allowed(strict)}]*\z")


def version_suffix(major: Column, minor: Column, patch: Column) -> Column:
    return F.concat(F.lit("_"), F.concat_ws("_", major.cast("string"), minor.cast("string"), patch.cast("string")))


def dataset_name(study: Column, asset: Column, major: Column, minor: Column, patch: Column) -> Column:
    """`<study>.<asset>_<major>_<minor>_<patch>` with strict names."""
    return F.concat(
        legal_name(study, strict=True), F.lit("."), legal_name(asset, strict=True), version_suffix(major, minor, patch)
    )


def name_collisions(df: DataFrame, column: str, strict: bool = True) -> DataFrame:
    """Legal names that several different names became: `legal, n_names`."""
    return (
        df.select(column).distinct().groupBy(legal_name(F.col(column), strict).alias("legal"))
        .agg(F.count(F.lit(1)).alias("n_names")).where("n_names > 1")
    )
