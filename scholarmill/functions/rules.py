"""Column transformations named in a configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import columns as C


def _items(c: Column, separator: str | None) -> Column:
    """Trimmed items that are not empty: between the separator; without one, between semicolons, or commas where none is there."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    mark = F.lit(separator) if separator else F.when(F.contains(text, F.lit(";")), ";").otherwise(",")
    quoted = F.concat(F.lit("\\Q"), mark, F.lit("\\E"))
    return F.filter(F.transform(F.split(text, quoted), lambda x: F.trim(x)), lambda x: x != "")


def _text(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), F.lit(""))


def apply_rule(c: Column, rule: dict) -> Column:
    """The column under a rule {"type": ..., "separator": ...}; unknown types leave it as it is.

    Nulls stay null, but for the types that give lists, where they are empty.
    """
    kind = rule.get("type")
    if kind in ("extract_year", "normalize_year", "normalize_publication_year"):
        return C.year_in(c)
    if kind == "split":
        return _items(c, rule.get("separator", ";"))
    if kind in ("normalize_list", "normalize_list_like"):
        return _items(c, None)
    if kind == "normalize_doi":
        return C.doi_plain(c.cast("string"))
    if kind in ("normalize_date", "normalize_publication_date"):
        return C.partial_date(c.cast("string"))
    if kind in ("normalize_text", "strip"):
        return _text(c)
    return c


def transformed(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """``df`` with each named column that it has under its rule; other columns and their order stay."""
    return df.select(*(apply_rule(F.col(f"`{c}`"), rules[c]).alias(c) if c in rules else F.col(f"`{c}`") for c in df.columns))
