"""Column expressions that bring identifiers and names into one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import nonblank


def url(c: Column) -> Column:
    """Scheme and host in lower case, without fragment and closing punctuation; other texts stay; blank is null."""
    t = F.regexp_replace(nonblank(c), r"[.,;:)\]}>\"']+$", "")
    whole = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^#]*)(#.*)?$"
    parts = [F.regexp_extract(t, whole, k) for k in (1, 2, 3)]
    return F.when(t.rlike(whole), F.concat(F.lower(parts[0]), F.lit("://"), F.lower(parts[1]), parts[2])).otherwise(t)


def openalex_id(c: Column) -> Column:
    """The address of a work, author, institution, venue, source, funder or concept, with its letter in upper case."""
    t = url(c)
    found = F.regexp_extract(t, r"(?i)/([WAIVSFC]\d+)$", 1)
    return F.when(found != "", F.concat(F.lit("https://openalex.org/"), F.upper(found))).otherwise(t)


def issn(c: Column) -> Column:
    """``dddd-dddX``, with or without its hyphen and spaces; anything else is null."""
    t = F.upper(F.regexp_replace(c, " ", ""))
    return F.when(t.rlike(r"^\d{4}-?\d{3}[\dX]$"), F.concat(F.substring(t, 1, 4), F.lit("-"), F.substring(t, -4, 4)))


def doi_loose(c: Column) -> Column:
    """Lower case without resolver, ``doi:`` and slashes at the ends; texts that are no DOI stay; blank words are null."""
    t = F.lower(F.trim(c))
    t = F.when(~t.isin("", "nan", "none", "null", "n/a", "na", "-"), F.regexp_replace(F.regexp_replace(t, r"^https?://(dx\.)?doi\.org/", ""), r"^doi:\s*", ""))
    return F.nullif(F.regexp_replace(F.trim(t), "^/+|/+$", ""), F.lit(""))


def display_name(c: Column) -> Column:
    """``Family, Given`` turned round where there is one comma; names all in capitals get small letters."""
    t = nonblank(c)
    family, given = F.trim(F.split_part(t, F.lit(","), F.lit(1))), F.trim(F.split_part(t, F.lit(","), F.lit(2)))
    turned = F.when(t.rlike("^[^,]+,[^,]+$") & (family != "") & (given != ""), F.concat_ws(" ", given, family)).otherwise(t)
    return F.when((turned == F.upper(turned)) & turned.rlike(r"\p{L}{2}"), F.initcap(turned)).otherwise(turned)
