"""Column expressions for publication records: lists, blanks, identifiers, dates, keys, flags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings that mean "nothing" in merged exports.
BLANKS = ("", "nan", "none", "null", "na", "n/a", "[]", "{}")


def present(c: Column) -> Column:
    """Neither null nor only spaces."""
    return F.coalesce(F.trim(c.cast("string")) != "", F.lit(False))


def nonblank(c: Column) -> Column:
    """The trimmed text, or null for null and for strings that mean nothing."""
    t = F.trim(F.regexp_replace(c.cast("string"), r"\s+", " "))
    return F.when(~F.lower(t).isin(*BLANKS), t)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it, also for each item of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_list(c: Column) -> Column:
    """Items between semicolons, trimmed, without empty ones; null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def tagged(c: Column, label: str, name: str = "name", value: str = "v") -> Column:
    """The items of a list column as structs of a constant and the item."""
    return F.transform(split_list(c), lambda v: F.struct(F.lit(label).alias(name), v.alias(value)))


def distinct_caseless(items: Column) -> Column:
    """Items without later repeats that differ in case only; order and first spelling stay."""
    lowered = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def doi_plain(c: Column) -> Column:
    """Lower case, without resolver or ``doi:`` prefix, spaces and closing punctuation."""
    t = F.regexp_replace(F.lower(F.trim(c)), r"^(https?://(dx\.)?doi\.org/|doi:)", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", ""), r"[.,;:)\]}]+$", "")
    return F.when(t != "", t)


def doi_strict(c: Column) -> Column:
    """The first DOI found anywhere in a text, or null."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(c), r"(10\.\d{4,9}/[^\s\"'<>]+)", 1), r"[.,;:)\]}]+$", ""), F.lit(""))


def is_doi(c: Column) -> Column:
    return F.coalesce(doi_plain(c).rlike(r"^10\.\d{4,9}/[^\s\"'<>]+$"), F.lit(False))


def title_key(c: Column) -> Column:
    """Lower-case letters, marks and digits; everything else is one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{M}\p{N}\x{200c}\x{200d}]+", " "))


def slug(c: Column) -> Column:
    """Lower case with runs of anything but letters and digits as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def year_in(c: Column) -> Column:
    """The first year 1500-2099 in a text."""
    return F.regexp_extract(c.cast("string"), r"(1[5-9]\d\d|20\d\d)", 1).try_cast("int")


def partial_date(c: Column) -> Column:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD``: a bad day gives the month, a bad month the year; d/m/Y where d > 12."""
    t = F.trim(c)
    y, m, d = (F.regexp_extract(t, r"^(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", k) for k in (1, 2, 3))
    a, b, z = (F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", k) for k in (1, 2, 3))
    swap = a.try_cast("int") > 12
    year = F.when(z != "", z).otherwise(y)
    month = F.when(z != "", F.when(swap, b).otherwise(a)).otherwise(m).try_cast("int")
    day = F.when(z != "", F.when(swap, a).otherwise(b)).otherwise(d).try_cast("int")
    ym = F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"))
    full = F.concat_ws("-", ym, F.lpad(day.cast("string"), 2, "0"))
    good_month = F.coalesce(month.between(1, 12), F.lit(False))
    return F.when(year == "", None).when(~good_month, year).when(F.try_to_date(full, "yyyy-MM-dd").isNull(), ym).otherwise(full)


def language_code(c: Column) -> Column:
    """Two-letter style code: lower case, before any region; blank is ``unknown``, ``english`` is ``en``."""
    t = F.regexp_replace(F.lower(F.trim(c)), "-", "_")
    t = F.when(t == "english", "en").otherwise(F.split(t, "_")[0])
    return F.when(present(c), t).otherwise("unknown")


def orcid(c: Column) -> Column:
    """A valid ORCID as four groups, by its ISO 7064 mod 11-2 check character; otherwise null."""
    digits = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), r"^HTTPS?://ORCID\.ORG/", ""), "[^0-9X]", "")
    chars = F.filter(F.split(F.substring(digits, 1, 15), ""), lambda x: x != "")
    total = F.aggregate(chars, F.lit(0), lambda acc, x: (acc + F.coalesce(x.try_cast("int"), F.lit(0))) * 2)
    check = (12 - total % 11) % 11
    right = F.substring(digits, 16, 1) == F.when(check == 10, "X").otherwise(check.cast("string"))
    groups = F.concat_ws("-", *(F.substring(digits, k, 4) for k in (1, 5, 9, 13)))
    return F.when(digits.rlike("^[0-9]{15}[0-9X]$") & right, groups)


#: Words that mark an author value as an institution.
INSTITUTION_WORDS = """
university department faculty institute institution college centre center school hospital ministry laboratory laboratories
academy council society association foundation division office unit programme program project library museum corporation
company ltd pvt inc
""".split()


def looks_like_institution(c: Column) -> Column:
    words = "|".join(INSTITUTION_WORDS)
    return F.coalesce(c.rlike(rf"(?i)(^|[^\p{{Alnum}}])({words})([^\p{{Alnum}}]|$)"), F.lit(False))


def any_word(c: Column, *words: str) -> Column:
    return F.coalesce(c.rlike("(?i)\\b(" + "|".join(words) + ")\\b"), F.lit(False))


def quality_flags(doi: Column, year: Column, citations: Column, is_oa: Column, authors: Column, institutions: Column, topics: Column, source: Column) -> Column:
    """The names of a record's shortcomings, as an array."""
    many = F.size(split_list(source)) > 1
    checks = [
        (~present(doi), "missing_doi"), (year.isNull(), "missing_year"), (citations.isNull(), "missing_citations"), (is_oa.isNull(), "unknown_open_access"),
        (~present(authors), "missing_authors"), (~present(institutions), "missing_institutions"), (~present(topics), "missing_topics"), (many, "multiple_sources"),
    ]
    return F.array_compact(F.array(*(F.when(cond, name) for cond, name in checks)))
