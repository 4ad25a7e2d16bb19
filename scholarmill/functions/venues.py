"""Column expressions for venues, affiliations and people's names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import split_list

# Words of a trailing bracket that name a publisher or host, kinds of venues by words (the first that fits),
# words of journals, sub-units that lead an affiliation, and domains of free mail.
ORGANISATIONS = (
    "university", "universite", "universidad", "publisher", "publishing", "press", "ltd", "inc", "llc", "gmbh", "society",
    "association", "organization", "organisation", "foundation", "laboratory", "cern", "company", "group", "elsevier",
    "springer", "wiley", "taylor", "francis", "sage", "college", "school", "academy", "council", "centre for", "center for", "part of",
)
VENUE_KINDS = {
    "preprint_server": ("arxiv", "biorxiv", "medrxiv", "chemrxiv", "psyarxiv", "techrxiv", "preprints.org", "research square", "ssrn", "social science research network", "authorea", "osf preprints"),
    "data_repository": ("zenodo", "figshare", "dryad", "archaeology data service", "data service", "cgspace", "dataverse"),
    "institutional_repository": ("repository", "research online", "eprints", "institutional repository", "profiles and research", "ssoar"),
    "aggregator": ("hal (le centre", "communication scientifique directe", "pubmed", "europe pmc", "researchgate", "semantic scholar"),
    "conference": ("conference", "symposium", "workshop", "congress"),
    "book_series": ("ebooks", "e-books", "ebook series", "book series"),
}
JOURNAL_WORDS = ("journal", "review", "letters", "proceedings", "bulletin", "annals", "transactions", "quarterly", "reports", "archives", "acta", "studies")
SUBUNIT = r"(?i)^(?:the\s+)?(?:department|dept\.?|faculty|division|unit|laboratory|lab|section|chair|clinic|ward|library)\b"
FREE_MAIL = (
    "gmail.com", "googlemail.com", "yahoo.com", "yahoo.co.uk", "yahoo.co.in", "hotmail.com", "outlook.com", "live.com",
    "msn.com", "icloud.com", "me.com", "aol.com", "proton.me", "protonmail.com", "gmx.com", "mail.com", "yandex.com", "zoho.com",
)


def _any(c: Column, words: tuple[str, ...]) -> Column:
    """Whether the text holds one of the words, be it within another word."""
    return c.rlike("|".join(w.replace(".", r"\.").replace("(", r"\(") for w in words))


def venue_name(c: Column) -> Column:
    """A venue's name with single spaces and without quotes and punctuation around it; null for nothing."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"\s+", " "), r"^[\s\"'.,;]+|[\s\"'.,;]+$", "")
    return F.when(~F.lower(t).isin("", "nan"), t)


def without_publisher(c: Column) -> Column:
    """A name without the bracket at its end, where that repeats the name or names a publisher; others belong to the name."""
    pattern = r"^(.*?)\s*\(([^()]*)\)\s*$"
    short, inner = (F.trim(F.regexp_extract(c, pattern, k)) for k in (1, 2))
    drop = (short != "") & (inner != "") & ((F.lower(inner) == F.lower(short)) | _any(F.lower(inner), ORGANISATIONS))
    return F.when(drop, short).otherwise(c)


def venue_kind(name: Column, has_issn: Column) -> Column:
    """The platform that a venue's name gives away, else journal or another venue; unknown without a name."""
    low = F.lower(name)
    kind = F.when(name.isNull(), "unknown")
    for label, words in VENUE_KINDS.items():
        kind = kind.when(_any(low, words), label)
    return kind.when(has_issn | _any(low, JOURNAL_WORDS), "journal").otherwise("other_venue")


def affiliation_parts(c: Column, countries: dict[str, str]) -> Column:
    """A struct of the institutions and the country codes that an affiliation text names.

    Parts between semicolons lose sub-units before a parent and a country after the last comma; a country within a name stays.
    """
    known = sorted(countries.items(), key=lambda x: (-len(x[0]), x[0]))

    def name_of(part: Column) -> Column:
        pieces = F.filter(F.transform(F.split(part, ","), lambda s: F.trim(s)), lambda s: s != "")
        own = F.array_position(F.transform(pieces, lambda s: s.rlike(SUBUNIT)), False)
        start = F.when(own > 0, own).otherwise(F.greatest(F.size(pieces), F.lit(1))).cast("int")
        joined = F.array_join(F.slice(pieces, start, F.size(pieces)), ", ")
        return F.trim(F.regexp_replace(joined, r"(?i),\s*(" + "|".join(n for n, _ in known) + r")\s*$", ""))

    def codes_of(part: Column) -> Column:
        plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(part), "[^a-z ]+", " "), F.lit(" "))
        return F.array_compact(F.array(*(F.when(F.contains(plain, F.lit(f" {n} ")), F.lit(code)) for n, code in known)))

    parts = split_list(c)
    names = F.array_distinct(F.filter(F.transform(parts, name_of), lambda n: n != ""))
    return F.struct(names.alias("institutions"), F.array_distinct(F.flatten(F.transform(parts, codes_of))).alias("countries"))


def name_tokens(c: Column) -> Column:
    """Lower-case parts of a name; ``Surname, Given`` is turned around. Accents are left to the caller."""
    turned = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^([^,]*),(.*)$", "$2 $1")
    return F.regexp_extract_all(turned, F.lit(r"(\p{L}+)"), F.lit(1))


def name_match(left: Column, right: Column) -> Column:
    """``exact``, ``initials`` or ``none``: last parts must agree, and the initials of the shorter name be among the other's.

    The left name is also tried with its first part as its last.
    """
    initials = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x: F.substring(x, 1, 1))

    def rank(a: Column, b: Column) -> Column:
        within = lambda x, y: F.size(F.array_except(x, y)) == 0
        some = F.when(F.size(a) <= F.size(b), within(initials(a), initials(b))).otherwise(within(initials(b), initials(a)))
        apart = (F.size(a) == 0) | (F.size(b) == 0) | (F.try_element_at(a, F.lit(-1)) != F.try_element_at(b, F.lit(-1)))
        return F.when(apart, 0).when(a == b, 2).when((F.size(a) == 1) | (F.size(b) == 1) | some, 1).otherwise(0)

    a, b = name_tokens(left), name_tokens(right)
    turned = F.concat(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.slice(a, 1, 1))
    return F.element_at(F.array(F.lit("none"), F.lit("initials"), F.lit("exact")), F.greatest(rank(a, b), rank(turned, b)) + 1)


def mail_kind(c: Column) -> Column:
    """What the domain of an address says: unknown, free_webmail, academic, of the country (``.lk``) or other."""
    text = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    domain = F.when(F.contains(text, F.lit("@")), F.substring_index(text, "@", -1)).otherwise("")
    academic = F.contains(F.concat(F.lit("."), domain, F.lit(".")), F.lit(".ac.")) | F.endswith(domain, F.lit(".edu"))
    return F.when(domain == "", "unknown").when(domain.isin(*FREE_MAIL), "free_webmail").when(academic, "academic").when(F.endswith(domain, F.lit(".lk")), "sri_lankan_organisation").otherwise("other")


def page_range(first: Column, last: Column) -> Column:
    """``first-last``, or the one that is there."""
    a, b = (F.trim(F.coalesce(x.cast("string"), F.lit(""))) for x in (first, last))
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("-"), b)).when(a != "", a).otherwise(b)
