from pyspark.sql import functions as F

from scholarmill.functions import venues as V

from .test_functions import apply


def test_venue_names(spark):
    assert apply(spark, V.venue_name, [' "A  B.", ', "nan", " ", None]) == ["A B", None, None, None]
    assert apply(spark, V.without_publisher, ["arXiv (Cornell University)", "Science (Biology)", "X (x)", "(Press)", None]) == ["arXiv", "Science (Biology)", "X", "(Press)", None]
    names = ["medRxiv", "HAL (Le Centre pour)", "Acta X", "Some place", "Book Series Y", None]
    assert apply(spark, lambda c: V.venue_kind(c, F.lit(False)), names) == ["preprint_server", "aggregator", "journal", "other_venue", "book_series", "unknown"]
    assert apply(spark, lambda c: V.venue_kind(c, F.lit(True)), ["Some place"]) == ["journal"]


def test_affiliations(spark):
    countries = {"india": "IN", "sri lanka": "LK"}
    texts = ["Dept. of A, Faculty of B, Uni C, India; Uni C", "University of Sri Lanka", "Faculty of B", " ; ,", None]
    got = [(r.institutions, r.countries) for r in apply(spark, lambda c: V.affiliation_parts(c, countries), texts)]
    assert got == [(["Uni C"], ["IN"]), (["University of Sri Lanka"], ["LK"]), (["Faculty of B"], []), ([], []), ([], [])]


def test_name_match(spark):
    pairs = ["Perera A|Anil Perera", "Perera, Anil|anil perera", "A. B. Perera|Bimal Perera", "K Perera|Anil Perera", "Perera|Anil Perera", "|Anil", "Anil Perera|", "Anil Silva|Anil Perera", "Anil Perera|Perera Anil"]
    got = apply(spark, lambda c: V.name_match(F.split_part(c, F.lit("|"), F.lit(1)), F.split_part(c, F.lit("|"), F.lit(2))), pairs)
    assert got == ["initials", "exact", "initials", "none", "initials", "none", "none", "none", "exact"]
    assert apply(spark, lambda c: V.name_match(c, c), [None]) == ["none"]


def test_mail_and_pages(spark):
    assert apply(spark, V.mail_kind, ["a@Gmail.com", "a@x.ac.uk", "a@x.edu", "a@x.lk", "a@x.org", "a", None]) == ["free_webmail", "academic", "academic", "sri_lankan_organisation", "other", "unknown", "unknown"]
    assert apply(spark, lambda c: V.page_range(c, F.lit("9")), ["3", " ", None]) == ["3-9", "9", "9"]
    assert apply(spark, lambda c: V.page_range(c, F.lit(None)), ["3", None]) == ["3", ""]
