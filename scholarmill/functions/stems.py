"""The published English stemming rules (second version of Porter's) as column functions, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a search leaves out.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()

#: Words with a stem of their own.
EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
#: Words that stay as they are after the plural is gone.
SETTLED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
#: Endings and what takes their place, the region they must stand in, and what must stand before some of them.
ENDINGS = (
    ({"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}, "r1", {"ogi": "l", "li": "[cdeghkmnrt]"}),
    ({"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}, "r1", {}),
    ({"al": "", "ance": "", "ence": "", "er": "", "ic": "", "able": "", "ible": "", "ant": "", "ement": "", "ment": "", "ent": "", "ism": "", "ate": "", "iti": "", "ous": "", "ive": "", "ize": "", "ion": ""}, "r2", {"ion": "[st]"}),
)
_VOWEL, _OTHER = "[aeiouy]", "[^aeiouy]"
_FIRST = f"^(gener|commun|arsen|{_OTHER}*{_VOWEL}+{_OTHER})"
_NEXT = f"^{_OTHER}*{_VOWEL}+{_OTHER}"
_SHORT = f"({_OTHER}{_VOWEL}[^aeiouywxY]|^{_VOWEL}{_OTHER})$"
_DOUBLE = "(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"


def _less(w: Column, n) -> Column:
    """A word without its last letters."""
    return F.substring(w, F.lit(1), F.greatest(F.length(w) - n, F.lit(0)))


def _region(w: Column, pattern: str, start: Column) -> Column:
    """Where the part after the first vowels and one other letter begins, looked for from ``start``."""
    found = F.regexp_extract(F.substring(w, start + 1, F.length(w)), pattern, 0)
    return F.when(found == "", F.length(w)).otherwise(start + F.length(found))


def with_stems(rows: DataFrame, column: str = "word", name: str = "stem") -> DataFrame:
    """``rows`` with the English stem of a column of lower-case words; null stays null, other scripts stay as they are."""
    kept = rows.columns
    w = F.col("_w")
    marked = F.regexp_replace(F.regexp_replace(F.col(column), "^y", "Y"), "([aeiouy])y", "$1Y")
    out = rows.withColumn("_w", marked).withColumn("_r1", _region(w, _FIRST, F.lit(0))).withColumn("_r2", _region(w, _NEXT, F.col("_r1")))
    end = F.regexp_extract(w, "(sses|ied|ies|us|ss|s)$", 1)
    plural = (
        F.when(end == "sses", _less(w, 2))
        .when(end.isin("ied", "ies"), F.when(F.length(w) > 4, _less(w, 2)).otherwise(_less(w, 1)))
        .when((end == "s") & _less(w, 2).rlike(_VOWEL), _less(w, 1))
        .otherwise(w)
    )
    out = out.withColumn("_w", plural).withColumn("_plural", w)
    end = F.regexp_extract(w, "(eedly|ingly|edly|eed|ing|ed)$", 1)
    part = _less(w, F.length(end))
    cut = end.isin("ingly", "edly", "ing", "ed") & part.rlike(_VOWEL)
    out = out.withColumn("_cut", cut).withColumn("_w", F.when(end.isin("eed", "eedly") & (F.length(part) >= F.col("_r1")), F.concat(part, F.lit("ee"))).when(F.col("_cut"), part).otherwise(w))
    brief = w.rlike(_SHORT) & (F.col("_r1") >= F.length(w))
    out = out.withColumn("_w", F.when(~F.col("_cut"), w).when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike(_DOUBLE), _less(w, 1)).when(brief, F.concat(w, F.lit("e"))).otherwise(w))
    out = out.withColumn("_w", F.when(w.rlike(f"^.+{_OTHER}[yY]$"), F.concat(_less(w, 1), F.lit("i"))).otherwise(w))
    for endings, region, before in ENDINGS:
        end = F.regexp_extract(w, f"({'|'.join(sorted(endings, key=len, reverse=True))})$", 1)
        out = out.withColumn("_end", end).withColumn("_part", _less(w, F.length("_end")))
        new = None
        for suffix, other in endings.items():
            must = F.col("_end") == suffix
            if suffix in before:
                must = must & F.col("_part").rlike(before[suffix] + "$")
            if suffix == "ative":
                must = must & (F.length("_part") >= F.col("_r2"))
            to = F.concat("_part", F.lit(other))
            new = F.when(must, to) if new is None else new.when(must, to)
        out = out.withColumn("_w", F.when(F.length("_part") >= F.col(f"_{region}"), new.otherwise(w)).otherwise(w))
    part = _less(w, 1)
    gone = (w.rlike("e$") & ((F.length(part) >= F.col("_r2")) | ((F.length(part) >= F.col("_r1")) & ~part.rlike(_SHORT)))) | (w.rlike("ll$") & (F.length(part) >= F.col("_r2")))
    out = out.withColumn("_w", F.regexp_replace(F.when(gone, part).otherwise(w), "Y", "y"))
    known = None
    for word, stem in EXCEPTIONS.items():
        known = F.when(F.col(column) == word, stem) if known is None else known.when(F.col(column) == word, stem)
    plain = F.when(F.length(column) <= 2, F.col(column)).when(F.col("_plural").isin(*SETTLED), F.col("_plural")).otherwise(w)
    return out.withColumn(name, F.coalesce(known, plain)).select(*kept, name)


def stem_sql(source: str, column: str = "word") -> str:
    """WITH entries that end in ``stemmed(word, stem)`` for the words of a table of DuckDB."""
    less = lambda w, n: f"left({w}, greatest(length({w}) - {n}, 0))"
    region = lambda p, s: f"CASE WHEN regexp_matches(substr(w, {s} + 1), '{p}') THEN {s} + length(regexp_extract(substr(w, {s} + 1), '{p}')) ELSE length(w) END"
    parts = [
        f"st0 AS (SELECT {column} AS word, regexp_replace(regexp_replace({column}, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM {source})",
        f"st1 AS (SELECT *, {region(_FIRST, '0')} AS r1 FROM st0)",
        f"st2 AS (SELECT *, {region(_NEXT, 'r1')} AS r2, regexp_extract(w, '(sses|ied|ies|us|ss|s)$', 1) AS e FROM st1)",
        f"st3 AS (SELECT word, r1, r2, CASE WHEN e = 'sses' THEN {less('w', 2)} WHEN e IN ('ied', 'ies') THEN CASE WHEN length(w) > 4 THEN {less('w', 2)} ELSE {less('w', 1)} END WHEN e = 's' AND regexp_matches({less('w', 2)}, '{_VOWEL}') THEN {less('w', 1)} ELSE w END AS w FROM st2)",
        "st4 AS (SELECT *, w AS plural, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$', 1) AS e FROM st3)",
        "st5 AS (SELECT *, left(w, length(w) - length(e)) AS p FROM st4)",
        f"st6 AS (SELECT word, r1, r2, plural, e IN ('ingly', 'edly', 'ing', 'ed') AND regexp_matches(p, '{_VOWEL}') AS cut, CASE WHEN e IN ('eed', 'eedly') AND length(p) >= r1 THEN p || 'ee' WHEN e IN ('ingly', 'edly', 'ing', 'ed') AND regexp_matches(p, '{_VOWEL}') THEN p ELSE w END AS w FROM st5)",
        f"st7 AS (SELECT word, r1, r2, plural, CASE WHEN NOT cut THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN regexp_matches(w, '{_DOUBLE}') THEN {less('w', 1)} WHEN regexp_matches(w, '{_SHORT}') AND r1 >= length(w) THEN w || 'e' ELSE w END AS w FROM st6)",
        f"st8 AS (SELECT word, r1, r2, plural, CASE WHEN regexp_matches(w, '^.+{_OTHER}[yY]$') THEN {less('w', 1)} || 'i' ELSE w END AS w FROM st7)",
    ]
    last = "st8"
    for k, (endings, area, before) in enumerate(ENDINGS):
        cases = []
        for suffix, other in endings.items():
            more = f" AND regexp_matches(p, '{before[suffix]}$')" if suffix in before else " AND length(p) >= r2" if suffix == "ative" else ""
            cases.append(f"WHEN e = '{suffix}'{more} THEN p || '{other}'")
        listed = "|".join(sorted(endings, key=len, reverse=True))
        parts.append(f"en{k}a AS (SELECT *, regexp_extract(w, '({listed})$', 1) AS e FROM {last})")
        parts.append(f"en{k}b AS (SELECT *, left(w, length(w) - length(e)) AS p FROM en{k}a)")
        parts.append(f"en{k} AS (SELECT word, r1, r2, plural, CASE WHEN length(p) < {area} THEN w {' '.join(cases)} ELSE w END AS w FROM en{k}b)")
        last = f"en{k}"
    fixed = " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in EXCEPTIONS.items())
    settled = ", ".join(f"'{s}'" for s in SETTLED)
    p = less("w", 1)
    gone = f"(w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches({p}, '{_SHORT}')))) OR (w LIKE '%ll' AND length(w) - 1 >= r2)"
    parts.append(f"stemmed AS (SELECT word, CASE {fixed} WHEN length(word) <= 2 THEN word WHEN plural IN ({settled}) THEN plural ELSE replace(CASE WHEN {gone} THEN {p} ELSE w END, 'Y', 'y') END AS stem FROM {last})")
    return ", ".join(parts)
