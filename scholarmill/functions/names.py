"""Names and titles that need Python's Unicode and HTML tables: Arrow functions over columns."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)
_META = re.compile(r"<meta\b[^>]*\bname=[\"'](citation_[a-z_]+)[\"'][^>]*\bcontent=[\"']([^\"']*)", re.I)
# Fixed values
_PARTICLES = frozenset("de del della di da das dos du van von der den ter ten le la el al bin ibn bint abu mac mc st saint".split())
_SUFFIXES = frozenset("jr jnr sr snr ii iii iv v phd ph d dphil mphil msc bsc ma mba md mbbs bds dvm frcp frcs facs fracp fcp mrcp dsc dr eng esq emeritus retd".split())
_HONORIFICS = frozenset("prof professor dr doctor mr mrs ms miss rev sir eng ir hon".split())


def clean_title(value: str | None) -> str | None:
    """Entities decoded (up to three times), markup taken out, spaces collapsed; subscripts stay attached."""
    if value is None:
        return None
    for _ in range(3):
        decoded = html.unescape(value)
        if decoded == value:
            break
        value = decoded
    value = re.sub(r"</?(?:sub|sup|i|b|em|strong)\b[^>]*>", "", value, flags=re.I)
    value = re.sub(r"<[^<>]*>", " ", value)
    value = re.sub(r"\s+([,.;:!?])", r"\1", " ".join(value.split()))
    return value or None


class _Bare(dict):
    """Letters to themselves and combining marks to nothing, filled in as they occur."""

    def __missing__(self, c: int) -> int | None:
        self[c] = None if unicodedata.combining(chr(c)) else c
        return self[c]


_BARE = _Bare()


def fold(value: str) -> str:
    """Lower case without accents."""
    return (value if value.isascii() else unicodedata.normalize("NFKD", value).translate(_BARE)).casefold()


def parse_name(value: str | None) -> dict:
    """Surname and given tokens of ``Given Surname``, ``Surname, Given`` or ``Surname GI``; honorifics and suffixes go."""
    text = " ".join((value or "").replace(".", ". ").split())
    before, comma, after = text.partition(",")
    plain = [w for w in re.findall(r"[^\s,.]+", fold(before)) if w not in _HONORIFICS]
    rest = [w for w in re.findall(r"[^\s,.]+", fold(after)) if w not in _HONORIFICS and w not in _SUFFIXES]
    plain = [w for w in plain if w not in _SUFFIXES] or plain
    if comma and rest:
        return {"surname": " ".join(plain), "given": rest}
    last = re.findall(r"[^\s,.]+", before)
    if len(plain) > 1 and len(last) > 1 and last[-1].isupper() and len(last[-1]) <= 3 and not last[0].isupper():
        return {"surname": " ".join(plain[:-1]), "given": list(plain[-1])}
    at = len(plain) - 1
    while at > 0 and plain[at - 1] in _PARTICLES:
        at -= 1
    return {"surname": " ".join(plain[at:]) if plain else "", "given": plain[:at] if plain else []}


def compatible(a: list[str], b: list[str]) -> bool:
    """Whether two lists of given names can be one person's: initials agree with names, in order."""
    return all(x == y or (1 in (len(x), len(y)) and x[0] == y[0]) for x, y in zip(a, b, strict=False))


NAME = T.StructType([T.StructField("surname", T.StringType()), T.StructField("given", T.ArrayType(T.StringType()))])


@F.pandas_udf(NAME)
def name_parts(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(n) for n in names], columns=["surname", "given"])


@F.pandas_udf(T.StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Lower case without accents."""
    return texts.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def title_clean(titles: pd.Series) -> pd.Series:
    return titles.map(clean_title)


def parsed_names(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("_n", name_parts(F.col(column))).select(column, "_n.surname", F.array_join("_n.given", " ").alias("given"))


def html_titles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, title, n_meta): the page's title, cleaned, and how many citation tags it has."""

    def run(batches):
        for pdf in batches:
            found = [_TITLE.search(h or "") for h in pdf[html_col]]
            yield pd.DataFrame({id_col: pdf[id_col], "title": [clean_title(m[1]) if m else None for m in found], "n_meta": [len(_META.findall(h or "")) for h in pdf[html_col]]})

    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} long, title string, n_meta long")
