"""Filters of the publication queries: a dictionary of optional clauses becomes one Column."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import split_list

#: Columns of one value that are compared exactly (any of the values given).
EXACT = ("type", "primary_field", "publication_key", "doi")
#: Multi-value columns in which a value must occur as part of some item.
CONTAINS = ("authors", "institutions", "countries", "topics", "source_dataset")


def contains(column: Column, value: str) -> Column:
    """Substring without regard to case; ``%`` and ``_`` in the value keep their meaning as wildcards."""
    return column.ilike(f"%{value}%")


def _starting(term: str):
    return lambda w: F.startswith(w, F.lit(term))


def where(filters: dict[str, Any] | None) -> Column:
    """AND of the clauses given, OR within a list. An empty key list matches nothing; flags never match unknown values."""
    clauses: list[Column] = []
    for name, value in (filters or {}).items():
        if value is None:
            continue
        values = list(value) if isinstance(value, (list, tuple, set)) else [value]
        if name == "year_min":
            clauses.append(F.col("publication_year") >= value)
        elif name == "year_max":
            clauses.append(F.col("publication_year") <= value)
        elif name in ("is_oa", "has_doi"):
            got = F.col("is_oa") if name == "is_oa" else F.coalesce(F.trim("doi") != "", F.lit(False))
            clauses.append(got.eqNullSafe(F.lit(bool(value))))
        elif name == "min_citations":
            clauses.append(F.coalesce(F.col("citation_count"), F.lit(0)) >= value)
        elif name in EXACT:
            clauses.append(F.col(name).isin(*values) if values else F.lit(False))
        elif name in CONTAINS:
            clauses.append(reduce(Column.__or__, [contains(F.col(name), v) for v in values]) if values else F.lit(False))
        elif name == "q":
            searched = F.lower(F.concat_ws(" ", "title", "doi", "authors", "institutions", "topics"))
            words = F.split(searched, r"[^\p{L}\p{N}]+")
            clauses += [F.exists(words, _starting(t)) for t in str(value).lower().split()]
        else:
            raise ValueError(f"unknown filter {name}")
    return reduce(Column.__and__, clauses, F.lit(True))


def from_query(query: dict[str, str], first_year: int = 2016, last_year: int = 2026) -> dict[str, Any]:
    """Filters from the text of a query string: comma lists, numbers, yes and no, and years within what is covered."""
    out: dict[str, Any] = {}
    for name, text in query.items():
        if name in ("year_min", "year_max", "min_citations"):
            out[name] = int(text)
        elif name in ("is_oa", "has_doi"):
            word = text.strip().lower()
            if word not in ("true", "1", "yes", "false", "0", "no"):
                raise ValueError(f"{name} must be yes or no")
            out[name] = word in ("true", "1", "yes")
        elif name == "q":
            out[name] = text
        else:
            out[name] = [v.strip() for v in text.split(",") if v.strip()]
    out["year_min"], out["year_max"] = max(first_year, out.get("year_min", first_year)), min(last_year, out.get("year_max", last_year))
    if out["year_min"] > out["year_max"]:
        raise ValueError("year_min is after year_max")
    return out


def page(number: int, size: int, total: int) -> dict[str, int]:
    return {"page": number, "page_size": size, "total": total, "total_pages": -(-total // size)}


def items(column: str) -> Column:
    return F.explode(split_list(F.col(column)))
