"""Record files: CSV, JSON, JSON lines, XML, Excel, Parquet, and unions of several sources."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings that hide the format's own.
_PACKED = (".gz", ".bz2", ".zip", ".xz")


def read_csv(spark: SparkSession, path: str, separator: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """All columns as text; quoted line feeds and doubled quotes are read as written; no value becomes null, not even an empty one."""
    rows = spark.read.options(header=True, multiLine=True, sep=separator, encoding=encoding, quote='"', escape='"').csv(path)
    return rows.na.fill("")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON document: an array of them, or an object with them under records, publications or data."""
    rows = spark.read.option("multiLine", True).json(path)
    for name in ("records", "publications", "data"):
        if name in rows.columns and dict(rows.dtypes)[name].startswith("array<struct"):
            return rows.select(F.explode(name).alias("_r")).select("_r.*")
    return rows


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_xml(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row for each element named ``tag``; its children are the columns."""
    return spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).load(path)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 0) -> DataFrame:
    """A sheet as text columns. A workbook is one file of bounded size; it is read on the driver."""
    import pandas as pd

    rows = pd.read_excel(path, sheet_name=sheet, header=header, dtype=str)
    return spark.createDataFrame(rows.astype(object).where(rows.notna(), None))


def format_of(path: str) -> str:
    name = path.lower()
    while name.endswith(_PACKED):
        name = os.path.splitext(name)[0]
    kind = os.path.splitext(name)[1].removeprefix(".")
    kinds = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "xml": "xml", "xlsx": "excel", "parquet": "parquet"}
    if kind not in kinds:
        raise ValueError(f"no reader for {path}")
    return kinds[kind]


def load(spark: SparkSession, path: str, required: tuple[str, ...] = (), **options) -> DataFrame:
    """Reads a file by its ending; missing required columns are an error."""
    kind = format_of(path)
    if kind == "parquet":
        rows = spark.read.parquet(path)
    else:
        rows = {"csv": read_csv, "json": read_json, "jsonl": read_jsonl, "xml": read_xml, "excel": read_excel}[kind](spark, path, **options)
    missing = [c for c in required if c not in rows.columns]
    if missing:
        raise ValueError(f"{path} has no {', '.join(missing)}")
    return rows


def union_sources(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of several sources by column name, tagged with the source's name and number."""
    tagged = [rows.withColumns({"_source": F.lit(name), "_source_index": F.lit(k)}) for k, (name, rows) in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


#: The fields of a publication record in the exchange schema that mappings may fill.
STANDARD = ("title", "authors", "publication_year", "doi", "institutions", "countries", "journal", "publisher", "abstract", "keywords", "citation_count", "source_record_id")


def map_columns(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns renamed to the standard fields; what is left over goes into a map of texts."""
    known = {mapping.get(c, c): c for c in rows.columns if mapping.get(c, c) in STANDARD}
    rest = [c for c in rows.columns if c not in known.values()]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    extra = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return rows.select(*(F.col(known[c]).cast("string").alias(c) if c in known else F.lit(None).cast("string").alias(c) for c in STANDARD), extra.alias("source_specific_metadata"))
