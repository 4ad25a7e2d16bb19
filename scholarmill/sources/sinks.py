"""Sinks: exports as CSV, JSON lines and Parquet, and the bundle of one pipeline run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import split_list


def flat(rows: DataFrame) -> DataFrame:
    """Rows fit for CSV: arrays joined by ``; ``, structs and maps as JSON."""
    out = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(F.array_distinct(F.filter(c, lambda x: F.trim(x) != "")), "; ")
        elif kind.startswith(("array", "map", "struct")):
            c = F.to_json(c)
        out.append(c.alias(name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    flat(rows).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def export_bundle(records: DataFrame, folder: str, key: str = "publication_key") -> dict[str, DataFrame]:
    """Writes the records, one table of values and one of links for each list column, and a summary; returns them."""
    out = {"publications": records}
    for name, column in (("authors", "authors"), ("institutions", "institutions"), ("countries", "countries"), ("topics", "topics")):
        if column in records.columns:
            links = records.select(key, F.posexplode(split_list(F.col(column))).alias("position", "value")).withColumn("position", F.col("position") + 1)
            out[f"publication_{name}"] = links
            out[name] = links.groupBy("value").agg(F.count("*").alias("publications"))
    out["summary"] = records.agg(F.count("*").alias("publications"), F.countDistinct(key).alias("keys"))
    for name, rows in out.items():
        write_csv(rows, f"{folder}/{name}")
    return out
