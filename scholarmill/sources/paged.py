"""A data source for paged interfaces: page numbers, offsets, cursors, next links, or a single page.

``spark.read.format("paged").option("url", ...).schema(...)``: each URL is a partition, walked page by page on an
executor. A loader (any function text of URL -> parsed JSON, given by module and name) makes it independent of the
transport.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator
from typing import Any
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def load_json(url: str) -> Any:
    """The default loader."""
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as response:
        return json.load(response)


def at_path(payload: Any, path: str) -> Any:
    for name in filter(None, path.split(".")):
        payload = payload.get(name) if isinstance(payload, dict) else None
    return payload


def walk(url: str, kind: str, load: Callable[[str], Any], records: str = "", size: int = 100, cursor: str = "", most: int = 100_000) -> Iterator[dict]:
    """The records of all pages. A repeated cursor or link ends the walk, as does a page without records."""
    page, seen, at = 1, set(), url
    join = "&" if "?" in url else "?"
    if kind in ("page", "offset"):
        at = url + join + urlencode({"page": 1, "size": size} if kind == "page" else {"offset": 0, "limit": size})
    while at and at not in seen and page <= most:
        seen.add(at)
        payload = load(at)
        found = at_path(payload, records) if records else payload
        if not found:
            return
        yield from found
        page += 1
        if kind == "none":
            return
        if kind == "page":
            at = url + join + urlencode({"page": page, "size": size})
        elif kind == "offset":
            at = url + join + urlencode({"offset": (page - 1) * size, "limit": size})
        elif kind == "cursor":
            token = at_path(payload, cursor)
            at = url + join + urlencode({"cursor": token}) if token else ""
        elif kind == "next_link":
            at = at_path(payload, cursor) or ""
        else:
            raise ValueError(f"unknown kind of paging {kind}")


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "record string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, dict(self.options))


class PagedReader(DataSourceReader):
    def __init__(self, schema, options: dict[str, str]) -> None:
        self.fields, self.options = schema.fieldNames(), options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.options["url"].split("|")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        module, _, name = self.options.get("loader", "").rpartition(".")
        load = getattr(importlib.import_module(module), name) if module else load_json
        o = self.options
        for r in walk(partition.value, o.get("kind", "none"), load, o.get("records", ""), int(o.get("size", 100)), o.get("cursor", "")):
            if self.fields == ["record"]:
                yield (json.dumps(r, ensure_ascii=False),)
            else:
                yield tuple(None if r.get(f) is None else r[f] if isinstance(r[f], str) else json.dumps(r[f], ensure_ascii=False) for f in self.fields)
