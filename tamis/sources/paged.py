"""Pages linked by tokens, as listings of remote services give them, read from a folder of page files (SRC14).

    spark.dataSource.register(PagedSource)
    spark.read.format("pages").schema("name string, ...").option("path", folder).load()

A page is a JSON file <token>.json with "items", a list of records, and "next", the token of the page after it, if any. The
first page's token is an option (`first`, by default "first"). Tokens are followed on the driver, since each is only told by
the page before; the pages themselves are read one a task. A page that links back to an earlier one raises.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Page(InputPartition):
    def __init__(self, path: str):
        self.path = path


def local(path: str) -> Path:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"not a mounted folder: {path}")
    return Path("/" + path.removeprefix("file:").lstrip("/"))


class PagedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Page]:
        folder, token, pages = local(self.options["path"]), self.options.get("first", "first"), {}
        while token:
            if token in pages:
                raise ValueError(f"page {token} comes twice")
            path = folder / f"{token}.json"
            pages[token] = Page(str(path))
            token = json.loads(path.read_text("utf-8")).get("next")
        return list(pages.values())

    def read(self, partition: Page) -> Iterator[tuple]:
        for item in json.loads(Path(partition.path).read_text("utf-8")).get("items") or []:
            yield tuple(item.get(n) for n in self.schema.names)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


def write_pages(df: DataFrame, folder: str, size: int, *order: str) -> int:
    """Bounded tables as pages, for tests and file drops; returns how many."""
    at = local(folder)
    at.mkdir(parents=True, exist_ok=True)
    rows = [json.loads(r["j"]) for r in df.orderBy(*order).select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()]
    parts = [rows[i : i + size] for i in range(0, len(rows), size)] or [[]]
    names = ["first", *(f"page-{i}" for i in range(1, len(parts)))]
    for i, (name, part) in enumerate(zip(names, parts, strict=True)):
        (at / f"{name}.json").write_text(json.dumps({"items": part, "next": names[i + 1] if i + 1 < len(names) else None}), "utf-8")
    return len(parts)


def available(df: DataFrame, name: str, pattern: str, free: Column) -> DataFrame:
    """Rows whose name matches, those available first, then by name (FLT14)."""
    return df.where(F.col(name).rlike(pattern)).withColumn("available", F.coalesce(free, F.lit(False))).orderBy(F.col("available").desc(), name)
