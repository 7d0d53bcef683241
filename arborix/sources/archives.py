"""JSON archives, paged lists and settings."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def archive(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*_data.json") -> DataFrame:
    """All matching JSON files below a folder with run_stamp (name of the folder) and sequence (first five digits of the name)."""
    raw = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).json(folder)
    file = F.col("_metadata.file_path")
    parts = F.split(file, "/")
    return raw.select("*", F.element_at(parts, -2).alias("run_stamp"), F.try_to_number(F.nullif(F.regexp_extract(F.element_at(parts, -1), r"^(\d{5})", 1), F.lit("")), F.lit("99999")).cast("int").alias("sequence"))


def bucket_label(number, outer: int = 1000, inner: int = 100):
    """The folder of a number in an archive: multiples of outer and inner below it, as "1000/1100"."""
    return F.concat_ws("/", (F.floor(number / outer) * outer).cast("string"), (F.floor(number / inner) * inner).cast("string"))


class PagedSource(DataSource):
    """A list served in pages as a Spark data source, one partition a page, or several where there are very many pages.

    Options: page_size, most_partitions, and total; without a total, `probe` is asked for it once. `fetch` is set on a
    subclass and gets (start, count). A short page is taken as it is, and so is an empty one.
    """

    fetch: Callable[[int, int], list[tuple]]
    probe: Callable[[], int]
    ddl: str

    @classmethod
    def name(cls) -> str:
        return "arborix_paged"

    def schema(self) -> str:
        return self.ddl

    def reader(self, schema: StructType) -> DataSourceReader:
        total = int(self.options["total"]) if "total" in self.options else type(self).probe()
        return _PagedReader(total, int(self.options.get("page_size", "100")), type(self).fetch, int(self.options.get("most_partitions", "10000")))


class _PagedReader(DataSourceReader):
    def __init__(self, total: int, size: int, fetch: Callable[[int, int], list[tuple]], most: int) -> None:
        self.total, self.size, self.fetch, self.most = max(0, total), max(1, size), fetch, max(1, most)

    def partitions(self) -> list[InputPartition]:
        pages = -(-self.total // self.size)
        each = max(1, -(-pages // self.most))
        return [InputPartition((i, min(pages, i + each))) for i in range(0, pages, each)] or [InputPartition((0, 0))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for page in range(*partition.value):
            yield from self.fetch(page * self.size, min(self.size, self.total - page * self.size))


@dataclass(frozen=True)
class Settings:
    """Intervals and limits, from the environment where set, within bounds."""

    dashboard_seconds: int = 60
    groups_seconds: int = 120
    near_seconds: int = 300
    min_similarity: float = 0.8

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ, prefix: str = "ARBORIX_") -> Settings:
        def number(name: str, default: float, low: float, high: float = float("inf")) -> float:
            try:
                return min(max(float(env.get(prefix + name, default)), low), high)
            except ValueError:
                return default

        return cls(int(number("DASHBOARD_SECONDS", 60, 5)), int(number("GROUPS_SECONDS", 120, 30)), int(number("NEAR_SECONDS", 300, 30)), number("MIN_SIMILARITY", 0.8, 0.05, 1.0))
