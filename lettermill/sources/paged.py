"""Paged feeds as a Spark source: `spark.read.format("pages")` and `readStream`, after `register(spark)`.

A feed's pages are numbered from 0 and lie in folders `page_no=<n>` below its path, one or more files
each; any store that pyarrow opens by its address will do. Every input partition is a range of pages,
so a feed is read by as many tasks as it has ranges, and a page is a row (feed, page_no, body). As a
stream, the offset is the number of pages read: a later run begins at the first page it has not read,
and a page that lies behind a gap waits until the gap is filled. A limit on page_no in a filter, or
the option max_pages, keeps pages from being read at all.

`reached` applies the rules by which a collector stops turning pages, after they are read in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "feed string, page_no int, body string"
#: Pages of a range at least, and ranges at most, unless pages_a_partition says otherwise.
PAGES_A_PARTITION, MOST_RANGES = 16, 256


class _Range(InputPartition):
    def __init__(self, numbers: Sequence[int]):
        super().__init__(tuple(numbers))


class _Folder:
    """The pages of one feed in a folder."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.feed = options.get("feed", self.path.rstrip("/").rpartition("/")[2])
        self.step = int(options["pages_a_partition"]) if options.get("pages_a_partition") else None
        self.limit = int(options["max_pages"]) if options.get("max_pages") else None

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if urlparse(self.path).scheme else (pafs.LocalFileSystem(), self.path)

    def numbers(self) -> list[int]:
        """The pages that have landed, within the limit."""
        store, root = self._open()
        found = store.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        pages = sorted(int(n) for i in found if i.type == pafs.FileType.Directory and i.base_name.startswith("page_no=") and (n := i.base_name[8:]).isdigit())
        return pages if self.limit is None else [n for n in pages if n < self.limit]

    def ranges(self, numbers: Sequence[int]) -> list[_Range]:
        # without pages there is one range of none, since a reader needs one
        step = self.step or max(PAGES_A_PARTITION, -(-len(numbers) // MOST_RANGES))
        return [_Range(numbers[i : i + step]) for i in range(0, len(numbers), step)] or [_Range(())]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, root = self._open()
        for n in partition.value:
            files = sorted(i.path for i in store.get_file_info(pafs.FileSelector(f"{root}/page_no={n}")) if i.type == pafs.FileType.File and i.base_name[0] not in "._")
            parts = []
            for path in files:
                with store.open_input_stream(path) as stream:
                    parts.append(stream.read())
            body = b"".join(parts).decode()
            yield pa.RecordBatch.from_pydict({"feed": [self.feed], "page_no": pa.array([n], pa.int32()), "body": [body]})


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)
        self.low, self.high = 0, None

    def pushFilters(self, filters):  # noqa: N802 - the interface's name
        """Bounds on page_no choose the pages; other filters go back to Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page_no",) or not isinstance(f, (LessThan, LessThanOrEqual, GreaterThan, GreaterThanOrEqual)):
                yield f
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                high = f.value + isinstance(f, LessThanOrEqual)
                self.high = high if self.high is None else min(self.high, high)
            else:
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))

    def partitions(self) -> list[_Range]:
        return self.folder.ranges([n for n in self.folder.numbers() if n >= self.low and (self.high is None or n < self.high)])

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"pages": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The number of pages that have landed without a gap."""
        numbers = self.folder.numbers()
        return {"pages": next((i for i, n in enumerate(numbers) if i != n), len(numbers))}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        return self.folder.ranges(range(start["pages"], end["pages"]))

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: pages stay where they landed."""


class Pages(DataSource):
    """Options: path, feed (default: the folder's name), pages_a_partition (default: 16, more in long feeds), max_pages."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let it take filters."""
    spark.dataSource.register(Pages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def reached(pages: DataFrame, ids: Column, full: int | None = None, page_col: str = "page_no", by: Sequence[str] = ("feed",)) -> DataFrame:
    """The pages that a collector of each feed would have read, turning them one by one.

    `ids` is an array column of a page's entries. The collector stops before a page without entries
    or a gap, and after one whose entries were all on earlier pages or are fewer than `full`. Only
    ids and page numbers are shuffled; the pages meet one number a feed.
    """
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    each = pages.select(*keys, F.col(page_col).alias("_n"), F.coalesce(ids, F.array().cast("array<string>")).alias("_ids"))
    first = each.select(*names, "_n", F.explode("_ids").alias("_id")).groupBy(*names, "_id").agg(F.min("_n").alias("_n")).groupBy(*names, "_n").agg(F.count(F.lit(1)).alias("_new"))
    sizes = each.groupBy(*names, "_n").agg(F.sum(F.size("_ids")).alias("_size"))
    same = F.lit(True)
    for k in (*names, "_n"):
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}"))
    joined = sizes.alias("s").join(first.alias("f"), same, "left").select(*[F.col(f"s.{k}").alias(k) for k in (*names, "_n")], "_size", F.coalesce("_new", F.lit(0)).alias("_new"))
    last = F.when(F.col("_size") == 0, F.col("_n") - 1).when((F.col("_new") == 0) | (F.col("_size") < (full or 0)), F.col("_n"))
    # before a gap, and at the end, there is a page that no next one follows
    follows = F.col("a._n") + 1 == F.col("b._n")
    for k in names:
        follows = follows & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    alone = sizes.alias("a").join(sizes.select(*names, "_n").alias("b"), follows, "left_anti")
    stops = joined.select(*names, last.alias("_last")).unionByName(alone.select(*names, F.col("_n").alias("_last")))
    ends = stops.groupBy(*[F.col(k).alias(f"e{k}") for k in names]).agg(F.min("_last").alias("_end"))
    fits = F.col(page_col) <= F.col("_end")
    for c, k in zip(by, names, strict=True):
        fits = fits & F.col(c).eqNullSafe(F.col(f"e{k}"))
    return pages.join(ends, fits, "left_semi")
