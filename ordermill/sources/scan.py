"""A paged scan of the catalogue as a data source of its own.

The catalogue is read by ranges of (offset, limit): every range is one partition, so ranges are read side by side and a
range that fails is the only one read again. As a stream the scan goes on where its checkpoint stands: an offset counts the records
passed, and is kept only once its batch is done. The scan never passes a page that has not landed yet. With a ``progress`` file a
batch covers a bounded number of pages; without one, everything that has landed, since Spark does not tell a source
where a restarted stream stands.

Pages lie as they were landed, in folders ``start=<offset>`` of JSON text, in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ordermill import schemas

# The source travels to the workers as code, so they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "catalogue_scan"
FOLDER = "start="

# Fixed value: records per page.
PAGE_SIZE = 100


@dataclass
class PageRange(InputPartition):
    """``limit`` records from ``offset`` on."""

    offset: int
    limit: int


def store_of(path: str):
    """Arrow's file system of a path, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if ":/" in path else f"file://{path}")


class LandedPages:
    """Pages by offset; options ``path``, ``page_size``, ``attempts`` and ``wait`` (seconds before the second attempt)."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.page_size = int(options.get("page_size", PAGE_SIZE))
        self.attempts = int(options.get("attempts", 4))
        self.wait = float(options.get("wait", 1.0))

    def end(self, start: int = 0) -> int:
        """The offset up to which all pages from ``start`` on have landed."""
        from pyarrow.fs import FileSelector

        store, root = store_of(self.path)
        names = (info.base_name for info in store.get_file_info(FileSelector(root, allow_not_found=True)))
        there = {int(name[len(FOLDER):]) for name in names if name.startswith(FOLDER)}
        while start in there:
            start += self.page_size
        return start

    def fetch(self, offset: int) -> list[str]:
        """The lines of one page: one JSON text, as a rule."""
        from pyarrow.fs import FileSelector

        store, root = store_of(self.path)
        lines = []
        for info in store.get_file_info(FileSelector(f"{root}/{FOLDER}{offset}")):
            if info.is_file and not info.base_name.startswith(("_", ".")):
                with store.open_input_stream(info.path) as file:
                    lines += file.read().decode("utf-8", "replace").splitlines()
        return lines

    def page(self, offset: int) -> list[str]:
        """``fetch`` with further attempts, waiting twice as long each time."""
        for attempt in range(1, self.attempts + 1):
            try:
                return self.fetch(offset)
            except OSError:
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait * 2 ** (attempt - 1))
        raise ValueError("attempts must be positive")

    def records(self, part: PageRange) -> Iterator[tuple[int, str]]:
        for offset in range(part.offset, part.offset + part.limit, self.page_size):
            for line in self.page(offset):
                yield offset, line

    def ranges(self, start: int, end: int, pages: int) -> list[PageRange]:
        """Ranges of so many pages each; one without records if there is nothing to read."""
        step = pages * self.page_size
        return [PageRange(at, min(step, end - at)) for at in range(start, end, step)] or [PageRange(start, 0)]


class ScanReader(DataSourceReader):
    def __init__(self, pages: LandedPages, per_range: int):
        self.pages, self.per_range = pages, per_range

    def partitions(self) -> list[PageRange]:
        return self.pages.ranges(0, self.pages.end(), self.per_range)

    def read(self, partition: PageRange) -> Iterator[tuple[int, str]]:
        return self.pages.records(partition)


class ScanStreamReader(DataSourceStreamReader):
    """Offsets are ``{"records": n}``. ``progress`` holds the last one that a batch was planned up to, so offers never fall behind it."""

    def __init__(self, pages: LandedPages, per_range: int, per_batch: int, progress: str | None):
        self.pages, self.per_range, self.per_batch, self.progress = pages, per_range, per_batch, progress
        self.offered = None

    def initialOffset(self) -> dict:
        return {"records": 0}

    def latestOffset(self) -> dict:
        if self.progress is None:
            return {"records": self.pages.end()}
        if self.offered is None:
            self.offered = self._planned()
        self.offered = min(self.offered + self.per_batch * self.pages.page_size, self.pages.end(self.offered))
        return {"records": self.offered}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        if self.progress is not None and end["records"] > self._planned():
            store, file = store_of(self.progress)
            with store.open_output_stream(file) as out:
                out.write(str(end["records"]).encode())
        return self.pages.ranges(start["records"], end["records"], self.per_range)

    def _planned(self) -> int:
        store, file = store_of(self.progress)
        if not store.get_file_info(file).is_file:
            return 0
        with store.open_input_stream(file) as text:
            return int(text.read())

    def read(self, partition: PageRange) -> Iterator[tuple[int, str]]:
        return self.pages.records(partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: pages stay where they landed."""


class CatalogueScan(DataSource):
    """Options, beside those of the pages: ``pages_per_range`` and, for streams, ``progress`` and ``pages_per_batch``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "start BIGINT, value STRING"

    def _pages(self) -> LandedPages:
        return LandedPages(self.options)

    def _number(self, name: str, default: int) -> int:
        return int(self.options.get(name, default))

    def reader(self, schema) -> ScanReader:
        return ScanReader(self._pages(), self._number("pages_per_range", 10))

    def streamReader(self, schema) -> ScanStreamReader:
        return ScanStreamReader(self._pages(), self._number("pages_per_range", 10), self._number("pages_per_batch", 1000), self.options.get("progress"))


def scanned_pages(spark: SparkSession, path: str, stream: bool = False, source: type[CatalogueScan] = CatalogueScan, **options) -> DataFrame:
    """Pages in the shape of ``read_pages``: ``start``, ``docs`` and the text of those that cannot be read."""
    spark.dataSource.register(source)
    reader = spark.readStream if stream else spark.read
    raw = reader.format(source.name()).options(path=path, **options).load()
    shape = f"docs ARRAY<{schemas.CATALOGUE_DOC}>, _corrupt_record STRING"
    page = F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.select("start", F.explode(F.array(page)).alias("_page")).select("start", "_page.docs", "_page._corrupt_record")
