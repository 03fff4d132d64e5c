"""SC18: a paginated archive as a data source: its partitions are ranges of pages, and only an empty page ends it.

A page is a folder `page=<n>` of files with an item, as JSON, on each line; pages are numbered from 0 without gaps. How many there are is
not told anywhere, and a short page is not the last one. So the driver looks at pages further and further away until one is
empty, and then for the first empty one between; a few dozen looks, whatever the archive's size. Tasks then read their ranges. An item that
moved to the next page while the archive was walked is there twice, and counts once.

An archive without pages has no items. Lines that are no JSON objects have null fields."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages that a task reads.
PAGES = 16


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PageArchive(DataSource):
    """Options: path, pages (how many pages a task reads)."""

    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return "page int, line int, item string"

    def reader(self, schema) -> "PageReader":
        return PageReader(self.options["path"], int(self.options.get("pages", PAGES)))


class PageReader(DataSourceReader):
    def __init__(self, path: str, pages: int):
        self.path, self.pages = path, pages

    def fetch(self, page: int) -> Iterator[str]:
        """The lines of a page; none if it isn't there."""
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        found = files.get_file_info(fs.FileSelector(f"{root}/page={page}", allow_not_found=True))
        for x in sorted((f for f in found if f.is_file and not f.base_name.startswith(("_", "."))), key=lambda f: f.path):
            with files.open_input_stream(x.path) as stream:
                yield from (line for line in stream.read().decode().split("\n") if line)

    def empty(self, page: int) -> bool:
        return next(self.fetch(page), None) is None

    def end(self) -> int:
        """The number of the first empty page."""
        low, high = -1, 1
        while not self.empty(high - 1):
            low, high = high - 1, high * 2
        high -= 1
        while high - low > 1:  # low is not empty, high is
            middle = (low + high) // 2
            low, high = (low, middle) if self.empty(middle) else (middle, high)
        return high

    def partitions(self) -> list[InputPartition]:
        end = self.end()
        return [PageRange(k, min(k + self.pages, end)) for k in range(0, end, self.pages)] or [PageRange(0, 0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last):
            for line, item in enumerate(self.fetch(page)):
                yield page, line, item


def walked(spark: SparkSession, path: str, fields: str, key: str, pages: int = PAGES) -> DataFrame:
    """The archive's items with `fields` (a schema) and the page that each was first seen on, each key once; of items that share a key
    the first one counts. Items without a key are left out."""
    spark.dataSource.register(PageArchive)
    rows = spark.read.format("page_archive").option("path", path).option("pages", pages).load()
    rows = rows.select("page", "line", F.from_json("item", fields).alias("x")).select("page", "line", "x.*").where(F.col(key).isNotNull())
    first = F.row_number().over(Window.partitionBy(key).orderBy("page", "line"))
    return rows.withColumn("__n", first).where("__n = 1").drop("__n", "line")


def written(items: DataFrame, path: str) -> None:
    """Items (page, and more) as an archive's pages, a file for each."""
    fields = [c for c in items.columns if c != "page"]
    items.select("page", F.to_json(F.struct(*fields)).alias("value")).repartition("page").write.partitionBy("page").text(path)
