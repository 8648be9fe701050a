"""Landed pages as a data source and a sink, and numbered JSON parts as a sink: ``register`` makes them known to a session.

``landed_pages`` reads root/YYYYMMDD/site.md as (crawl_date, site, source_url, body, path). Filters on crawl_date prune folders before these are listed, filters on
site prune files before these are read; files are dealt to tasks by size. The first line is the address if it begins with http; with the option
``urls`` set to ``any`` the first line is taken whatever it is. Writing makes one file a row, named by its site in safe letters.

``numbered_parts`` writes JSON arrays of some PART_BYTES, numbered by partition and place in it, so that a table sorted by ranges is in order over its parts.
A part is read as a whole, so its size bounds what a reader holds, however many rows a task has; each task writes one part at least.

Both sinks write into a folder of the job beside the target; a task names what it has written, ``commit`` moves what successful tasks named, ``abort``
removes the folder, so a failed or repeated task leaves nothing behind. Folders are reached through pyarrow's file systems.

Defined results: an empty file has a null address and an empty body; bytes that are no UTF-8 are replaced; files that are no .md and folders without eight leading
digits are not read; a missing root is an empty table. Rows without a date or a site, and two rows for one file, are refused. Null texts are empty.
A table without rows makes no page, and one part with an empty array.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from ..functions import text

PAGES = "crawl_date string, site string, source_url string, body string, path string"
GROUP_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
PART_BYTES = 8 << 20


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
    spark.dataSource.register(NumberedParts)


def read_pages(spark: SparkSession, root: str, urls: str = "http") -> DataFrame:
    register(spark)
    return spark.read.format("landed_pages").option("urls", urls).load(root)


def write_pages(pages: DataFrame, root: str) -> None:
    """Pages (crawl_date, site, source_url, body) to root/YYYYMMDD/site.md; files of the same name are replaced."""
    register(pages.sparkSession)
    names = ("crawl_date", "site", "source_url", "body")
    # the rows of one file meet in one task, so that a second one is seen
    pages.select(*(pages[n].cast("string").alias(n) for n in names)).repartition("crawl_date", text.safe_file_name(F.col("site"))).write.format("landed_pages").mode("append").save(root)


def write_parts(rows: DataFrame, root: str, part_bytes: int = PART_BYTES) -> None:
    """Rows in their order to root/part-00000.json and on, in place of what is there."""
    register(rows.sparkSession)
    rows.selectExpr("to_json(struct(*)) as value").write.format("numbered_parts").option("part_bytes", part_bytes).mode("overwrite").save(root)


def read_parts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The rows of numbered parts, with their part and place in it."""
    whole = spark.read.option("pathGlobFilter", "part-*.json").text(root, wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = whole.select(number.alias("part"), F.posexplode(F.from_json("value", f"array<struct<{schema}>>")).alias("place", "row"))
    return rows.select("part", "place", "row.*")


def positions(parts: DataFrame) -> DataFrame:
    """Rows of ``read_parts`` with their position in the whole table, from 0; the one window has a row a part."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("_before"))
    return parts.join(F.broadcast(starts), "part").withColumn("position", F.col("_before") + F.col("place")).drop("_before", "part", "place")


def safe_name(name: str) -> str:
    """Letters, digits, blanks and underscores, the blanks as underscores, in lower case."""
    return "".join(c for c in name if c.isalnum() or c in " _").rstrip().replace(" ", "_").lower()


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, at.rstrip("/")


TESTS = {
    ds.EqualTo: lambda x, v: x == v, ds.EqualNullSafe: lambda x, v: x == v, ds.In: lambda x, v: x in v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v,
    ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v, ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: lambda x, v: v in x,
}


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class PageReader(ds.DataSourceReader):
    def __init__(self, root: str, urls: str):
        self.root, self.urls, self.filters = root, urls, []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and f.attribute in (("crawl_date",), ("site",)) and f.value is not None:
                self.filters.append((f.attribute[0], type(f), f.value))
            elif not (isinstance(f, ds.IsNotNull) and f.attribute in (("crawl_date",), ("site",))):
                yield f

    def _keeps(self, column: str, value: str) -> bool:
        return all(TESTS[kind](value, v) for c, kind, v in self.filters if c == column)

    def _files(self) -> Iterator[fs.FileInfo]:
        store, at = _store(self.root)
        for folder in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            date = re.match(r"\d{8}", folder.base_name)
            if folder.type == fs.FileType.Directory and date and self._keeps("crawl_date", date[0]):
                yield from (f for f in store.get_file_info(fs.FileSelector(folder.path)) if f.type == fs.FileType.File and f.extension == "md" and self._keeps("site", f.base_name[:-3]))

    def partitions(self):
        groups, size = [], GROUP_BYTES
        for f in self._files():
            if size >= GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(f.path)
            size += f.size + 65_536  # opening a file has a price of its own
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition):
        store, _ = _store(self.root)
        rows, size = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as f:
                whole = f.read().decode("utf-8", "replace")
            first, _, rest = whole.partition("\n")
            is_url = first.startswith("http") or (self.urls == "any" and bool(first))
            folder, name = path.split("/")[-2:]
            rows.append((folder[:8], name[:-3], first.strip() if is_url else None, rest if is_url else whole, path))
            size += len(whole)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=[c.split()[0] for c in PAGES.split(", ")])


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str
    partition: int = 0
    n_files: int = 0


class StagedWriter(ds.DataSourceArrowWriter):
    """Tasks write below a folder of the job; a commit moves what they named, an abort removes it, and a task that comes late can't make it again."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root, overwrite, f"_job-{uuid.uuid4().hex}"
        store, at = _store(root)
        store.create_dir(f"{at}/{self.job}")

    def _attempt(self) -> tuple[fs.FileSystem, str]:
        task = TaskContext.get()
        store, at = _store(self.root)
        folder = f"{at}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        store.create_dir(folder, recursive=False)
        return store, folder

    def _name(self, message: Written, name: str) -> str:
        """What a task's file or folder is called below the target."""
        return name

    def commit(self, messages):
        store, at = _store(self.root)
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
                if old.base_name != self.job:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        for message in messages:
            found = store.get_file_info(fs.FileSelector(message.folder, allow_not_found=True, recursive=True))
            for f in sorted(found, key=lambda f: f.type != fs.FileType.Directory):
                target = at + self._name(message, f.path[len(message.folder) :])
                store.create_dir(target) if f.type == fs.FileType.Directory else store.move(f.path, target)
        self.abort(messages)

    def abort(self, messages):
        store, at = _store(self.root)
        if store.get_file_info(f"{at}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{at}/{self.job}")


class PageWriter(StagedWriter):
    def write(self, iterator):
        store, folder = self._attempt()
        made, seen = set(), set()
        for batch in iterator:
            for date, site, url, body in zip(*(batch.column(n).to_pylist() for n in ("crawl_date", "site", "source_url", "body")), strict=True):
                if not re.fullmatch(r"\d{8}", date or "") or not safe_name(site or ""):
                    raise ValueError("a page needs a date of eight digits and a site")
                path = f"{folder}/{date}/{safe_name(site)}.md"
                if path in seen:
                    raise ValueError(f"two pages for {date}/{safe_name(site)}")
                seen.add(path)
                if date not in made:
                    store.create_dir(f"{folder}/{date}", recursive=False)
                    made.add(date)
                with store.open_output_stream(path, compression=None) as f:
                    f.write(((url + "\n" if url else "") + (body or "")).encode())
        return Written(folder)


class PartWriter(StagedWriter):
    """A task numbers its parts from 0; a commit numbers them on from those of the partitions before."""

    def __init__(self, root: str, overwrite: bool, part_bytes: int):
        super().__init__(root, overwrite)
        self.part_bytes = part_bytes

    def write(self, iterator):
        store, folder = self._attempt()
        values = (v.encode() for batch in iterator for v in batch.column("value").to_pylist())
        value, n_files = next(values, None), 0
        while n_files == 0 or value is not None:
            with store.open_output_stream(f"{folder}/{n_files}.json", compression=None) as f:
                size = f.write(b"[")
                while value is not None and size < self.part_bytes:
                    size += f.write((b",\n" if size > 1 else b"\n") + value)
                    value = next(values, None)
                f.write(b"\n]\n")
            n_files += 1
        return Written(folder, TaskContext.get().partitionId(), n_files)

    def _name(self, message, name):
        return f"/part-{self.before[message.folder] + int(name[1:-5]):05d}.json"

    def commit(self, messages):
        self.before, n = {}, 0
        for message in sorted(messages, key=lambda m: m.partition):
            self.before[message.folder] = n
            n += message.n_files
        super().commit(messages)


class LandedPages(ds.DataSource):
    @classmethod
    def name(cls):
        return "landed_pages"

    def schema(self):
        return PAGES

    def reader(self, schema):
        return PageReader(self.options["path"], self.options.get("urls", "http"))

    def writer(self, schema, overwrite):
        return PageWriter(self.options["path"], overwrite)


class NumberedParts(ds.DataSource):
    @classmethod
    def name(cls):
        return "numbered_parts"

    def schema(self):
        return "value string"

    def writer(self, schema, overwrite):
        return PartWriter(self.options["path"], overwrite, int(self.options.get("part_bytes", PART_BYTES)))
