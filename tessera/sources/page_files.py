"""Trees of page files as a data source: folders of categories, a file a page, with a JSON file beside it where the page has metadata.

``spark.read.format("page_files").load(root)`` plans partitions by category, and several for a category where ``splits`` asks for them; the driver lists
the categories only, tasks list and read their share of files. Filters on ``category`` choose partitions, ``stem > x`` is the cursor of a
reader that goes on where it stopped. As a stream it gives what was written after the last batch. Written rows become files when the
whole job has succeeded.

Paths are read with pyarrow's file systems (local, hdfs, s3 and such); a page without an id in its metadata gets 63 bits of its path's SHA-256.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, GreaterThan, In, InputPartition, WriterCommitMessage

SCHEMA = "category string, stem string, page_id long, title string, text string"
META = ".meta.json"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store, root.rstrip("/")


def path_id(category: str, stem: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{category}/{stem}".encode()).digest()[:8], "big") >> 1


def name_of(category: str) -> str:
    """A folder's name for any category, and a file's for any stem; reversible."""
    return "".join(c if c.isalnum() or c in "-_ " else f"%{ord(c):x};" for c in category) or "%"


def read_name(name: str) -> str:
    out, at = "", 0
    while at < len(name):
        end = name.find(";", at) if name[at] == "%" else -1
        out, at = (out + chr(int(name[at + 1 : end], 16)), end + 1) if end > 0 else (out + (name[at] if name != "%" else ""), at + 1)
    return out


@dataclass
class Share(InputPartition):
    """Files of a category whose name falls to this split, named after ``after`` and written in ``(since, until]`` nanoseconds."""

    category: str
    split: int
    splits: int
    after: str = ""
    since: int = -1
    until: int = 1 << 62


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, [f.name for f in schema.fields], overwrite)


class Files:
    """What all readers know: the root, the extension, and how a share is read."""

    def __init__(self, options: dict) -> None:
        self.path, self.extension = options["path"], "." + options.get("extension", "html")
        self.splits = int(options.get("splits", 1))
        self.wanted: set[str] | None = None
        self.after = options.get("after", "")

    def categories(self) -> list[str]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        names = sorted(read_name(f.base_name) for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith((".", "_staging")))
        return [n for n in names if self.wanted is None or n in self.wanted]

    def shares(self, **bounds) -> list[Share]:
        return [Share(c, k, self.splits, self.after, **bounds) for c in self.categories() for k in range(self.splits)]

    def files(self, share: Share) -> list[tuple[int, str]]:
        """``(written, stem)`` of the share's pages, by stem."""
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(f"{root}/{name_of(share.category)}", allow_not_found=True))
        pages = [(f.mtime_ns, read_name(f.base_name[: -len(self.extension)])) for f in found if f.is_file and f.base_name.endswith(self.extension)]
        mine = lambda at, stem: stem > share.after and share.since < at <= share.until and zlib.crc32(stem.encode()) % share.splits == share.split
        return sorted((x for x in pages if mine(*x)), key=lambda x: x[1])

    def read(self, partition: Share | None) -> Iterator[tuple]:
        if partition is None:  # no categories, so no shares
            return
        store, root = opened(self.path)
        folder = f"{root}/{name_of(partition.category)}"
        for _, stem in self.files(partition):
            base = f"{folder}/{name_of(stem)}"
            with store.open_input_stream(base + self.extension) as f:
                text = f.read().decode(errors="replace")
            meta = {}
            if store.get_file_info(base + META).is_file:
                with store.open_input_stream(base + META) as f:
                    meta = json.loads(f.read())
            given = meta.get("page_id")
            yield partition.category, stem, path_id(partition.category, stem) if given is None else int(given), meta.get("title"), text


class Reader(Files, DataSourceReader):
    def pushFilters(self, filters: list) -> Iterator:
        """Takes equality and lists on ``category``, and ``stem > x``; the others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("category",):
                self.wanted = {f.value} & (self.wanted if self.wanted is not None else {f.value})
            elif isinstance(f, In) and f.attribute == ("category",):
                self.wanted = set(f.value) & (self.wanted if self.wanted is not None else set(f.value))
            elif isinstance(f, GreaterThan) and f.attribute == ("stem",):
                self.after = max(self.after, f.value)
            else:
                yield f

    def partitions(self) -> list[Share]:
        return self.shares()


class StreamReader(Files, DataSourceStreamReader):
    """Offsets are times of writing; what is written later comes with a later batch."""

    def initialOffset(self) -> dict:
        return {"written": -1}

    def latestOffset(self) -> dict:
        return {"written": max((at for share in self.shares() for at, _ in self.files(share)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        return self.shares(since=start["written"], until=end["written"])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Staged(WriterCommitMessage):
    files: list


class Writer(DataSourceWriter):
    """Each task writes below a folder of its own; the commit moves files to their places, an abort deletes them."""

    def __init__(self, options: dict, names: list[str], overwrite: bool) -> None:
        if overwrite:
            raise ValueError("pages are added, so write them in mode append")
        self.path, self.extension, self.names = options["path"], "." + options.get("extension", "html"), names
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Staged:
        store, root = opened(self.path)
        task, moves = uuid.uuid4().hex, []
        store.create_dir(f"{root}/{self.staging}/{task}")
        for k, row in enumerate(rows):
            r = dict(zip(self.names, row))
            target = f"{name_of(r['category'] or '')}/{name_of(r['stem'])}"
            meta = {x: r[x] for x in ("page_id", "title") if r.get(x) is not None}
            for suffix, data in ((META, json.dumps(meta).encode()), (self.extension, (r["text"] or "").encode())):
                at = f"{self.staging}/{task}/{k}{suffix}"
                with store.open_output_stream(f"{root}/{at}") as f:
                    f.write(data)
                moves.append((at, target + suffix))
        return Staged(moves)

    def commit(self, messages: list) -> None:
        store, root = opened(self.path)
        made: set[str] = set()
        for at, target in (m for x in messages if x for m in x.files):
            folder = target.rpartition("/")[0]
            if folder not in made:
                store.create_dir(f"{root}/{folder}")
                made.add(folder)
            store.move(f"{root}/{at}", f"{root}/{target}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


def register(spark: SparkSession) -> None:
    """Make ``page_files`` known to a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageFiles)
