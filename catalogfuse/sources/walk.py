"""A data source that lists folder trees on the executors.

A folder that holds a marker file, or that is to be ignored, is never entered: what is below it is not listed at all. The driver
lists folders only until there are ``spread`` subtrees to hand out; each of these is one task. Rows leave a task as they are
found, so no list of all files exists anywhere.
"""

from __future__ import annotations

import os
import time
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from catalogfuse.functions.paths import extension, file_name, is_scannable, parent_dir
from catalogfuse.sources.inventory import SKIP_MARKERS, SKIPPED_DIR_WORDS

NAME = "file_inventory"
SCHEMA = "path string, size bigint, mtime timestamp"


@dataclass(frozen=True)
class Entry:
    path: str
    is_dir: bool
    size: int
    mtime: float  # seconds


def list_folder(folder: str) -> list[Entry]:
    """What is directly in a folder of the local tree, or of a store that pyarrow knows by its address. Links to folders are not
    followed. A folder that went meanwhile is empty."""
    if "://" in folder:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(folder)
        head = folder[: len(folder) - len(inner)]
        found = store.get_file_info(fs.FileSelector(inner, recursive=False, allow_not_found=True))
        return [Entry(head + f.path, f.type == fs.FileType.Directory, f.size or 0, f.mtime.timestamp() if f.mtime else 0.0) for f in found]
    out = []
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    out.append(Entry(e.path, True, 0, 0.0))
                elif not e.is_dir():
                    try:
                        s = e.stat()
                    except FileNotFoundError:  # a dead link
                        s = e.stat(follow_symlinks=False)
                    out.append(Entry(e.path, False, s.st_size, s.st_mtime))
    except (FileNotFoundError, NotADirectoryError):
        return []
    return out


@dataclass
class Subtree(InputPartition):
    folders: list[str]
    files: list[Entry]
    after: float = float("-inf")
    until: float = float("inf")


class Walker:
    def __init__(self, options: dict[str, str]) -> None:
        lines = lambda name: [x for x in options.get(name, "").split("\n") if x]
        self.roots, self.ignored = [r.rstrip("/") or "/" for r in lines("roots")], {d.rstrip("/") for d in lines("ignored")}
        self.markers, self.words = set(lines("markers")), lines("words")
        self.spread = int(options.get("spread", "64"))

    def open(self, folder: str) -> tuple[list[Entry], list[str]]:
        """Files and folders to go on with; nothing of a marked folder."""
        found = list_folder(folder)
        names = {e.path.rsplit("/", 1)[-1] for e in found if not e.is_dir}
        if names & self.markers:
            return [], []
        below = [e.path for e in found if e.is_dir and e.path not in self.ignored]
        return [e for e in found if not e.is_dir], [d for d in below if not any(w in d.rsplit("/", 1)[-1] for w in self.words)]

    def subtrees(self, after: float = float("-inf"), until: float = float("inf")) -> list[Subtree]:
        todo, files = deque(r for r in self.roots if r not in self.ignored), []
        while todo and len(todo) < self.spread:
            own, below = self.open(todo.popleft())
            files += own
            todo.extend(below)
        parts = [Subtree([d], [], after, until) for d in todo]
        return [Subtree([], files, after, until), *parts] if files or not parts else parts

    def walk(self, part: Subtree) -> Iterator[tuple[str, int, datetime]]:
        todo, files = list(part.folders), part.files
        while True:
            for e in files:
                if part.after < e.mtime <= part.until:
                    yield e.path, e.size, datetime.fromtimestamp(e.mtime, timezone.utc)
            if not todo:
                return
            files, below = self.open(todo.pop())
            todo.extend(below)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.walker = Walker(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.walker.subtrees()

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return self.walker.walk(partition)


class TreeStreamReader(DataSourceStreamReader):
    """Files by the time of their last change; an offset is a time, so a batch that is repeated lists the same files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.walker = Walker(options)

    def initialOffset(self) -> dict:
        return {"until": 0.0}

    def latestOffset(self) -> dict:
        # A second back: files of a tick that isn't over yet come with the next batch.
        return {"until": time.time() - 1.0}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.walker.subtrees(start["until"], end["until"])

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return self.walker.walk(partition)


class FileInventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStreamReader(self.options)


def _options(roots: Sequence[str], ignore_dirs: Sequence[str], skip_markers: Sequence[str], spread: int) -> dict[str, str]:
    join = "\n".join
    return {"roots": join(roots), "ignored": join(ignore_dirs), "markers": join(skip_markers), "words": join(SKIPPED_DIR_WORDS), "spread": str(spread)}


def _wanted(files: DataFrame, exts: Sequence[str]) -> DataFrame:
    rows = files.select("path", parent_dir("path").alias("dir"), file_name("path").alias("name"), extension("path").alias("ext"), "size", "mtime")
    return rows.where(F.col("ext").isin(*[e.lower() for e in exts]) & is_scannable("path"))


def walk_inventory(
    spark: SparkSession, roots: Sequence[str], exts: Sequence[str], ignore_dirs: Sequence[str] = (),
    skip_markers: Sequence[str] = SKIP_MARKERS, spread: int = 64,
) -> DataFrame:
    """Scannable files of the wanted extensions below the roots, as ``inventory.scan_inventory`` gives them."""
    spark.dataSource.register(FileInventory)
    return _wanted(spark.read.format(NAME).options(**_options(roots, ignore_dirs, skip_markers, spread)).load(), exts)


def stream_walk(
    spark: SparkSession, roots: Sequence[str], exts: Sequence[str], ignore_dirs: Sequence[str] = (),
    skip_markers: Sequence[str] = SKIP_MARKERS, spread: int = 64,
) -> DataFrame:
    """The same as a stream: each batch lists what changed since the one before."""
    spark.dataSource.register(FileInventory)
    return _wanted(spark.readStream.format(NAME).options(**_options(roots, ignore_dirs, skip_markers, spread)).load(), exts)
