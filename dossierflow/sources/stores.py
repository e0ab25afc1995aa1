"""Files by URI inside tasks of Python data sources, through Arrow's file systems: file, s3, gs, abfs, hdfs."""

from __future__ import annotations

import contextlib
import errno
import os
import re
import stat
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from dossierflow.session import spread


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    if uri.startswith("file:/"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


@dataclass(frozen=True)
class Listed:
    path: str
    is_dir: bool
    size: int
    mtime_ns: int


def _listed(store: fs.FileSystem, folder: str) -> Iterator[Listed]:
    """What lies in a folder, links left out; local entries as they come, others as one list."""
    if not isinstance(store, fs.LocalFileSystem):
        for i in store.get_file_info(fs.FileSelector(folder, recursive=False)):
            if i.type != fs.FileType.NotFound:
                yield Listed(i.path, i.type == fs.FileType.Directory, i.size or 0, i.mtime_ns or 0)
        return
    with os.scandir(folder) as found:
        for e in found:
            with contextlib.suppress(FileNotFoundError):
                info = e.stat(follow_symlinks=False)
                if not stat.S_ISLNK(info.st_mode):
                    yield Listed(e.path, stat.S_ISDIR(info.st_mode), info.st_size, info.st_mtime_ns)


def files(store: fs.FileSystem, folder: str, skipped: Callable[[str], bool]) -> Iterator[Listed]:
    """The files of a folder tree in any order, but for links and what has `skipped` names; a folder that can't be read or has gone has nothing."""
    open_ = [_listed(store, folder)]
    while open_:
        try:
            found = next(open_[-1], None)
        except OSError as e:
            if e.errno in (errno.EMFILE, errno.ENFILE):
                raise
            found = None
        if found is None:
            open_.pop()
        elif skipped(found.path.rpartition("/")[2]):
            continue
        elif found.is_dir:
            open_.append(_listed(store, found.path))
        else:
            yield found


def write_files(rows: DataFrame, root: str, dealt: bool = False) -> int:
    """Writes (path below root, content) as files from tasks, and returns how many; a task that runs again writes them anew. Rows that are `dealt` out already go by no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder = f"{top}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{top}/{path}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    named = rows.select("path", "content")
    return (named if dealt else spread(named)).mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


#: Bytes of contents, and paths, of a batch.
BATCH_BYTES, BATCH_PATHS = 16 << 20, 4096


def _within(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Paths in a folder and whether they are folders; local ones as they come, not as one list."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((e.path, e.is_dir()) for e in found)
    else:
        yield from ((i.path, i.type == fs.FileType.Directory) for i in store.get_file_info(fs.FileSelector(folder)))


def _encoded(path: str) -> str:
    return re.sub(r"[\x00-\x20\"%<>\\^`{|}#?\[\]]", lambda m: quote(m[0]), path)


def read_files(spark: SparkSession, root: str, pattern: str = "*", hidden: bool = False) -> DataFrame:
    """path (a URI, encoded as Spark's are), relative and content of the files below root whose names fit the pattern.

    Folders are listed and files are read in tasks: the driver lists the root alone, so that it holds no file of a folder
    below. A folder directly below the root is walked by one task; what it finds is dealt out before it is read. Files
    named _* or .* are left out as by Spark's own sources, and such folders too unless they are asked for (`hidden`).
    """
    store, top = opened(root)
    local = isinstance(store, fs.LocalFileSystem)
    scheme = "file://" if local else root.split("://")[0] + "://"
    shown = lambda path: not path.rpartition("/")[2].startswith(("_", "."))
    upper = [(p, d) for p, d in _within(store, top) if shown(p) or (hidden and d)]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, found = opened(root)[0], []
        for batch in batches:
            waiting = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while waiting:
                path, is_dir = waiting.pop()
                for p, d in _within(inner, path) if is_dir else [(path, False)]:
                    if not shown(p) and not (hidden and d):
                        continue
                    if d:
                        waiting.append((p, True))
                    elif fnmatchcase(p.rpartition("/")[2], pattern):
                        found.append(p)
                        if len(found) == BATCH_PATHS:
                            yield pa.RecordBatch.from_pydict({"path": found})
                            found = []
        yield pa.RecordBatch.from_pydict({"path": pa.array(found, pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, base = opened(root)
        for batch in batches:
            held, size = [], 0
            for path in batch.column(0).to_pylist():
                with inner.open_input_stream(path) as f:
                    content = f.read()
                held.append((scheme + _encoded(path), path[len(base) :].lstrip("/"), content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield _rows(held)
                    held, size = [], 0
            yield _rows(held)

    folders = spark.createDataFrame(upper, "path string, is_dir boolean").repartition(max(1, min(len(upper), spark.sparkContext.defaultParallelism * 4)))
    return spread(folders.mapInArrow(walk, "path string")).mapInArrow(read, "path string, relative string, content binary")


def _rows(held: list[tuple[str, str, bytes]]) -> pa.RecordBatch:
    columns = [pa.array([h[k] for h in held], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["path", "relative", "content"])
