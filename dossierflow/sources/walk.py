"""A folder tree as a Python data source that never enters what it leaves out.

    spark.read.format("pruned_walk").option("root", uri).option("excludes", '["_*", ".git"]').load()

The driver opens the upper folders until there are `parts` subtrees; each is a partition, walked in a task. Folders that
match a pattern (shell patterns, on one component), system folders below Library, links, and what resolves outside the
root are decided on by name, before anything in them is listed. Every folder and file that was met is a row (links to
nothing are not met): `reason` says why it was left out, in this order: excluded, library, link (or escape), unreadable, size, extension. No contents
are read here; `contents` reads those of the rows left, the first bytes first.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from dossierflow.operators.filters import LIBRARY_CHILDREN, PROMISES, SIGNATURES, guard_root
from dossierflow.operators.runs import within
from dossierflow.sources.stores import opened

SCHEMA = "path string, relative string, name string, kind string, size long, mtime timestamp, reason string"
_ARROW = pa.schema([("path", pa.string()), ("relative", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("reason", pa.string())])
#: Subtrees looked for on the driver, folders it opens for that at most, and rows of a batch.
PARTS, MOST_OPENED, ROWS = 64, 2000, 4096
#: Caps of an estimate.
CAP_FILES, CAP_SECONDS = 100_000, 5.0
HEAD = 16


class PrunedWalk(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pruned_walk"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(dict(self.options))


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.uri = options["root"]
        self.excludes = tuple(json.loads(options.get("excludes", "[]")))
        self.max_bytes = int(options.get("max_bytes", 1 << 62))
        self.extensions = tuple(e.lower() for e in json.loads(options.get("extensions", "[]")))
        self.follow = options.get("follow_links", "false") == "true"
        self.parts = int(options.get("parts", PARTS))
        _, path = opened(self.uri)
        guard_root(path, options.get("force", "false") == "true")

    # ------------------------------------------------------------ decisions by name

    def _pruned(self, relative: str) -> str | None:
        parts = relative.split("/")
        if any(fnmatchcase(parts[-1], p) for p in self.excludes):
            return "excluded"
        if len(parts) > 1 and parts[-2] == "Library" and parts[-1] in LIBRARY_CHILDREN:
            return "library"
        return None

    def _linked(self, store: fs.FileSystem, root: str, path: str) -> str | None:
        """Links exist on local file systems alone."""
        if not isinstance(store, fs.LocalFileSystem) or not os.path.islink(path):
            return None
        if not self.follow:
            return "link"
        real, top = os.path.realpath(path), os.path.realpath(root)
        if os.path.commonpath([real, top]) != top:
            return "escape"
        # A link to a folder above itself would be walked for ever.
        return "link" if os.path.isdir(real) and os.path.commonpath([os.path.realpath(os.path.dirname(path)), real]) == real else None

    def _skipped(self, name: str, size: int) -> str | None:
        if size > self.max_bytes:
            return "size"
        return "extension" if self.extensions and os.path.splitext(name)[1].lower() not in self.extensions else None

    def _entries(self, store: fs.FileSystem, root: str, folder: str) -> tuple[list[tuple], list[str]]:
        """Rows of a folder's children, and the folders among them to go on with."""
        try:
            found = store.get_file_info(fs.FileSelector(folder))
        except OSError:
            return [(folder, folder[len(root) :].lstrip("/"), folder.rpartition("/")[2], "folder", None, None, "unreadable")], []
        rows, below = [], []
        for i in sorted(found, key=lambda i: i.path):
            relative, is_dir = i.path[len(root) :].lstrip("/"), i.type == fs.FileType.Directory
            reason = self._pruned(relative) or self._linked(store, root, i.path)
            if reason is None and i.type == fs.FileType.NotFound:
                reason = "unreadable"
            if reason is None and not is_dir:
                reason = self._skipped(i.base_name, i.size)
            if is_dir and reason is None:
                below.append(i.path)
            time = None if i.mtime_ns is None else i.mtime_ns // 1000
            rows.append((i.path, relative, i.base_name, "folder" if is_dir else "file", None if is_dir else i.size, time, reason))
        return rows, below

    # ------------------------------------------------------------ planning and reading

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.uri)
        rows, level, opened_ = [], [root], 0
        while level and len(level) < self.parts and opened_ < MOST_OPENED:
            following = []
            for folder in level:
                own, below = self._entries(store, root, folder)
                rows += own
                following += below
                opened_ += 1
            level = following
        return [InputPartition((rows, None)), *(InputPartition(([], folder)) for folder in level)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, folder = partition.value
        store, root = opened(self.uri)
        waiting = [folder] if folder else []
        while waiting or rows:
            while waiting and len(rows) < ROWS:
                own, below = self._entries(store, root, waiting.pop())
                rows = rows + own
                waiting += below
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[:ROWS], strict=True), _ARROW.types, strict=True)] if rows else [pa.array([], t) for t in _ARROW.types], schema=_ARROW)
            rows = rows[ROWS:]


def walk(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), max_bytes: int | None = None, extensions: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Rows of all files and folders that the walk meets; `reason` is null for those that stay."""
    spark.dataSource.register(PrunedWalk)
    reader = spark.read.format("pruned_walk").option("root", root).option("excludes", json.dumps(excludes)).option("extensions", json.dumps(extensions))
    return (reader if max_bytes is None else reader.option("max_bytes", max_bytes)).options(**options).load()


def unchanged(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """`files` with reason `manifest` where the manifest has path, size and time as they are."""
    known = manifest.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime")).where("path IS NOT NULL").dropDuplicates(["path"])
    same = F.col("_size").isNotNull() & (F.col("_size") == F.col("size")) & (F.col("_mtime") == F.col("mtime"))
    return files.join(known, "path", "left").withColumn("reason", F.coalesce("reason", F.when(same, "manifest"))).select(files.columns)


def contents(files: DataFrame) -> DataFrame:
    """Adds `content` to files without a reason. A head that isn't what the extension promises vetoes the rest (`magic`); what can't be read is `unreadable`."""
    promised = {e: bytes.fromhex(SIGNATURES[f]) for e, f in PROMISES.items()}
    path, name, kind, reason = (files.columns.index(c) for c in ("path", "name", "kind", "reason"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                why, data = row.column(reason)[0].as_py(), None
                if why is None and row.column(kind)[0].as_py() == "file":
                    try:
                        store, place = opened(row.column(path)[0].as_py())
                        with store.open_input_stream(place) as f:
                            head = f.read(HEAD)
                            need = promised.get(os.path.splitext(row.column(name)[0].as_py())[1].lower(), b"")
                            data, why = (head + f.read(), None) if head.startswith(need) else (None, "magic")
                    except OSError:
                        why = "unreadable"
                columns = [*row.columns, pa.array([data], pa.binary())]
                columns[reason] = pa.array([why], pa.string())
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "content"])

    return files.mapInArrow(run, files.withColumn("content", F.lit(None).cast("binary")).schema)


def estimate(spark: SparkSession, root: str, excludes: tuple[str, ...] = (), cap_files: int = CAP_FILES, cap_seconds: float = CAP_SECONDS, **options: str) -> int | None:
    """Files that a scan would look at; None if there are more than `cap_files` or it takes longer than `cap_seconds`."""
    files = walk(spark, root, excludes, **options).where("kind = 'file' AND reason IS NULL")
    found = within(spark, cap_seconds, lambda: files.select(F.lit(1)).limit(cap_files).count())
    return None if found is None or found >= cap_files else found
