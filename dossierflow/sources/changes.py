"""A folder tree as a stream of changes: new files and files whose time or size has changed, with their contents.

    spark.readStream.format("changed_files").option("root", uri).option("state", uri).load()

Spark's own file source takes a path once for all. Here each listing that finds something different is written as the
next numbered list to `state` before Spark logs its number as the batch's offset, so a batch that is run again reads
the same list, and a restart goes on from the checkpoint: no change comes twice or is lost. Lists that are committed are
folded into one base file. `state` belongs to one query. The driver holds SORT_ROWS files at a time: what is there and what
was there are sorted by path in temporary files and read side by side (of stores other than local ones a folder is listed
as a whole). A partition names its places in the lists, which tasks read together with the contents, about `chunk_bytes`
each and CHUNK_FILES files at most. `max_files` bounds the lines of a list: a listing that finds more writes several, all
of them in one batch, so that a stream that stops at what is there leaves nothing.

A file that goes leaves the state, so that it is new when it comes back; one that goes between listing and reading has no
row. Folders named like editors' temporary files are not entered, such files left out, links not followed.
"""

from __future__ import annotations

import heapq
import io
import json
import marshal
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from dossierflow.sources.stores import files, opened

SCHEMA = "path string, name string, size long, mtime timestamp, content binary, change string"
_ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("content", pa.binary()), ("change", pa.string())])
MAX_FILES, CHUNK_BYTES, CHUNK_FILES, FOLD_AFTER = 100_000, 64 << 20, 5_000, 20
#: Lines that are sorted in memory or read at a time, and sorted files that are merged at a time; the part of a chunk's bytes, and rows, of a batch of contents.
SORT_ROWS, SPOOLED, MERGED, BATCH_PART, BATCH_ROWS = 100_000, 500, 100, 16, 1000


def temporary(name: str) -> bool:
    return name.startswith(".") or name.endswith(("~", ".swp"))


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ChangesReader(dict(self.options))


_encode = json.JSONEncoder(ensure_ascii=False).encode


def _spooled(lines: Iterable[list]) -> Iterator[list]:
    lines, run, blocks = iter(lines), tempfile.TemporaryFile(), 0
    while block := list(islice(lines, SPOOLED)):
        marshal.dump(block, run)
        blocks += 1
    run.seek(0)
    return chain.from_iterable(marshal.load(run) for _ in range(blocks))


def _sorted(lines: Iterable[list], key: Callable) -> Iterator[list]:
    """`lines` in the order of `key`; those beyond SORT_ROWS lie in temporary files."""
    lines, runs = iter(lines), []
    while held := sorted(islice(lines, SORT_ROWS), key=key):
        runs.append(_spooled(held) if len(held) == SORT_ROWS else held)
        if len(runs) == MERGED:
            runs = [_spooled(heapq.merge(*runs, key=key))]
    return heapq.merge(*runs, key=key)


class _Lists:
    """The numbered lists in the state folder. A line is [path, time, size, change]."""

    def __init__(self, uri: str):
        self.store, self.folder = opened(uri)
        self.store.create_dir(self.folder)

    def names(self, kind: str) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.folder))
        return sorted(int(i.base_name.split("-")[1]) for i in found if i.is_file and i.base_name.startswith(f"{kind}-"))

    def raw(self, kind: str, number: int) -> Iterator[bytes]:
        with self.store.open_input_stream(f"{self.folder}/{kind}-{number:012d}") as f:
            yield from io.BufferedReader(f)

    def read(self, kind: str, number: int) -> Iterator[list]:
        return map(json.loads, self.raw(kind, number))

    def piece(self, kind: str, number: int, begin: int, end: int) -> Iterator[list]:
        """The lines that lie between two bytes."""
        with self.store.open_input_file(f"{self.folder}/{kind}-{number:012d}") as f:
            f.seek(begin)
            return map(json.loads, f.read(end - begin).splitlines())

    def write(self, kind: str, number: int, lines: Iterable[list]) -> None:
        path = f"{self.folder}/{kind}-{number:012d}"
        with self.store.open_output_stream(f"{self.folder}/tmp-{kind}-{number}", buffer_size=1 << 20) as f:
            for line in lines:
                f.write(f"{_encode(line)}\n".encode())
        self.store.move(f"{self.folder}/tmp-{kind}-{number}", path)

    def known(self, last: int | None = None) -> Iterator[list]:
        """The files known after the list `last` (or all), ascending by path."""
        base = self.names("base")[-1:]
        numbers = [n for n in self.names("list") if (not base or n > base[0]) and (last is None or n <= last)]
        numbered = lambda kind, n: ([*line, n] for line in self.read(kind, n))
        order = lambda line: (line[0], line[4])
        later = _sorted(chain.from_iterable(numbered("list", n) for n in numbers), order)
        for _, same in groupby(heapq.merge(*(numbered("base", n) for n in base), later, key=order), key=lambda line: line[0]):
            *line, _ = list(same)[-1]
            if line[3] != "gone":
                yield line

    def drop(self, kind: str, number: int) -> None:
        self.store.delete_file(f"{self.folder}/{kind}-{number:012d}")


@dataclass
class _Part:
    """Lines of lists, by (kind, number, begin, end) of their bytes; read where they are asked for."""

    uri: str
    pieces: list[tuple[str, int, int, int]] = field(default_factory=list)

    def __iter__(self) -> Iterator[list]:
        lists = _Lists(self.uri)
        return (line for p in self.pieces for line in lists.piece(*p))

    def add(self, kind: str, number: int, begin: int, end: int) -> None:
        if self.pieces and self.pieces[-1][:2] == (kind, number) and self.pieces[-1][3] == begin:
            begin = self.pieces.pop()[2]
        self.pieces.append((kind, number, begin, end))


def _differences(known: Iterable[list], found: Iterable[list]) -> Iterator[list]:
    """Lines of what differs between two lists that ascend by path."""
    for path, same in groupby(heapq.merge(known, found, key=lambda line: line[0]), key=lambda line: line[0]):
        lines = {len(line): line for line in same}
        was, now = lines.get(4), lines.get(3)
        if now is None:
            yield [path, 0, 0, "gone"]
        elif was is None or was[1:3] != now[1:]:
            yield [*now, "changed" if was else "new"]


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}
        self.version: int | None = None
        #: Version before the last listing: the lists behind it are one batch.
        self.before = None

    # ------------------------------------------------------------ offsets, on the driver

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        lists = _Lists(self.options["state"])
        if self.version is None:
            self.version = max([0, *lists.names("base"), *lists.names("list")])
        store, root = opened(self.options["root"])
        by_path = lambda line: line[0]
        found = _sorted(([f.path, f.mtime_ns, f.size] for f in files(store, root, temporary)), by_path)
        # Oldest first, what is gone last.
        lines = _sorted(_differences(lists.known(), found), lambda line: (line[3] == "gone", line[1], line[0]))
        most, before = int(self.options.get("max_files", MAX_FILES)), self.version
        for line in lines:
            self.version += 1
            lists.write("list", self.version, chain([line], islice(lines, most - 1)))
        if self.version > before:
            self.before = before
        return {"version": self.version}

    def commit(self, end: dict) -> None:
        lists = _Lists(self.options["state"])
        for number in lists.names("batch"):
            if number <= end["version"]:
                lists.drop("batch", number)
        done = [n for n in lists.names("list") if n <= end["version"]]
        if len(done) < FOLD_AFTER:
            return
        # Those of the last listing stay for a batch that is run again.
        own = self.before is not None and self.before < done[-1] <= self.version
        old = [n for n in done[:-1] if not own or n <= self.before]
        if not old:
            return
        bases = lists.names("base")
        lists.write("base", old[-1], ([*line[:3], "new"] for line in lists.known(old[-1])))
        for number in old:
            lists.drop("list", number)
        for number in bases:
            if number != old[-1]:
                lists.drop("base", number)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        lists, uri = _Lists(self.options["state"]), self.options["state"]
        numbers = [("list", n) for n in range(start["version"] + 1, end["version"] + 1)]
        if len(numbers) > 1 and (self.before, self.version) != (start["version"], end["version"]):
            # Of several listings the last word on a path counts; one names no path twice.
            order = lambda line: (line[0], line[4])
            every = _sorted(([*line, n] for kind, n in numbers for line in lists.read(kind, n)), order)
            latest = (list(same)[-1][:4] for _, same in groupby(every, key=lambda line: line[0]))
            lists.write("batch", end["version"], _sorted(latest, lambda line: (line[1], line[0])))
            numbers = [("batch", end["version"])]
        most = int(self.options.get("chunk_bytes", CHUNK_BYTES))
        parts, held, n = [], most + 1, 0
        for kind, number in numbers:
            at = 0
            for raw in lists.raw(kind, number):
                _, _, size, change = json.loads(raw)
                if change != "gone":
                    if held + size > most or n >= CHUNK_FILES:
                        parts.append(_Part(uri))
                        held = n = 0
                    parts[-1].add(kind, number, at, at + len(raw))
                    held, n = held + size, n + 1
                at += len(raw)
        return [InputPartition(p) for p in parts]

    # ------------------------------------------------------------ contents, in tasks

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.options["root"])
        most, rows, held = int(self.options.get("chunk_bytes", CHUNK_BYTES)) // BATCH_PART, [], 0
        for path, time, _, change in partition.value:
            try:
                with store.open_input_stream(path) as f:
                    content = f.read()
            except OSError:
                continue
            rows.append((path, path.rpartition("/")[2], len(content), time // 1000, content, change))
            held += len(content)
            if held >= most or len(rows) == BATCH_ROWS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def changed_files(spark: SparkSession, root: str, state: str, **options: str) -> DataFrame:
    spark.dataSource.register(ChangedFiles)
    return spark.readStream.format("changed_files").option("root", root).option("state", state).options(**options).load()
