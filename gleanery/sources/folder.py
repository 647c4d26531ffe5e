"""Folders as a data source: paths, times and sizes without reading a file; contents of chosen paths only.

`register(spark)` makes `spark.read.format("folder")` and `spark.readStream.format("folder")`
known. Options: path, and if wanted collection, pattern, ignore (a JSON list) and, for
streams, seconds between looks.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pfs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

DEFAULT_GLOB = "**/*.{md,txt}"
LISTING = "collection string, path string, mtime bigint, file_size bigint, error string, tick bigint"
#: Folders from which on tasks list on their own; files in a batch; bytes of contents in a batch, about.
FOLDERS, FILES, BATCH_BYTES = 256, 10_000, 16 << 20


def expand(pattern: str) -> list[str]:
    """The patterns that the first {a,b} group of a pattern stands for."""
    found = re.match(r"([^{]*?)\{([^}]*)\}(.*)", pattern, re.DOTALL)
    if not found:
        return [pattern]
    return [found[1] + x.strip() + found[3] for x in found[2].split(",")]


def glob_regex(pattern: str) -> str:
    """A pattern for base names as a regular expression; a leading **/ goes."""
    out = ""
    for part in re.findall(r"\[[^\]]*\]|.", pattern.removeprefix("**/")):
        out += "[^/]*" if part == "*" else "[^/]" if part == "?" else part if part.startswith("[") and len(part) > 1 else re.escape(part)
    return f"^{out}$"


def opened(root: str) -> tuple[pfs.FileSystem, str]:
    system, base = pfs.FileSystem.from_uri(re.sub("^file:/*", "/", root))
    return system, base.rstrip("/") or "/"


class Part(InputPartition):
    """Folders below the root; each with all below it, or its own files only."""

    def __init__(self, folders: list[tuple[str, bool]], tick: int) -> None:
        self.folders, self.tick = folders, tick


class Lister:
    """Lists the files of a folder that match; ignored folders aren't opened."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.collection = options["path"], options.get("collection", "")
        self.wanted = [glob_regex(p) for p in expand(options.get("pattern") or DEFAULT_GLOB)]
        self.names = json.loads(options.get("ignore") or "[]")
        self.unwanted = [glob_regex(p) for p in self.names]

    def _opened(self, system: pfs.FileSystem, base: str, below: str) -> tuple[list[str], list[pfs.FileInfo]]:
        """The folders and the matching files right below a folder."""
        found = system.get_file_info(pfs.FileSelector(f"{base}/{below}" if below else base))
        folders = [f"{below}/{x.base_name}" if below else x.base_name for x in found if x.type == pfs.FileType.Directory and x.base_name not in self.names]
        fits = lambda name: any(re.match(p, name) for p in self.wanted) and name not in self.names and not any(re.match(p, name) for p in self.unwanted)
        return sorted(folders), sorted((x for x in found if x.type == pfs.FileType.File and fits(x.base_name)), key=lambda x: x.base_name)

    def split(self, tick: int = 0) -> list[Part]:
        """The top folders, opened level by level until there are enough to share out."""
        system, base = opened(self.root)
        flat, level = [], [""]
        while level and len(level) < FOLDERS:
            below = []
            for folder in level:
                try:
                    below += self._opened(system, base, folder)[0]
                except OSError:
                    if not folder:
                        raise
                flat.append(folder)
            level = below
        return [Part([(f, False) for f in flat[i : i + 32]], tick) for i in range(0, len(flat), 32)] + [Part([(f, True)], tick) for f in level]

    def rows(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, base = opened(self.root)
        paths, times, sizes, errors = [], [], [], []

        def batch() -> pa.RecordBatch:
            n = len(paths)
            columns = [pa.array([self.collection] * n), pa.array(paths, pa.string()), pa.array(times, pa.int64()), pa.array(sizes, pa.int64()), pa.array(errors, pa.string()), pa.array([part.tick] * n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["collection", "path", "mtime", "file_size", "error", "tick"])

        waiting = list(reversed(part.folders))
        while waiting:
            folder, deep = waiting.pop()
            try:
                folders, files = self._opened(system, base, folder)
            except OSError as e:
                folders, files = [], []
                paths, times, sizes, errors = [*paths, folder], [*times, None], [*sizes, None], [*errors, str(e)]
            waiting += [(f, True) for f in reversed(folders)] if deep else []
            for x in files:
                paths.append(f"{folder}/{x.base_name}" if folder else x.base_name)
                times.append(x.mtime_ns // 1_000_000_000)
                sizes.append(x.size)
                errors.append(None)
            if len(paths) >= FILES:
                yield batch()
                paths, times, sizes, errors = [], [], [], []
        if paths:
            yield batch()


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.lister = Lister(options)

    def partitions(self) -> Sequence[InputPartition]:
        return self.lister.split()

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.lister.rows(partition)


class FolderStream(DataSourceStreamReader):
    """The whole listing at every tick, since a folder tells neither edits nor deletions."""

    def __init__(self, options: dict[str, str]) -> None:
        self.lister, self.seconds = Lister(options), float(options.get("seconds", 60))

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        return {"tick": int(time.time() // self.seconds)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.lister.split(end["tick"])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return self.lister.rows(partition)


class Folder(DataSource):
    """collection, path (below the root), mtime (seconds), file_size of the files that match.

    A folder that can't be opened gives a row with its error and no time; tick numbers
    the looks of a stream.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FolderReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return FolderStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Folder)


def _options(root: str, collection: str, pattern: str, ignore: Sequence[str]) -> dict[str, str]:
    return {"path": root, "collection": collection, "pattern": pattern, "ignore": json.dumps(list(ignore))}


def listing(spark: SparkSession, root: str, collection: str, pattern: str = DEFAULT_GLOB, ignore: Sequence[str] = ()) -> DataFrame:
    register(spark)
    return spark.read.format("folder").options(**_options(root, collection, pattern, ignore)).load().drop("tick")


def listings(spark: SparkSession, root: str, collection: str, pattern: str = DEFAULT_GLOB, ignore: Sequence[str] = (), seconds: float = 60) -> DataFrame:
    """A stream of whole listings, one every so many seconds."""
    register(spark)
    return spark.readStream.format("folder").options(**_options(root, collection, pattern, ignore), seconds=str(seconds)).load()


def read_bytes(root: str, path: str) -> bytes:
    system, base = opened(root)
    with system.open_input_stream(f"{base}/{path}", compression=None) as stream:
        return stream.read()


def contents(files: DataFrame, root: str, read: Callable[[str, str], bytes] = read_bytes) -> DataFrame:
    """files (collection, path, ...) with body, hash (of the bytes) and error; each file is read once, by a task.

    A file that can't be read has an error and no body. Bytes that aren't UTF-8 become
    U+FFFD in the body, not in the hash.
    """
    rows = files.drop("body", "hash", "error")
    names = rows.columns
    schema = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in ("body", "hash", "error")]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, found = 0, 0, []
            for i, path in enumerate(batch.column("path").to_pylist()):
                try:
                    raw = read(root, path)
                    found.append((raw.decode(errors="replace"), hashlib.sha256(raw).hexdigest(), None))
                    size += len(raw)
                except Exception as e:  # whatever keeps one file from being read is that file's error
                    found.append((None, None, f"{type(e).__name__}: {e}"))
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(x, pa.string()) for x in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(found)).columns, *columns], [*names, "body", "hash", "error"])
                    start, size, found = i + 1, 0, []

    return rows.mapInArrow(run, schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by Spark's file systems, so that all their schemes work."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
