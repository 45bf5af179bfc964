"""A Spark data source for definition corpora: files ``<base>/<database>/<table>.sql``.

``spark.read.format("definition_files")`` gives ``path, content, reason`` of each file, ``df.write`` of
``database_name, table_name, content`` makes them. A directory is a partition, or several where it may hold many
files: each lists the directory itself, in its task, and takes its share of the names. So neither the names of files
nor their number pass through the driver, which knows the directories only. Names are taken as they are: what Spark's
own readers hide (``_x.sql``) or leave out (files without a byte) is read like any other.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes and files of a batch that a reading task gives out at once.
BATCH_BYTES, BATCH_FILES = 4 << 20, 1024
ENDING = ".sql"
READ = pa.schema([("path", pa.string()), ("content", pa.binary()), ("reason", pa.string())])


def file_system(base: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URL or local path, and the path in it."""
    parts = urlsplit(base) if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", base) else None
    if parts is None or parts.scheme == "file":
        return fs.LocalFileSystem(), "/" + base.split(":", 1)[1].lstrip("/") if parts else os.path.abspath(base)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parts.scheme, parts.scheme)
    path = base.split("://", 1)[1]
    if scheme == "s3":
        return fs.S3FileSystem(), path
    store, _ = fs.FileSystem.from_uri(f"{scheme}://{parts.netloc}/")
    return store, "/" + path.split("/", 1)[1] if "/" in path else "/"


def name_pattern(pattern: str) -> str:
    """A regular expression for a name pattern, in which ``*`` alone is anything and else any run without a newline."""
    return r"[\s\S]*" if pattern == "*" else r"[^\n]*".join(re.escape(piece) for piece in pattern.split("*"))


class Names(NamedTuple):
    """Which files are wanted: pairs of patterns, or None for all."""

    targets: tuple[tuple[str, str], ...] | None

    @staticmethod
    def of(options: dict[str, str]) -> Names:
        # Patterns come one to a line; a line without exactly one dot is none.
        if "targets" not in options:
            return Names(None)
        halves = [line.split(".") for line in options["targets"].split("\n")]
        return Names(tuple((h[0], h[1]) for h in halves if len(h) == 2))

    def databases(self) -> re.Pattern:
        return self._either(name_pattern(d) for d, _ in self.targets or [("*", "*")])

    def tables(self, database: str) -> re.Pattern:
        targets = [("*", "*")] if self.targets is None else self.targets
        return self._either(name_pattern(t) for d, t in targets if re.fullmatch(name_pattern(d), database))

    @staticmethod
    def _either(patterns) -> re.Pattern:
        found = "|".join(dict.fromkeys(patterns))
        return re.compile(found) if found else re.compile(r"(?!)")


class Share(InputPartition):
    """The files of a database directory whose name's checksum is ``part`` modulo ``parts``."""

    def __init__(self, database: str, part: int, parts: int):
        self.database, self.part, self.parts = database, part, parts


class DefinitionFiles(DataSource):
    """Options: ``path``; for reading ``targets`` (one pattern to a line) and ``tasks`` (partitions aimed at)."""

    @classmethod
    def name(cls) -> str:
        return "definition_files"

    def schema(self) -> str:
        return "path string, content binary, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return DefinitionReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return DefinitionWriter(self.options["path"], schema.fieldNames(), overwrite)


class DefinitionReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base, self.names = options["path"].rstrip("/"), Names.of(dict(options))
        self.tasks = int(options.get("tasks", 32))

    def partitions(self) -> list[InputPartition]:
        store, root = file_system(self.base)
        wanted = self.names.databases()
        found = [name for info, name in _listed(store, root) if name is not None and info.type == fs.FileType.Directory]
        found = [name for name in found if wanted.fullmatch(name)]
        # Few directories may hold many files each; many directories are tasks enough.
        parts = -(-self.tasks // len(found)) if found else 1
        return [Share(name, part, parts) for name in sorted(found) for part in range(parts)] or [Share("", 0, 1)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._files(partition) if partition.database else ():
            rows.append(row)
            held += len(row[1] or b"")
            if held >= BATCH_BYTES or len(rows) == BATCH_FILES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _files(self, share: Share) -> Iterator[tuple[str, bytes | None, str | None]]:
        store, root = file_system(self.base)
        wanted = self.names.tables(share.database)
        for info, name in _listed(store, f"{root.rstrip('/')}/{share.database}"):
            if name is None:
                if share.part == 0:
                    yield f"{self.base}/{share.database}/", None, "name is not UTF-8"
                continue
            table = name.removesuffix(ENDING)
            mine = zlib.crc32(name.encode()) % share.parts == share.part
            if not mine or table in ("", name) or info.type != fs.FileType.File or not wanted.fullmatch(table):
                continue
            try:
                with store.open_input_stream(info.path) as stream:
                    content, reason = stream.read(), None
            except OSError as error:
                content, reason = None, f"not readable: {type(error).__name__}"
            yield f"{self.base}/{share.database}/{name}", content, reason


def _listed(store: fs.FileSystem, directory: str) -> Iterator[tuple[fs.FileInfo, str | None]]:
    """Files and directories with their names, None for a name that is not UTF-8."""
    for info in store.get_file_info(fs.FileSelector(directory)):
        try:
            yield info, info.base_name
        except UnicodeDecodeError:
            yield info, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), READ)], schema=READ)


class DefinitionWriter(DataSourceArrowWriter):
    """Each file is written under another name and then renamed, so a reader never sees half of one and a task may run again."""

    def __init__(self, base: str, columns: list[str], overwrite: bool):
        lacking = {"database_name", "table_name", "content"} - set(columns)
        if lacking:
            raise ValueError(f"columns are missing: {', '.join(sorted(lacking))}")
        if overwrite:
            raise ValueError("files are added or replaced one by one; use mode('append')")
        self.base, self.columns = base.rstrip("/"), columns

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = file_system(self.base)
        store.create_dir(root)
        made: set[str] = set()
        for batch in iterator:
            columns = [batch.column(self.columns.index(c)).to_pylist() for c in ("database_name", "table_name", "content")]
            for database, table, content in zip(*columns):
                for name in (database, table):
                    if not name or "/" in name or name in (".", ".."):
                        raise ValueError(f"no file name: {name!r}")
                directory = f"{root}/{database}"
                if directory not in made:
                    store.create_dir(directory)
                    made.add(directory)
                unfinished = f"{directory}/.{uuid.uuid4().hex}.unfinished"
                with store.open_output_stream(unfinished) as stream:
                    stream.write(content.encode() if isinstance(content, str) else content or b"")
                store.move(unfinished, f"{directory}/{table}{ENDING}")
        return WriterCommitMessage()
