"""A data source that writes one file per row and reads them back, and file operations below an output folder.

Tasks write into a staging folder of their own attempt; the driver moves the folders of the attempts that
count into place when the whole job has succeeded, and drops the others. A task that runs twice, or whose
executor is lost, leaves one copy of each file. Readers get a partition per such folder, so that neither the
driver nor a single task lists all files.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from peptarium.session import spread

FORMAT = "row_files"
_STAGED = "_staged"
_DONE = "part-"


def opened(path: str):
    """(pyarrow file system, path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    n: int


class RowFileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        """Rows are (file name, content)."""
        files, root = opened(self.path)
        folder = posixpath.join(root, _STAGED, self.job, uuid.uuid4().hex)
        files.create_dir(folder, recursive=True)
        names = []
        for row in iterator:
            if "/" in row[0] or not row[0]:
                raise ValueError(f"not a file name: {row[0]!r}")
            with files.open_output_stream(posixpath.join(folder, row[0])) as out:
                out.write((row[1] or "").encode())
            names.append(row[0])
        if len(set(names)) != len(names):
            raise ValueError("two rows of one name")
        return Staged(folder, len(names))

    def commit(self, messages: list[Staged | None]) -> None:
        """Each task's folder becomes ``part-<n>``: one move per task, however many files it holds."""
        files, root = opened(self.path)
        if self.overwrite:
            for name in listed(self.path):
                if name.startswith(_DONE):
                    files.delete_dir(posixpath.join(root, name))
        for message in messages:
            if message is not None and message.n:
                files.move(message.folder, posixpath.join(root, f"{_DONE}{posixpath.basename(message.folder)}"))
        self._clear(files, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        staged = posixpath.join(root, _STAGED, self.job)
        if files.get_file_info(staged).type == fs.FileType.Directory:
            files.delete_dir(staged)


@dataclass
class Folder(InputPartition):
    name: str


class RowFileReader(DataSourceReader):
    def __init__(self, path: str, content: bool):
        self.path, self.content = path.rstrip("/"), content

    def partitions(self) -> list[Folder]:
        return [Folder(name) for name in listed(self.path) if name.startswith(_DONE)]

    def read(self, partition: Folder) -> Iterator[tuple]:
        """(path, name, value); the value is null unless the contents are wanted."""
        from pyarrow import fs

        files, root = opened(self.path)
        for found in files.get_file_info(fs.FileSelector(posixpath.join(root, partition.name))):
            value = None
            if self.content:
                with files.open_input_stream(found.path) as data:
                    value = data.read().decode()
            yield f"{self.path}/{partition.name}/{found.base_name}", found.base_name, value


class RowFiles(DataSource):
    """``df.write.format("row_files")`` for (name, content) rows, and their reader; options ``path``, ``content``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, name string, value string"

    def reader(self, schema: StructType) -> RowFileReader:
        return RowFileReader(self.options["path"], self.options.get("content", "true") == "true")

    def writer(self, schema: StructType, overwrite: bool) -> RowFileWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string", "string"]:
            raise ValueError("rows must be (name string, content string)")
        return RowFileWriter(self.options["path"], overwrite)


def write_row_files(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Write (name, content) rows as files below ``out``; rows of one name are an error within a task."""
    spark = df.sparkSession
    spark.dataSource.register(RowFiles)
    spread(df.toDF("name", "content"), "name").write.format(FORMAT).mode(mode).option("path", out).save()


def read_row_files(spark: SparkSession, path: str, content: bool = True) -> DataFrame | None:
    """(path, name, value) of a folder that ``write_row_files`` wrote; None for any other."""
    from pyarrow import ArrowException

    try:
        names = listed(path)
    except (ArrowException, OSError):  # a store that only Spark opens
        return None
    if not names or not all(n.startswith(_DONE) and "." not in n for n in names if n != _STAGED):
        return None
    spark.dataSource.register(RowFiles)
    return spark.read.format(FORMAT).option("path", path).option("content", str(content).lower()).load()


def listed(path: str) -> list[str]:
    """Names directly below a folder; none if it is not there."""
    from pyarrow import fs

    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return [f.base_name for f in found]


def drop_partition(path: str, column: str, value: str) -> None:
    """Remove the folder of one partition value, if there is one."""
    files, root = opened(path.rstrip("/"))
    for name in listed(path):
        key, _, held = name.partition("=")
        if key == column and unquote(held) == value:
            files.delete_dir(posixpath.join(root, name))
