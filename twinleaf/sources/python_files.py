"""Data source of Python files under a directory.

Spark's own file sources skip names that begin with an underscore or a dot, which Python trees are full of, so the listing is
done here: excluded directories are pruned while walking, links to directories are not followed, and files are dealt to partitions by
size. The directory must be visible to the executors under the same path.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Directories that are never scanned, by name at any depth below the root.
EXCLUDED_DIRS = frozenset(
    [
        "__pycache__",
        ".git",
        ".hg",
        ".mypy_cache",
        ".pytest_cache",
        ".ruff_cache",
        ".tox",
        ".nox",
        ".venv",
        "venv",
        "site-packages",
        "build",
        "dist",
        ".eggs",
    ]
)

SCHEMA = "rel string, path string, content binary, read_error string"


class FileBatch(InputPartition):
    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(0)
        self.files = files


def list_files(root: str) -> Iterator[tuple[str, str, int]]:
    """(path relative to the root, path, size) of all Python files, in no particular order."""
    pending = [""]
    while pending:
        at = pending.pop()
        with os.scandir(os.path.join(root, at) if at else root) as entries:
            for entry in entries:
                rel = f"{at}/{entry.name}" if at else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if entry.name not in EXCLUDED_DIRS:
                        pending.append(rel)
                elif entry.name.endswith(".py") and entry.is_file():
                    yield rel, os.path.normpath(os.path.join(root, rel)), entry.stat().st_size


class PythonFilesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.batch_bytes = int(options.get("batchBytes", 4 << 20))

    def partitions(self) -> list[FileBatch]:
        batches: list[FileBatch] = []
        held: list[tuple[str, str]] = []
        size = 0
        for rel, path, n in list_files(self.root):
            held.append((rel, path))
            size += n + 4096
            if size >= self.batch_bytes:
                batches.append(FileBatch(held))
                held, size = [], 0
        return [*batches, FileBatch(held)]

    def read(self, partition: FileBatch) -> Iterator[tuple]:
        for rel, path in partition.files:
            try:
                with open(path, "rb") as file:
                    yield rel, path, file.read(), None
            except OSError as error:
                yield rel, path, None, f"{type(error).__name__}: {error}"


class PythonFiles(DataSource):
    """spark.read.format("python_files").load(directory)"""

    @classmethod
    def name(cls) -> str:
        return "python_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PythonFilesReader:
        return PythonFilesReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PythonFiles)
