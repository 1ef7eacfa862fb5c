"""A Spark data source that lists source trees without entering left out directories."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from repostrata.functions.filters import name_variants

_LARGE = 64 * 1024 * 1024  # bytes of file content that a task hands on at a time


@dataclass
class Folders(InputPartition):
    """Folders to list, each with or without what lies below it."""

    folders: list[tuple[str, bool]]


class SourceTree(DataSource):
    """``(repo, path, length)`` of the Python files below ``<path>/<repo>/``.

    ``deny`` is a JSON list of directory names, left out in lower, upper and capitalised
    spelling at the root of a repository or, with ``depth`` any, everywhere; ``prefixes`` are
    first characters of directory names left out everywhere. The driver lists folders from
    the top until there are ``partitions`` of them; tasks list the rest.
    """

    @classmethod
    def name(cls) -> str:
        return "python_source_tree"

    def schema(self) -> str:
        return "repo string, path string, length bigint"

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.denied = set(name_variants(json.loads(options.get("deny", "[]"))))
        self.prefixes = tuple(options.get("prefixes", ""))
        self.anywhere = options.get("depth", "root") == "any"
        self.wanted = int(options.get("partitions", "64"))
        if options.get("depth", "root") not in ("root", "any"):
            raise ValueError("depth is 'root' or 'any'")

    def _listed(self, folder: str) -> tuple[list[str], list[tuple[str, str, int]]]:
        """Folders to go on with, and Python files, both relative to the root of all trees."""
        store, root = opened(self.uri)
        inner, files = [], []
        for entry in store.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"))):
            path = f"{folder}/{entry.base_name}".lstrip("/")
            if entry.type == fs.FileType.Directory:
                if not folder or not self._left_out(path):
                    inner.append(path)
            elif folder and entry.base_name.endswith(".py"):
                files.append((*path.split("/", 1), entry.size))
        return sorted(inner), sorted(files)

    def _left_out(self, path: str) -> bool:
        below = path.split("/")[1:]
        named = below[-1] in self.denied and (self.anywhere or len(below) == 1)
        return named or below[-1].startswith(self.prefixes or ("/",))

    def partitions(self) -> list[Folders]:
        done, waiting = [], [""]
        while waiting and len(done) + len(waiting) < self.wanted:
            folder = waiting.pop(0)
            done.append((folder, False))
            waiting += self._listed(folder)[0]
        tasks = done + [(folder, True) for folder in waiting]
        size = -(-len(tasks) // self.wanted)
        return [Folders(tasks[i : i + size]) for i in range(0, len(tasks), size)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        for folder, deep in partition.folders:
            waiting = [folder]
            while waiting:
                inner, files = self._listed(waiting.pop())
                yield from files
                if deep:
                    waiting += inner


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    store, root = fs.FileSystem.from_uri(uri)
    return store, root.rstrip("/")


def with_content(files: DataFrame, uri: str) -> DataFrame:
    """``(repo, path, content BINARY)`` of listed files, read in the tasks that hold their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(uri)
        for batch in batches:
            start, size, held = 0, 0, []
            for i, (repo, path) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1)))):
                with store.open_input_stream(f"{root}/{repo}/{path}") as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= _LARGE or i + 1 == batch.num_rows:
                    own = batch.slice(start, len(held))
                    yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(held, pa.binary())], ["repo", "path", "content"])
                    start, size, held = i + 1, 0, []

    return files.select("repo", "path").mapInArrow(run, "repo string, path string, content binary")


# The source travels to the executors by value: they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
