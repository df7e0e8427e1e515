"""Folders of skill files and of golden sets as Spark data sources: ``spark.read.format("ragloom_skills").load(folder)`` and
``ragloom_golden``, in batches and as streams.

Files are listed once where the query is planned and dealt to tasks in groups of bounded size; a task reads its own files. A file or line
that can't be read is a row that says why. A stream's offset is the time of change up to which files were read, so each
version of a file comes once. Filters on ``path`` are taken over, where Spark hands them down
(``spark.sql.python.filterPushdown.enabled``), and leave out files before they are read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Bytes of files that a task is given.
GROUP_BYTES = 8 << 20
_FRONT = re.compile(r"\A﻿?---\s*\n(.*?)\n---[^\n]*\n?(.*)\Z", re.S)


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


def listed(folder: str, suffix: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of the files below a folder whose name ends so, by path."""
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and "/_" not in f.path[len(root) :])


def groups(files: list[tuple[str, int, int]], most: int = GROUP_BYTES) -> list[FileGroup]:
    out, size = [], most
    for path, length, _ in files:
        if size + length > most and (size or not out):
            out.append(FileGroup([]))
            size = 0
        out[-1].paths.append(path)
        size += length
    return out


def skill_rows(path: str, text: str) -> Iterator[tuple]:
    front = _FRONT.match(text)
    if not front:
        yield (path, None, None, None, None, "no front matter")
        return
    told = {}
    for line in front[1].split("\n"):
        if ":" in line and not line.lstrip().startswith("#"):
            name, value = line.split(":", 1)
            told[name.strip()] = value.strip().strip("'\"")
    body = front[2].strip()
    error = None if told.get("id") and body else "no id" if not told.get("id") else "no body"
    yield (path, told.get("id") or None, told.get("name"), told.get("description"), body, error)


def golden_rows(path: str, text: str) -> Iterator[tuple]:
    for no, line in enumerate(text.split("\n"), 1):
        bare = line.strip()
        if not bare or bare.startswith("//"):
            continue
        try:
            item = json.loads(bare)
            evidences = [e for e in item.get("evidences") or [] if e.strip()]
            yield (path, no, str(item["id"]) if "id" in item else None, item["question"], evidences, item.get("category"), None)
        except (ValueError, KeyError, AttributeError, TypeError) as e:
            yield (path, no, None, None, [], None, f"line {no}: {type(e).__name__}")


class _Kind:
    """What both readers of a source share."""

    def __init__(self, folder: str, suffix: str, parse, width: int):
        self.folder, self.suffix, self.parse, self.width = folder, suffix, parse, width

    def rows(self, group: FileGroup) -> Iterator[tuple]:
        for path in group.paths:
            store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
            try:
                with store.open_input_stream(at) as file:
                    text = file.read().decode("utf-8")
            except (OSError, UnicodeDecodeError) as e:
                yield (path, *[None] * (self.width - 2), type(e).__name__)
                continue
            yield from self.parse(path, text)


class FilesReader(DataSourceReader):
    def __init__(self, kind: _Kind):
        self.kind, self.wanted = kind, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("path",):
                yield f  # left to Spark
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[FileGroup]:
        files = listed(self.kind.folder, self.kind.suffix)
        return groups([f for f in files if self.wanted is None or f[0] in self.wanted])

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        return self.kind.rows(partition) if partition else iter(())


class FilesStreamReader(DataSourceStreamReader):
    def __init__(self, kind: _Kind):
        self.kind = kind

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed_ns": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed_ns": max([f[2] for f in listed(self.kind.folder, self.kind.suffix)], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[FileGroup]:
        return groups([f for f in listed(self.kind.folder, self.kind.suffix) if start["changed_ns"] < f[2] <= end["changed_ns"]])

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        return self.kind.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class _Files(DataSource):
    suffix, parse, columns = "", None, ""

    def schema(self) -> str:
        return self.columns

    def _kind(self) -> _Kind:
        if "path" not in self.options:
            raise ValueError("load() needs a folder")
        return _Kind(self.options["path"].removeprefix("file://"), self.suffix, type(self).parse, len(self.columns.split(", ")))

    def reader(self, schema) -> FilesReader:
        return FilesReader(self._kind())

    def streamReader(self, schema) -> FilesStreamReader:  # noqa: N802
        return FilesStreamReader(self._kind())


class SkillFiles(_Files):
    """``SKILL.md`` files: path, id, name, description, body, error."""

    suffix, parse, columns = "SKILL.md", staticmethod(skill_rows), "path string, id string, name string, description string, body string, error string"

    @classmethod
    def name(cls) -> str:
        return "ragloom_skills"


class GoldenSets(_Files):
    """JSON lines of golden items: path, line, id, question, evidences, category, error."""

    suffix, parse, columns = ".jsonl", staticmethod(golden_rows), "path string, line int, id string, question string, evidences array<string>, category string, error string"

    @classmethod
    def name(cls) -> str:
        return "ragloom_golden"


def register(spark: SparkSession) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(SkillFiles)
    spark.dataSource.register(GoldenSets)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
