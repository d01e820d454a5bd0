"""Numbered states of a table in a folder: which of its files count, replaced as a whole.

``<path>/_state/<number>.json`` is written under another name and renamed, so a reader sees the old
state or the new one, and of two writers of the same number one fails.  Files that only earlier states
name are removed one state later: a reader of the state before the current one can finish.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """The few file-system calls needed, through Hadoop, so that any store Spark reads will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, folder: str) -> list[str]:
        place = self.at(folder)
        if not self.fs.exists(place):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(place))

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def read(self, path: str) -> Any:
        stream = self.fs.open(self.at(path))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_new(self, path: str, content: Any) -> bool:
        """Write a file that must not exist yet; false if it does."""
        folder, name = path.rsplit("/", 1)
        waiting = self.at(f"{folder}/.{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(waiting, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        if not self.fs.exists(self.at(path)) and self.fs.rename(waiting, self.at(path)):
            return True
        self.fs.delete(waiting, False)
        return False


def _numbers(files: Files) -> list[int]:
    return [int(n[:-5]) for n in files.names(f"{files.path}/_state") if n.endswith(".json") and not n.startswith(".")]


def current(files: Files) -> tuple[int, dict] | None:
    """Number and content of the newest state, None for a folder without one."""
    numbers = _numbers(files)
    return (numbers[-1], files.read(f"{files.path}/_state/{numbers[-1]:012d}.json")) if numbers else None


def advance(files: Files, number: int, state: dict) -> None:
    """Make ``state`` number ``number``, then remove what neither it nor the state before names.
    ``state["folders"]`` lists the folders, below the path, whose files count."""
    if not files.write_new(f"{files.path}/_state/{number:012d}.json", state):
        raise RuntimeError(f"another writer has changed {files.path}")
    older = [n for n in _numbers(files) if n < number]
    if not older:
        return
    kept = set(state["folders"]) | set(files.read(f"{files.path}/_state/{older[-1]:012d}.json")["folders"])
    for n in older[:-1]:
        place = f"{files.path}/_state/{n:012d}.json"
        for folder in set(files.read(place)["folders"]) - kept:
            files.remove(f"{files.path}/{folder}")
        files.remove(place)
