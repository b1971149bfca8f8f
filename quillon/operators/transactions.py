"""Publishing snapshots: versioned folders and a manifest that is swapped, and lists of operations that happen together or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class CommitConflict(RuntimeError):
    """Another commit came first; nothing of this one is to be seen."""


class Snapshots:
    """Tables under a root: <root>/<table>/v<N>-<attempt>, and <root>/_manifest/<K>.json naming each table's current version.

    A commit writes all new folders first and then one manifest; readers take the last manifest, so they see all of a commit or
    nothing of it. Each attempt has folders of its own, so that no committer touches what another one has written. Two committers
    at once are told apart by the manifest's number: it is written aside and then named in one step that fails where the name
    is taken (a hard link on local disks, a rename elsewhere); the second raises CommitConflict and its folders are deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at = self.path(f"{self.root}/_manifest")
        return sorted(int(s.getPath().getName()[:-5]) for s in self.fs.listStatus(at) if s.getPath().getName().endswith(".json")) if self.fs.exists(at) else []

    def current(self) -> tuple[int, dict[str, str]]:
        numbers = self._manifests()
        if not numbers:
            return 0, {}
        stream = self.fs.open(self.path(f"{self.root}/_manifest/{numbers[-1]}.json"))
        try:
            return numbers[-1], json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        versions = self.current()[1]
        if table not in versions:
            raise KeyError(table)
        return self.spark.read.parquet(f"{self.root}/{versions[table]}")

    def commit(self, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> int:
        number, versions = self.current()
        attempt, versions = uuid.uuid4().hex[:12], dict(versions)
        try:
            for name, df in tables.items():
                versions[name] = f"{name}/v{number + 1}-{attempt}"
                df.write.mode("errorifexists").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{self.root}/{versions[name]}")
            self._publish(number + 1, json.dumps(versions), attempt)
        except Exception:
            for name in tables:
                if versions.get(name, "").endswith(attempt):
                    self.fs.delete(self.path(f"{self.root}/{versions[name]}"), True)
            raise
        return number + 1

    def _publish(self, number: int, text: str, attempt: str) -> None:
        aside, name = self.path(f"{self.root}/_manifest/{attempt}.tmp"), self.path(f"{self.root}/_manifest/{number}.json")
        out = self.fs.create(aside, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        try:
            if self.fs.getUri().getScheme() == "file":
                file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                try:
                    self.jvm.java.nio.file.Files.createLink(file(name), file(aside))
                    done = True
                except Py4JJavaError as x:
                    if "FileAlreadyExistsException" not in str(x.java_exception.getClass().getName()):
                        raise
                    done = False
            else:
                done = not self.fs.exists(name) and self.fs.rename(aside, name)
        finally:
            self.fs.delete(aside, False)
        if not done:
            raise CommitConflict(f"commit {number} came from somewhere else")


Operation = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


@dataclass
class Transaction:
    """Operations on snapshots, applied in order and published together. rollback forgets them."""

    snapshots: Snapshots
    pending: list[Operation] = field(default_factory=list)
    store: str | None = None

    def add(self, operation: Operation, store: str | None = None) -> None:
        if self.pending and store != self.store:
            raise ValueError("a change-set writes to one store")
        self.store = store
        self.pending.append(operation)

    def tables(self) -> dict[str, DataFrame]:
        return _Lazy(self.snapshots)

    def save_changes(self) -> int:
        seen = self.tables()
        new: dict[str, DataFrame] = {}
        for op in self.pending:
            made = op(seen)
            seen.update(made)
            new |= made
        self.pending.clear()
        return self.snapshots.commit(new) if new else self.snapshots.current()[0]

    def rollback(self) -> None:
        self.pending.clear()


class _Lazy(dict):
    """Tables as they are read."""

    def __init__(self, snapshots: Snapshots):
        super().__init__()
        self.snapshots = snapshots

    def __missing__(self, name: str) -> DataFrame:
        self[name] = df = self.snapshots.read(name)
        return df


@dataclass
class ChangeSet:
    operations: list[Operation]


def run_batch(session: Any, snapshots: Snapshots, items: list[Any]) -> list[Any]:
    """Queries (URLs) and change-sets in order: a frame or a commit number for each. A failed change-set changes nothing."""
    out = []
    for item in items:
        if isinstance(item, ChangeSet):
            t = Transaction(snapshots)
            for op in item.operations:
                t.add(op)
            out.append(t.save_changes())
        else:
            out.append(session.query(item))
    return out
