"""Tables that are rewritten in place: versioned folders under one path.

A version is a commit file with a number, which names the folders that hold its rows
and what they were made for. It is created only if no file has that number, and
counts only once it is written whole, so a reader, and whoever comes after a crash,
sees one version or the next, never a mixture. Two writers that start from the same
version can't both commit. Works on any file system of Spark's that creates files
exclusively.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEPT = 2  # versions whose folders stay for readers that began with them
HISTORY = 200


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _commit(self, number: int) -> dict | None:
        """A commit's contents; None if it was never finished."""
        stream = self.files.open(self._at("commits", f"{number:012d}"))
        try:
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("\n") else None

    def _numbers(self) -> list[int]:
        folder = self._at("commits")
        if not self.files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self.files.listStatus(folder) if s.getPath().getName().isdigit())

    def _last(self) -> tuple[int, dict]:
        """The highest number that is taken, and the last whole version (no folders: none yet)."""
        numbers = self._numbers()
        for number in reversed(numbers):
            if (found := self._commit(number)) is not None:
                return numbers[-1], found
        return numbers[-1] if numbers else 0, {"folders": [], "meta": {}}

    @property
    def meta(self) -> dict:
        """What the current version was made for."""
        return self._last()[1]["meta"]

    def exists(self) -> bool:
        return bool(self._last()[1]["folders"])

    def read(self) -> DataFrame:
        """The rows of the current version; it stays readable for KEPT - 1 rewrites."""
        folders = self._last()[1]["folders"]
        if not folders:
            raise FileNotFoundError(f"no version under {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def _written(self, rows: DataFrame, partition_by: list[str]) -> str:
        name = f"data-{uuid.uuid4().hex}"
        rows.write.partitionBy(*partition_by).parquet(f"{self.path}/{name}")
        return name

    def _publish(self, taken: int, folders: list[str], meta: dict) -> None:
        try:
            stream = self.files.create(self._at("commits", f"{taken + 1:012d}"), False)
        except Exception as e:  # Py4J's error around the file system's
            raise Conflict(f"version {taken + 1} of {self.path} is taken") from e
        stream.write(bytearray(json.dumps({"folders": folders, "meta": meta}).encode() + b"\n"))
        stream.close()
        self._forget()

    def _forget(self) -> None:
        """Deletes folders that only versions before the last KEPT name."""
        commits = {n: self._commit(n) for n in self._numbers()}
        whole = [n for n, found in commits.items() if found is not None][-KEPT:]
        needed = {f for n in whole for f in commits[n]["folders"]}
        for n, found in commits.items():
            if n < whole[0]:
                for folder in (found or {"folders": []})["folders"]:
                    if folder not in needed:
                        self.files.delete(self._at(folder), True)
                self.files.delete(self._at("commits", f"{n:012d}"), False)

    def replace(self, rows: DataFrame, meta: dict | None = None, partition_by: list[str] = ()) -> None:
        """``rows`` as the next version."""
        taken, _ = self._last()
        self._publish(taken, [self._written(rows, partition_by)], meta or {})

    def append(self, rows: DataFrame, partition_by: list[str] = ()) -> None:
        """The current rows and ``rows`` as the next version, without writing the former again."""
        taken, now = self._last()
        self._publish(taken, [*now["folders"], self._written(rows, partition_by)], now["meta"])

    def rewrite(self, change: Callable[[DataFrame], DataFrame]) -> None:
        """What ``change`` makes of the current rows as the next version."""
        taken, now = self._last()
        rows = self.spark.read.parquet(*[f"{self.path}/{f}" for f in now["folders"]])
        self._publish(taken, [self._written(change(rows), [])], now["meta"])


def remember(rows: DataFrame, path: str, order: str = "updated_at", most: int = HISTORY) -> None:
    """Adds ``rows`` to a history, of which the last ``most`` by ``order`` stay."""
    table = Versions(rows.sparkSession, path)
    if not table.exists():
        table.replace(rows.orderBy(F.desc(order)).limit(most))
    else:
        table.rewrite(lambda old: old.unionByName(rows).orderBy(F.desc(order)).limit(most))


def remembered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A history; empty where there is none yet."""
    table = Versions(spark, path)
    return table.read() if table.exists() else spark.createDataFrame([], schema)
