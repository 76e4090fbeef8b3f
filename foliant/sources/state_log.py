"""Job states as a log of writes with snapshots: the last write of a job counts.

    folder/log/<n>             a write, numbered by a claim that only one writer can make
    folder/snapshots/<id>      the latest states as some compaction found them
    folder/generations/<g>     which snapshot holds, the writes that it has, and the last of them

A reader takes the highest generation, its snapshot and the writes that it does not have, so it sees the states before a
compaction or after it, never a half of one: a generation comes into being by the rename of a whole file. Writes that did
not end, and snapshots without a generation, are not read. All of it goes through Spark's own file systems.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class _Files:
    """A folder in whatever store Spark finds it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, name: str) -> list[str]:
        p = self.path(name)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def claim(self, name: str) -> bool:
        """Whether this writer made the file; one that is there already is another's."""
        try:
            self.fs.create(self.path(name), False).close()
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        return True

    def write(self, name: str, text: str) -> bool:
        """A whole file at once, if none of that name is there."""
        draft = f".draft-{uuid.uuid4().hex}"
        out = self.fs.create(self.path(draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(self.path(name).getParent())
        if not self.exists(name) and self.fs.rename(self.path(draft), self.path(name)):
            return True
        self.drop(draft)
        return False

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


def _numbers(names: list[str]) -> list[int]:
    return sorted(int(n) for n in names if n.isdigit())


def _ended(files: _Files) -> list[int]:
    return [n for n in _numbers(files.names("log")) if files.exists(f"log/{n}/_SUCCESS")]


@dataclass(frozen=True)
class _Generation:
    number: int = 0
    snapshot: str | None = None
    held: frozenset[int] = frozenset()
    last: int = 0


def _generation(files: _Files) -> _Generation:
    """The generation that holds; its number is 0 before the first compaction."""
    known = _numbers(files.names("generations"))
    if not known:
        return _Generation()
    said = json.loads(files.read(f"generations/{known[-1]}"))
    return _Generation(known[-1], said["snapshot"], frozenset(said["held"]), said["last"])


def write_states(states: DataFrame, folder: str, key: str = "job_id", stamp: Column | None = None) -> int:
    """Adds states (key and any columns) as one write, stamped with the time (updated_at), and returns its number.

    Every write has the columns of the first. Of rows of one key in one write, that with the latest stamp counts.
    """
    files = _Files(states.sparkSession, folder)
    n = max([_generation(files).last, *_numbers(files.names("log")), *_numbers(files.names("claims"))]) + 1
    while not files.claim(f"claims/{n}"):
        n += 1
    stamped = states.where(F.col(key).isNotNull()).withColumn("updated_at", F.current_timestamp() if stamp is None else stamp)
    stamped.withColumn("_write", F.lit(n).cast("long")).write.parquet(f"{files.folder}/log/{n}")
    return n


def _states(spark: SparkSession, files: _Files, key: str, holds: _Generation, ended: list[int]) -> DataFrame | None:
    parts = [f"{files.folder}/log/{n}" for n in ended if n not in holds.held]
    if holds.snapshot is not None:
        parts.append(f"{files.folder}/snapshots/{holds.snapshot}")
    if not parts:
        return None
    rows = spark.read.parquet(*parts)
    names = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_write", "updated_at")).alias("s")).select(key, "s.*")


def read_states(spark: SparkSession, folder: str, key: str = "job_id") -> DataFrame | None:
    """The latest state of every key, or None where nothing was written yet."""
    files = _Files(spark, folder)
    found = _states(spark, files, key, _generation(files), _ended(files))
    return None if found is None else found.drop("_write")


def compact(spark: SparkSession, folder: str, key: str = "job_id", keep: int = 1) -> int:
    """Writes the latest states as a snapshot, makes it the next generation, and returns the generation that then holds.

    Where another compaction makes that generation first, its snapshot holds, and this one's goes. Files of generations
    before the last `keep` are dropped: readers of a later one can still end.
    """
    files = _Files(spark, folder)
    holds, ended = _generation(files), _ended(files)
    states = _states(spark, files, key, holds, ended)
    if states is None or not set(ended) - holds.held:
        return holds.number
    snapshot, following = uuid.uuid4().hex, holds.number + 1
    states.write.parquet(f"{files.folder}/snapshots/{snapshot}")
    there = set(_numbers(files.names("log")))
    said = {"snapshot": snapshot, "held": sorted((set(ended) | holds.held) & there), "last": max([holds.last, *ended])}
    if not files.write(f"generations/{following}", json.dumps(said)):
        files.drop(f"snapshots/{snapshot}")
        return _generation(files).number
    for g in _numbers(files.names("generations")):
        if g < following - keep:
            old = json.loads(files.read(f"generations/{g}"))
            for name in [f"snapshots/{old['snapshot']}", *(f"{kind}/{n}" for n in old["held"] for kind in ("log", "claims")), f"generations/{g}"]:
                files.drop(name)
    return following
