"""A stored cache of finished results, keyed by what they depend on.

An entry is a folder of its own, named by repository, key and time; its rows are
written once and never changed. A look-up lists folders (no data is read, no job
runs), and a hit reads the entry's files only. The key covers the call's
parameters and a fingerprint of the tables' files, so a result over changed
tables is never found. Entries end after a time to live, and a repository's
entries, or all, can be dropped. Writers at the same time make entries of their
own, and readers take the newest complete one.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def key_of(*parts: object) -> str:
    """SHA-1 of the parts, a pipe after each; None is empty."""
    return hashlib.sha1("".join(f"{'' if p is None else p}|" for p in parts).encode()).hexdigest()


def fingerprint(*tables: DataFrame) -> str:
    """Hash of the names, sizes and times of the files that tables are read from."""
    found = []
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for name in sorted(df.inputFiles()):
            at = jvm.org.apache.hadoop.fs.Path(name)
            info = at.getFileSystem(conf).getFileStatus(at)
            found += [name, info.getLen(), info.getModificationTime()]
    return key_of(*found)


@dataclass
class ResultCache:
    """Entries below ``path``; ``clock`` gives seconds."""

    spark: SparkSession
    path: str
    ttl_seconds: float = 300
    clock: Callable[[], float] = time.time

    def _place(self, repo: str | None = None, key: str = "") -> str:
        out = self.path.rstrip("/")
        return out if repo is None else f"{out}/{key_of(repo)}" + (f"/{key}" if key else "")

    def _open(self, place: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _complete(self, place: str) -> list[tuple[int, str]]:
        """(time in ms, folder) of the complete entries in a folder, oldest first."""
        fs, at = self._open(place)
        if not fs.exists(at):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [f.getPath() for f in fs.listStatus(at) if fs.exists(done(f.getPath(), "_SUCCESS"))]
        return sorted((int(p.getName().split("-")[0]), p.toString()) for p in found)

    def get(self, repo: str, key: str) -> DataFrame | None:
        """The newest entry that is not older than the time to live."""
        found = self._complete(self._place(repo, key))
        if not found or self.clock() - found[-1][0] / 1000 > self.ttl_seconds:
            return None
        return self.spark.read.parquet(found[-1][1])

    def put(self, repo: str, key: str, result: DataFrame) -> DataFrame:
        import uuid

        place = f"{self._place(repo, key)}/{int(self.clock() * 1000)}-{uuid.uuid4().hex}"
        result.write.parquet(place)
        return self.spark.read.schema(result.schema).parquet(place)

    def get_or_build(self, repo: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The entry, or else what ``build`` gives, now stored; on a hit ``build``
        isn't called."""
        found = self.get(repo, key)
        return self.put(repo, key, build()) if found is None else found

    def invalidate(self, repo: str | None = None) -> None:
        """Drop a repository's entries, or all of them."""
        fs, at = self._open(self._place(repo))
        fs.delete(at, True)

    def sweep(self) -> int:
        """Delete entries beyond the time to live; returns how many."""
        fs, at = self._open(self._place())
        gone = 0
        for repo in fs.listStatus(at) if fs.exists(at) else []:
            for key in fs.listStatus(repo.getPath()):
                for made, place in self._complete(key.getPath().toString()):
                    if self.clock() - made / 1000 > self.ttl_seconds:
                        fs.delete(self._open(place)[1], True)
                        gone += 1
        return gone
