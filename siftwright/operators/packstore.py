"""A bounded registry of finished packs: the newest stay, older ones go.

A pack is a folder named by its time and id, with its rows and one row about it.
Saving an id again replaces it. Listing reads the rows about packs, ``get`` one
pack's rows, and neither reads the others.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: packs that are kept.
KEEP = 20
ENTRY = "id string, mode string, query string, created_ms long, tokens long"


@dataclass
class PackStore:
    spark: SparkSession
    path: str
    keep: int = KEEP
    clock: Callable[[], float] = time.time

    def _fs(self, place: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _folders(self) -> list[str]:
        """Names of complete packs, newest first."""
        fs, at = self._fs(self.path)
        if not fs.exists(at):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted((f.getPath().getName() for f in fs.listStatus(at) if fs.exists(done(f.getPath(), "entry/_SUCCESS"))), reverse=True)

    def _drop(self, names: list[str]) -> None:
        for n in names:
            fs, at = self._fs(f"{self.path}/{n}")
            fs.delete(at, True)

    def _of(self, id: str) -> list[str]:
        return [n for n in self._folders() if n.partition("-")[2] == id]

    def save(self, pack: DataFrame, id: str, mode: str, query: str, tokens: str = "est_tokens") -> None:
        """Write the rows first and the entry last: a pack is seen once it is whole."""
        now = int(self.clock() * 1000)
        name = f"{now:015d}-{id}"
        pack.write.parquet(f"{self.path}/{name}/rows")
        about = self.spark.read.parquet(f"{self.path}/{name}/rows").agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("tokens"))
        about.select(F.lit(id).alias("id"), F.lit(mode).alias("mode"), F.lit(query).alias("query"), F.lit(now).cast("long").alias("created_ms"), "tokens").write.parquet(f"{self.path}/{name}/entry")
        self._drop([n for n in self._of(id) if n != name])
        self._drop(self._folders()[self.keep :])

    def list(self) -> DataFrame:
        """(id, mode, query, created_ms, tokens), newest first."""
        names = self._folders()
        if not names:
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).parquet(*[f"{self.path}/{n}/entry" for n in names]).orderBy(F.desc("created_ms"), F.desc("id"))

    def get(self, id: str) -> DataFrame | None:
        names = self._of(id)
        return self.spark.read.parquet(f"{self.path}/{names[0]}/rows") if names else None

    def delete(self, id: str) -> bool:
        names = self._of(id)
        self._drop(names)
        return bool(names)
