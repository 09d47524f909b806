"""Re-indexing of changed files as a stream.

File events (path, ts, action, text) are debounced by session windows: of a
burst of a file's events the last action and text win. A burst is handed on
once the watermark has passed its end; events older than the watermark are late
and dropped on purpose (the file's next change brings it up to date). Each
micro-batch analyzes its files once and writes them as one folder named by its
number, so a batch that is run again after a failure replaces itself, and a
reader sees a batch as a whole or not at all. A file's rows are those of its
last batch (merge on read); ``compact`` folds old batches into one.

Deleted files have no rows; a file whose analyzer fails keeps the rows it had;
files without an analyzer and events without a path are passed over.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.sources import analyzers
from siftwright.streaming.events import bursts as in_bursts

DELETE = "delete"
LIST = "path string, last timestamp, bursts long, action string, extension string, symbols array<struct<{}>>, edges array<struct<{}>>, error string, batch long"


def schema() -> str:
    return LIST.format(*(", ".join(f"{n}: {k}" for n, k in (x.split(" ") for x in s.split(", "))) for s in (analyzers.SYMBOL, analyzers.EDGE)))


def debounced(events: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds", tick: str | None = None) -> DataFrame:
    """(path, start, end, events, last, action, text): a row per burst; of events
    at one instant the greatest (action, text) is the last. ``tick`` as in ``bursts``."""
    last = F.max(F.struct("ts", "action", "text"))
    out = in_bursts(events, "path", "ts", gap, tick, late).agg(F.min("ts").alias("start"), F.count("*").alias("events"), last.alias("e"))
    return out.select("path", "start", F.col("w.end").alias("end"), "events", F.col("e.ts").alias("last"), F.col("e.action").alias("action"), F.col("e.text").alias("text"))


def indexed(bursts: DataFrame, registry: analyzers.Registry) -> DataFrame:
    """A row per file of a batch: its last burst, analyzed unless it was deleted."""
    known = F.lower(F.element_at(F.split("path", "[.]"), -1)).isin(registry.extensions()) & F.col("path").contains(".")
    bursts = bursts.where(F.col("path").isNotNull() & known)
    last = bursts.groupBy("path").agg(F.max(F.struct("last", "action", "text")).alias("e"), F.count("*").alias("bursts"))
    last = last.select("path", "e.last", "bursts", "e.action", "e.text")
    gone = last.where(F.col("action") == DELETE).drop("text")
    live = last.where(F.col("action") != DELETE)
    found = analyzers.index(live, registry).withColumnRenamed("path", "p_")
    rows = live.drop("text").join(found, F.col("path") == F.col("p_")).drop("p_")
    return rows.unionByName(gone, allowMissingColumns=True)


def into(target: str, registry: analyzers.Registry) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: write a batch's files to ``target``."""

    def write(batch: DataFrame, number: int) -> None:
        indexed(batch, registry).write.mode("overwrite").parquet(f"{target}/batches/batch={number}")

    return write


def run(events: DataFrame, target: str, checkpoint: str, registry: analyzers.Registry, gap: str = "300 milliseconds", late: str = "10 seconds", tick: str | None = None, **trigger) -> None:
    """Index what has come since the last run and stop (``trigger`` may be another,
    such as ``processingTime``; then it runs until it is stopped)."""
    stream = debounced(events, gap, late, tick).writeStream.foreachBatch(into(target, registry))
    stream.outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start().awaitTermination()


def folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete folders ``name=N`` within ``path``."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(name + "=")]
    return sorted(int(p.getName().partition("=")[2]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def log(spark: SparkSession, target: str) -> DataFrame:
    """Every kept row of every file: the newest compacted table and the batches after it."""
    bases, batches = folders(spark, f"{target}/bases", "base"), folders(spark, f"{target}/batches", "batch")
    upto = bases[-1] if bases else -1
    columns = schema().removesuffix(", batch long")
    out = spark.createDataFrame([], schema())
    if bases:
        out = spark.read.schema(schema()).parquet(f"{target}/bases/base={upto}")
    fresh = [f"{target}/batches/batch={n}" for n in batches if n > upto]
    if fresh:
        rows = spark.read.schema(f"{columns}, batch long").option("basePath", f"{target}/batches").parquet(*fresh)
        out = out.unionByName(rows) if bases else rows
    return out


def files(spark: SparkSession, target: str) -> DataFrame:
    """A row per file: its last batch that could be analyzed."""
    rows = log(spark, target)
    every = F.struct(*[F.col(c) for c in rows.columns if c != "path"])
    last = rows.where("error is null").groupBy("path").agg(F.max_by(every, F.struct("last", "batch")).alias("r"), F.sum("bursts").alias("all_bursts"))
    return last.select("path", "r.*", "all_bursts").drop("bursts").withColumnRenamed("all_bursts", "bursts")


def snapshot(spark: SparkSession, target: str, what: str) -> DataFrame:
    """``symbols`` or ``edges`` of the live files, or the ``errors`` of all batches."""
    return analyzers.parts(log(spark, target) if what == "errors" else files(spark, target), what)


def compact(spark: SparkSession, target: str) -> None:
    """Fold the batches so far into one table; readers turn to it once it is
    complete. Deleted files stay as rows without symbols, so an older row of
    theirs can't come back."""
    batches = folders(spark, f"{target}/batches", "batch")
    if batches:
        files(spark, target).write.mode("overwrite").parquet(f"{target}/bases/base={batches[-1]}")
