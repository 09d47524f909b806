"""Candidates of a debugging task: evidence first, then every symbol by what is known of its file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions import text as tx
from siftwright.operators import classify, graph, workspace

#: Characters of a signal's title and lines of its excerpt; the path
#: of a signal without one.
TITLE_CHARS, STACK_LINES, NO_PATH = 80, 10, "runtime"


def signal_items(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(path, title, excerpt, kind, confidence), an item for each message of
    ``signals`` (ord, message, paths, stack): that of the first signal."""
    weight = {**classify.DEBUG, **(weights or {})}["runtime_signal"]
    first = signals.groupBy("message").agg(F.min_by(F.struct("paths", "stack"), "ord").alias("s"))
    stack = F.array_join(F.slice("s.stack", 1, STACK_LINES), "\n")
    return first.select(
        F.coalesce(F.get("s.paths", 0), F.lit(NO_PATH)).alias("path"), F.substring("message", 1, TITLE_CHARS).alias("title"),
        F.when(F.size("s.stack") > 0, stack).otherwise(F.col("message")).alias("excerpt"), F.lit("runtime_signal").alias("kind"), F.lit(weight).alias("confidence"),
    )


def debug_symbols(symbols: DataFrame, edges: DataFrame, signals: DataFrame, past: DataFrame, changed: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``symbols`` (node, path, ...) with ``kind`` and ``confidence``. Files of
    signals and of earlier failures are met by path or by name, since traces
    have other roots; with any signal every test file is suspect, else the tests
    of changed files. ``edges`` is (src, dst) over nodes, ``signals`` has paths,
    ``past`` and ``changed`` are (path)."""

    def keys(df: DataFrame, name: str) -> DataFrame:
        both = df.select(F.explode(F.array("path", tx.basename(F.col("path")))).alias("k_")).where("k_ is not null")
        return both.distinct().withColumn(name, F.lit(True))

    def met(df: DataFrame, known: DataFrame, name: str) -> DataFrame:
        """With ``name``: whether a row's path or its file's name is known."""
        for column, key in ((f"{name}_path", F.col("path")), (f"{name}_name", tx.basename(F.col("path")))):
            df = df.join(known.select(F.col("k_").alias(f"{column}_key"), F.col(name).alias(column)), key == F.col(f"{column}_key"), "left").drop(f"{column}_key")
        return df.withColumn(name, F.coalesce(f"{name}_path", f"{name}_name", F.lit(False))).drop(f"{name}_path", f"{name}_name")

    paths = symbols.select("path").distinct()
    files = met(met(paths, keys(signals.select(F.explode("paths").alias("path")), "signal_"), "signal_"), keys(past, "past_"), "past_")
    mine = changed.select(F.col("path").alias("c_")).distinct()
    files = files.join(mine, F.col("path") == F.col("c_"), "left").withColumn("changed_", F.col("c_").isNotNull()).drop("c_")
    tests = workspace.tests_of_changed(paths, changed).select(F.col("path").alias("t_"))
    files = files.join(tests, F.col("path") == F.col("t_"), "left")
    some = signals.limit(1).agg((F.count("*") > 0).alias("any_"))  # one row
    files = files.join(F.broadcast(some), how="cross").withColumn("failing_", tx.is_test_file(F.col("path")) & (F.col("any_") | F.col("t_").isNotNull())).drop("t_", "any_")
    near = graph.adjacent_files(edges, symbols.select("node", F.col("path").alias("file")), changed)
    files = files.join(near.select(F.col("file").alias("n_")), F.col("path") == F.col("n_"), "left").withColumn("near_", F.col("n_").isNotNull()).drop("n_")
    kind = classify.debug(*[F.col(c) for c in ("signal_", "past_", "changed_", "failing_", "near_")])
    told = files.select(F.col("path").alias("p_"), kind.alias("kind"))
    out = symbols.join(told, F.col("path") == F.col("p_")).drop("p_")
    weight = classify.weight_of(F.col("kind"), classify.DEBUG, weights)
    return out.withColumn("confidence", F.round(classify.changed_prior(F.col("kind"), weight, F.col("path")), 6))
