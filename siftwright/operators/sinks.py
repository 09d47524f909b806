"""Writers and renderers: partition replacement, notes, packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import text as tx
from siftwright.operators.graph import staged


def append(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.mode("append").partitionBy(*by) if by else df.write.mode("append")).parquet(path)


def capped_scan(df: DataFrame, where: Column, order: str, limit: int = 10_000) -> DataFrame:
    """The first rows in ``order`` that meet a condition, as an explicit report of
    at most ``limit``."""
    return df.where(where).orderBy(order).limit(limit)


def replace_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Only the partitions that ``df`` holds are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def note_gate(summary: Column, files: Column, task_type: Column) -> Column:
    """Notes worth keeping: 60 characters without blanks around, some file, not
    a scratch one. Null counts as empty."""
    body = F.regexp_replace(F.coalesce(summary, F.lit("")), r"^\s+|\s+$", "")
    return (F.length(body) >= 60) & (F.coalesce(F.size(files), F.lit(0)) > 0) & ~task_type.eqNullSafe(F.lit("scratch"))


def numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``number`` from 1 in ``order``: ranges of the order are numbered apart
    and lifted by the rows before them, so no task numbers all rows."""
    spark = df.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 200))
    rows = staged(df.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()))
    sizes = rows.groupBy("range_").count()
    lift = F.coalesce(F.sum("count").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("range_").alias("of_range_"), lift.alias("lift_"))  # a row per range
    nth = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    ranked = rows.withColumn("nth_", nth).join(F.broadcast(sizes), F.col("range_") == F.col("of_range_"))
    return ranked.withColumn("number", (F.col("nth_") + F.col("lift_")).cast("long")).drop("nth_", "lift_", "range_", "of_range_")


def markdown_notes(df: DataFrame, id_col: str, title: Column, body: Column, order: list[Column]) -> DataFrame:
    """(file_name, content): numbered in ``order`` and named by slug."""
    rows = numbered(df, order or [F.col(id_col)])
    name = F.format_string("%04d-%s.md", "number", tx.slug(title))
    return rows.select(id_col, name.alias("file_name"), F.concat(F.lit("# "), title, F.lit("\n\n"), tx.redact(body), F.lit("\n")).alias("content"))


#: Statuses exported unless others are asked for, and the characters
#: of a title in a file name.
EXPORTED, NAME_CHARS = ("accepted",), 60


def decision_records(df: DataFrame, order: list[Column], statuses: tuple[str, ...] = EXPORTED) -> DataFrame:
    """(file_name, content) of decisions with a wanted status, one record each.
    ``df`` has title, status, created_at, confidence, context, decision,
    consequences, tags (array) and superseded_by."""
    rows = numbered(df.where(F.col("status").isin(*statuses)), order)
    part = lambda name, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(f"## {name}\n\n"), F.col(c), F.lit("\n\n"))).otherwise("")
    note = F.when(F.coalesce(F.length("superseded_by"), F.lit(0)) > 0, F.concat(F.lit("\n> **Superseded by:** `"), "superseded_by", F.lit("`\n"))).otherwise("")
    tags = F.coalesce(F.nullif(F.array_join(F.transform("tags", lambda t: F.concat(F.lit("`"), t, F.lit("`"))), ", "), F.lit("")), F.lit("_none_"))
    head = F.concat(F.lit("# "), "title", F.lit("\n\n**Status:** "), "status", F.lit("  **Date:** "), F.date_format("created_at", "yyyy-MM-dd"), F.lit("  **Confidence:** "), F.col("confidence").cast("string"), F.lit("\n"), note, F.lit("\n"))
    text = F.concat(head, part("Context", "context"), part("Decision", "decision"), part("Consequences", "consequences"), F.lit("## Tags\n\n"), tags, F.lit("\n"))
    name = F.format_string("%04d-%s.md", "number", F.substring(tx.slug(F.col("title")), 1, NAME_CHARS))
    return rows.select(name.alias("file_name"), text.alias("content"))


def compact_line(path: Column, reason: Column, conf: Column) -> Column:
    return F.format_string("%s (%.2f) %s", path, conf, F.coalesce(reason, F.lit("")))


def agent_json(path: Column, reason: Column) -> Column:
    """{path, lines, reason}; lines are read out of the reason."""
    lines = F.nullif(F.regexp_extract(reason, r"lines (\d+-\d+)", 1), F.lit(""))
    return F.to_json(F.struct(path.alias("path"), lines.alias("lines"), reason.alias("reason")))
