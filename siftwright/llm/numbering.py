"""Numbers in a given order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.llm.common import staged, tmp_names

#: Rows of a range partition, about.
PART_ROWS = 100_000


def dealt(df: DataFrame, order: list[Column], name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """A staged table of the rows with ``name``: the number of the range of
    ``order`` that a row lies in. Earlier ranges hold earlier rows."""
    spark = df.sparkSession
    parts = max(1, -(-df.count() // part_rows), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64))
    return staged(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id().cast("long")), "dealt")


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: each row's number within ``keys`` in ``order``, from 0.

    Rows are dealt by ranges of (keys, order), numbered within their range and
    lifted by the rows of their keys in the ranges before. Rows equal in keys and
    order meet in one range, in any order among themselves.
    """
    seg, nth, lift = tmp_names(df.withColumn(name, F.lit(0)), "seg_", "nth_", "lift_")
    rows = dealt(df, [*map(F.col, keys), *order], seg)
    ranked = rows.withColumn(nth, F.row_number().over(Window.partitionBy(seg, *keys).orderBy(*order)).cast("long") - 1)
    counts = rows.groupBy(seg, *keys).count()
    over = Window.partitionBy(*keys).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(lift, F.coalesce(F.sum("count").over(over), F.lit(0)))  # a row per range and key
    counts = counts.select(F.col(seg).alias("of_" + seg), *[F.col(k).alias(f"of{i}_{k}") for i, k in enumerate(keys)], lift)
    on = F.col(seg) == F.col("of_" + seg)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"of{i}_{k}"))
    return ranked.join(counts, on, "left").select(*df.columns, (F.col(nth) + F.col(lift)).alias(name))
