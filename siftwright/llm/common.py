"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of all word contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; where that is unset in local
    mode (tests, notebooks) a fresh folder is set for the session, and elsewhere
    that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="siftwright-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = "file://" + own
        spark.conf.set("spark.checkpoint.dir", place)
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftwright/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, and
    survives lost executors because the files are not theirs. Narrow tables are
    not compressed, as codecs hold memory outside the heap for every column of
    every small task; texts should be ("zstd")."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """What runs within sends Python at most ``rows`` rows at once, as long
    texts in batches of 10,000 hold much memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank give none.

    One pass makes every space a blank and a single-character split, which
    needs no regular expression, does the rest.
    """
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " ")
    return F.array_remove(F.split(spaced, " ", -1), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tmp_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` clashes with it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slots(df: DataFrame, keys: list[str], order: list[str], name: str, part_rows: int = 20_000, counted: DataFrame | None = None, more: DataFrame | None = None) -> DataFrame:
    """Add ``name``: each row's number within ``keys``, gapless from 0.

    A group is dealt over salts by a hash of ``order``, numbered within each
    salt, and lifted by the rows of the salts before it, so that no task holds
    a whole group. ``df`` should be staged, as it is read twice; or ``counted``
    is a narrow staged table with the same keys and order columns. Rows equal in
    ``order`` meet in one salt, in any order among themselves. ``more`` has a row
    for each of the keys; its other columns are added on the way, so that wide
    rows are not shuffled a second time for them.
    """
    counted = df if counted is None else counted
    total = counted.count()
    salts = max(1, -(-total // part_rows))
    salt, before, nth, key = tmp_names(df.withColumn(name, F.lit(0)), "salt_", "before_", "within_salt_", "key_")
    of_row = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(salts)).cast("int")
    # One struct for the keys, null or not beside a value that never is: it compares
    # by plain equality and has one type on all sides, so rows stay where the window
    # has put them when they meet their counts.
    kinds = dict(df.dtypes)
    value = [F.coalesce(F.col(k), F.lit("" if kinds[k] == "string" else 0).cast(kinds[k])).alias(f"v{i}") for i, k in enumerate(keys)]
    of_key = F.struct(*value, *[F.col(k).isNull().alias(f"n{i}") for i, k in enumerate(keys)])
    dealt = df.withColumn(salt, of_row).withColumn(key, of_key)
    by_salt = Window.partitionBy(key, salt).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    ranked = dealt.withColumn(nth, F.row_number().over(by_salt).cast("long") - 1)
    if salts == 1 and more is None:
        return ranked.withColumn(name, F.col(nth)).drop(salt, nth, key)
    counts = counted.withColumn(salt, of_row).withColumn(key, of_key).groupBy(key, salt).count()
    lift = Window.partitionBy(key).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        F.col(key).alias("of_" + key),
        F.col(salt).alias("of_" + salt),
        F.coalesce(F.sum("count").over(lift), F.lit(0)).alias(before),
    )
    added = []
    if more is not None:
        added = [c for c in more.columns if c not in keys]
        of_more = more.select(of_key.alias("more_" + key), *added)
        counts = counts.join(of_more, F.col("of_" + key) == F.col("more_" + key)).drop("more_" + key)
    on = (F.col(key) == F.col("of_" + key)) & (F.col(salt) == F.col("of_" + salt))
    return (
        ranked.join(counts, on, "left")
        .withColumn(name, F.col(nth) + F.col(before))
        .select(*df.columns, name, *added)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
