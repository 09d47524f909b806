"""Analyzers by file extension: a registry, and files as symbol and edge rows.

An analyzer takes a path and a text and returns symbols and edges. The first
registration of an extension stays. A maker that fails, one that gives no
analyzer, and a file that an analyzer fails on are rows of ``errors``, not
failed jobs: one bad file must not cost a run over millions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from itertools import accumulate, chain
from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOL = "kind string, name string, line_start long, line_end long, signature string, owner string, docstring string"
EDGE = "src string, dst string, edge_type string"
GROUP = "siftwright.analyzers"

Rows = tuple[list[tuple], list[tuple]]


@runtime_checkable
class Analyzer(Protocol):
    """Symbols (as ``SYMBOL``) and edges (as ``EDGE``) of a file."""

    def rows(self, path: str, text: str) -> Rows: ...


@dataclass
class Registry:
    """Analyzers by extension without a dot, and why others are missing."""

    found: dict[str, Analyzer] = field(default_factory=dict)
    errors: list[tuple[str, str]] = field(default_factory=list)

    def register(self, extension: str, maker: Callable[[], Analyzer]) -> bool:
        """Whether the analyzer was taken in: the first of an extension is."""
        if extension in self.found:
            return False
        try:
            made = maker()
        except Exception as e:  # noqa: BLE001, whatever a plug-in raises
            self.errors.append((extension, f"{type(e).__name__}: {e}"))
            return False
        if not isinstance(made, Analyzer):
            self.errors.append((extension, f"{type(made).__name__} is no analyzer"))
            return False
        self.found[extension] = made
        return True

    def discover(self, points=None) -> None:
        """Register the installed packages' entry points of ``GROUP``."""
        for point in entry_points(group=GROUP) if points is None else points:
            self.register(point.name, lambda p=point: p.load()())

    def extensions(self) -> list[str]:
        return sorted(self.found)

    def error_rows(self, spark) -> DataFrame:
        return spark.createDataFrame(self.errors, "extension string, error string")

    def rows(self, path: str, text: str | None) -> tuple[str | None, Rows, str | None]:
        """(extension, rows, error) of a file; unknown extensions have none."""
        extension = path.rpartition("/")[2].rpartition(".")[2].lower()
        if extension not in self.found:
            return None, ([], []), None
        try:
            return extension, self.found[extension].rows(path, text or ""), None
        except Exception as e:  # noqa: BLE001
            return extension, ([], []), f"{type(e).__name__}: {e}"


def kinds_of(schema: str) -> pa.StructType:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.struct([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])


def lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """A list of structs for each file's rows, built by column; short rows end in
    nulls, and what a row has beyond the columns is left out."""
    width = kind.num_fields
    flat = [r if len(r) == width else (*r, *[None] * width)[:width] for r in chain.from_iterable(rows)]
    columns = [pa.array(c, f.type) for c, f in zip(zip(*flat) if flat else [()] * width, kind)]
    ends = pa.array(accumulate(map(len, rows), initial=0), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(kind)))


def index(files: DataFrame, registry: Registry, path: str = "path", text: str = "text") -> DataFrame:
    """A row per file (path, extension, symbols, edges, error), in one pass over
    the texts; write it once where several of ``parts`` are wanted. Files are dealt
    out by path first: analyzing costs far more than reading, so the few tasks that
    a table's bytes ask for would leave most cores idle."""
    symbol, edge = kinds_of(SYMBOL), kinds_of(EDGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            done = [registry.rows(p or "", t) for p, t in zip(paths, batch.column(1).to_pylist())]
            found = [lists([rows[k] for _, rows, _ in done], kind) for k, kind in enumerate((symbol, edge))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.string()), *found, pa.array([d[2] for d in done], pa.string())],
                ["path", "extension", "symbols", "edges", "error"],
            )

    nested = [f"array<struct<{s.replace(' ', ':').replace(',:', ',')}>>" for s in (SYMBOL, EDGE)]
    schema = f"path string, extension string, symbols {nested[0]}, edges {nested[1]}, error string"
    rows = files.select(F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    spread = max(files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(spread, "path").mapInArrow(run, schema)


def parts(indexed: DataFrame, what: str) -> DataFrame:
    """``symbols`` or ``edges`` with their path, or the quarantined files (``errors``)."""
    if what == "errors":
        return indexed.where("error is not null").select("path", "extension", "error")
    return indexed.select("path", F.explode(what).alias("r")).select("path", "r.*")
