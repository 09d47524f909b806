"""Shards by k-d tree partitioning [native].

Every row has a size and numeric metadata. A node that is to hold m shards is
cut along its widest dimension (its range as a share of the table's range) at
the size-weighted quantile m_near / m; leaves hold one shard each, so all
shards get nearly equal bytes. The quantile comes from histograms over the bits
of a key: the place in the dimension, then a hash that breaks ties, so a value
that a third of the rows share is cut as well as any other. Each pass is one
aggregation of a narrow staged table to at most 4096 bins a node, for all nodes
of a level at once.

Null text has size 8 and checksum 0; null metadata counts as the least value.
Repeated rows are placed alike. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import slots, staged, table, unstage

#: Bits of a key's place and tie-breaking hash, and of one histogram pass.
PLACE_BITS, HASH_BITS, PASS_BITS = 24, 24, 12
#: A cut is done when what it cannot tell apart is this share of a shard.
TOLERANCE = 0.001


def number_of(text: Column) -> Column:
    """The first six bytes of a string, in order, as a number."""
    head = F.rpad(F.hex(F.substring(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


class Level:
    """The nodes of one level; expressions look their values up by a row's
    ``node``, so they stay as small for many nodes as for one."""

    def __init__(self, nodes: list[dict], dims: list[str]):
        self.nodes, self.dims = nodes, dims

    def value(self, name: str) -> Column:
        return F.get(F.array(*[F.lit(n[name]) for n in self.nodes]), F.col("node"))

    def key(self) -> Column:
        """Order of a row along its node's dimension, as a 48-bit integer."""
        wide = float((1 << PLACE_BITS) - 1)
        x = F.get(F.array(*[F.col(d) for d in self.dims]), self.value("dim"))
        spot = F.floor((x - self.value("low")) * self.value("scale") * wide)
        spot = F.greatest(F.lit(0), F.least(F.lit(int(wide)), spot))
        return F.shiftleft(spot.cast("long"), HASH_BITS).bitwiseOR(F.col("tie"))


def extremes(dims: list[str]) -> list[Column]:
    return [f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]


def find_cuts(at: DataFrame, dims: list[str], nodes: list[dict], full: list[float]) -> None:
    """Set each node's dimension and cut. Nodes of one shard are never cut."""
    live = [i for i, n in enumerate(nodes) if n["shards"] > 1]
    mine = at.where(F.col("node").isin(live))
    seen = {r["node"]: r for r in mine.groupBy("node").agg(F.sum("size").alias("bytes"), *extremes(dims)).collect()}
    for i, n in enumerate(nodes):
        n |= {"dim": 0, "low": 0.0, "scale": 0.0, "cut": 1 << 62, "prefix": 0, "open": False}
        if i not in seen:
            continue
        r = seen[i]
        shares = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / f if f else 0.0 for d, f in zip(dims, full)]
        n["dim"] = max(range(len(dims)), key=lambda k: (shares[k], -k))
        d = dims[n["dim"]]
        wide = r[f"hi_{d}"] - r[f"lo_{d}"]
        n |= {"low": r[f"lo_{d}"], "scale": 1 / wide if wide else 0.0, "open": True}
        n["left"] = r["bytes"] * (n["shards"] // 2) / n["shards"]
        n["slack"] = r["bytes"] / n["shards"] * TOLERANCE
    bits = PLACE_BITS + HASH_BITS
    while any(n["open"] for n in nodes):
        level = Level(nodes, dims)
        keyed = mine.where(level.value("open")).select("node", "size", level.key().alias("key"), level.value("prefix").alias("prefix"))
        keyed = keyed.where(F.shiftright("key", bits) == F.col("prefix"))
        bits -= PASS_BITS
        binned = keyed.groupBy("node", F.shiftright("key", bits).alias("bin")).agg(F.sum("size").alias("bytes"))
        bins: dict[int, list] = {}
        for r in binned.collect():
            bins.setdefault(r["node"], []).append((r["bin"], r["bytes"]))
        for i, n in enumerate(nodes):
            if not n["open"]:
                continue
            size = 0
            for b, size in sorted(bins[i]):
                n["prefix"] = b
                if size > n["left"]:
                    break
                n["left"] -= size
            if size <= n["slack"] or bits == 0:
                n["cut"] = (n["prefix"] + (2 * n["left"] > size)) << bits
                n["open"] = False


def place(rows: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """Add ``shard`` to a staged table of (size, tie, dims...)."""
    spans = rows.agg(*extremes(dims)).first()
    full = [(spans[f"hi_{d}"] or 0.0) - (spans[f"lo_{d}"] or 0.0) for d in dims]
    at, nodes = rows.withColumn("node", F.lit(0)), [{"shards": shards, "first": 0}]
    while any(n["shards"] > 1 for n in nodes):
        find_cuts(at, dims, nodes, full)
        level, below = Level(nodes, dims), []
        for n in nodes:
            near = n["shards"] // 2
            n["near"] = len(below)
            n["far"] = n["near"] + (near > 0)
            if near:
                below.append({"shards": near, "first": n["first"]})
            below.append({"shards": n["shards"] - near, "first": n["first"] + near})
        side = F.when(level.key() < level.value("cut"), level.value("near")).otherwise(level.value("far"))
        last, at = at, staged(at.withColumn("node", side), "kd-level")
        if nodes[0]["shards"] != shards:
            unstage(last)
        nodes = below
    return at.withColumn("shard", Level(nodes, dims).value("first")).drop("node")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text: str = "text", metadata: dict[str, Column] | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot); either the number of shards or the
    bytes that a shard should reach."""
    clean = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    metadata = metadata or {}
    dims = {f"dim{i}": F.coalesce(c.cast("double"), F.lit(0.0)) for i, c in enumerate(metadata.values())}
    narrow = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(clean) + 8).cast("long").alias("size"), F.crc32(clean).alias("text_crc32"),
        *[c.alias(d) for d, c in dims.items()],
    )
    narrow = narrow.withColumn("tie", F.xxhash64("id", "text_crc32", F.lit(1)).bitwiseAND(F.lit((1 << HASH_BITS) - 1)))
    if not dims:
        narrow = narrow.withColumn("dim0", F.col("size").cast("double"))
    rows = staged(narrow, "kd")
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // (target_bytes or 1 << 30)))
    placed = place(rows, list(dims) or ["dim0"], shards)
    return slots(placed, ["shard"], ["id", "text_crc32"], "slot").select("id", "size", "text_crc32", "shard", "slot")


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    metadata = {"doc_id": F.col("doc_id"), "n_chars": F.col("n_chars"), "source": number_of(F.col("source")), "lang": number_of(F.col("lang"))}
    return shard_documents(docs, shards=24, metadata=metadata).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
