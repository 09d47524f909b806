"""A subsystem wiki: items into sections, sections into a page.

Each level is put in order before the next takes it up. Files and hubs of a
community are cut to the few that a section shows by a top-k in two stages (by
salt, then by community), so a large community is not sorted in one task; a
section is a text; the page is the ordered text of at most ``top`` sections, with
a contents list of their anchors. Symbols without a community are in none.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwright.functions import text as tx
from siftwright.operators.graph import USES

#: Sections of a page, files and hubs of a section, and the least
#: number of sections, with placeholders for those that are missing.
SECTIONS, FILES, HUBS, LEAST_SECTIONS = 8, 8, 3, 3
#: Salts of the first stage of a top-k.
SALTS = 32
#: The page's texts.
NO_HUBS = "No strongly-connected hub symbols were detected — this group is a leaf subsystem or set of utilities."
PLACEHOLDER = "This placeholder fills out the wiki to the minimum threshold when the project has fewer communities than expected."
NOTHING = "_No subsystems detected._"


def top_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, salt: Column) -> DataFrame:
    """The first ``k`` rows of each group in ``order``, with ``nth`` from 1."""
    first = df.withColumn("salt_", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    for keys in ([*group, "salt_"], list(group)):
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= k)
    return first.drop("salt_")


def in_order(value: Column) -> Column:
    """A group's values in the order of ``nth``; groups have few rows."""
    return F.transform(F.array_sort(F.collect_list(F.struct("nth", value.alias("v")))), lambda x: x["v"])


def sections(nodes: DataFrame, edges: DataFrame, top: int = SECTIONS, files: int = FILES, hubs: int = HUBS) -> DataFrame:
    """(community, rank, title, anchor, text) of the most used communities.
    ``nodes`` is (node, community, file, name)."""
    degree = edges.where(F.col("edge_type").isin(*USES)).groupBy(F.col("dst").alias("d_")).agg(F.count("*").alias("inbound"))
    full = nodes.where("community is not null").join(degree, F.col("node") == F.col("d_"), "left").drop("d_").withColumn("inbound", F.coalesce("inbound", F.lit(0)))
    sums = full.groupBy("community").agg(F.sum("inbound").alias("inbound"), F.count("*").alias("symbols"))
    best = sums.orderBy(F.desc("inbound"), F.desc("symbols"), "community").limit(top)
    kept = full.join(F.broadcast(best.select("community")), "community", "left_semi")  # ``top`` rows
    by_file = kept.groupBy("community", "file").agg(F.sum("inbound").alias("inbound"))
    shown = top_rows(by_file, ["community"], [F.desc("inbound"), F.asc("file")], files, F.col("file"))
    shown = shown.groupBy("community").agg(in_order(F.col("file")).alias("files"))
    used = top_rows(kept.where("inbound > 0"), ["community"], [F.desc("inbound"), F.asc("name"), F.asc("node")], hubs, F.col("node"))
    used = used.groupBy("community").agg(in_order(F.struct("name", "inbound")).alias("hubs"))
    rows = best.join(shown, "community", "left").join(used, "community", "left")
    none = F.array().cast("array<struct<name:string,inbound:bigint>>")
    rows = rows.withColumn("files", F.coalesce("files", F.array().cast("array<string>"))).withColumn("hubs", F.coalesce("hubs", none))
    rank = F.row_number().over(Window.orderBy(F.desc("inbound"), F.desc("symbols"), "community"))  # ``top`` rows
    rows = rows.withColumn("rank", rank).withColumn("title", title())
    return rows.select("community", "rank", "title", tx.anchor(F.col("title"), F.col("community")).alias("anchor"), section().alias("text"))


def title() -> Column:
    """The first hub's bare name, else the folder of the first file, else a number."""
    base = F.trim(F.substring_index(F.substring_index(F.get("hubs", 0)["name"], "(", 1), ".", 1))
    parts = F.filter(F.split(F.translate(F.get("files", 0), "\\", "/"), "/"), lambda p: p != "")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise(F.get(parts, 0))
    return F.coalesce(F.nullif(base, F.lit("")), folder, F.concat(F.lit("community "), F.col("community").cast("string")))


def section() -> Column:
    some = F.size("hubs") > 0
    listed = F.array_join(F.transform("hubs", lambda h: F.format_string("%s (inbound=%d)", h["name"], h["inbound"])), ", ")
    names = F.array_join(F.transform("hubs", lambda h: h["name"]), ", ")
    count = F.format_string("This subsystem contains %d file(s) and %d symbol(s). ", F.size("files"), F.col("symbols"))
    most = F.format_string("The most connected symbols are %s. Total inbound references across hub edges: %d.", names, F.col("inbound"))
    return F.concat(
        F.lit("## Subsystem: "), "title", F.lit("\n\n**Key files**: "), F.when(F.size("files") > 0, F.array_join("files", ", ")).otherwise("(none)"),
        F.lit("\n\n**Hub symbols**: "), F.when(some, listed).otherwise("(no strong hubs)"), F.lit("\n\n"), count, F.when(some, most).otherwise(NO_HUBS), F.lit("\n"),
    )


def page(found: DataFrame, project: str, date: str) -> DataFrame:
    """One row (text): the page of ``sections``."""
    rows = found.agg(F.array_sort(F.collect_list(F.struct("rank", "title", "anchor", "text"))).alias("s"))  # a row per section shown
    more = F.filter(F.sequence(F.lit(1), F.lit(LEAST_SECTIONS)), lambda i: i <= LEAST_SECTIONS - F.size("s"))
    contents = F.transform("s", lambda s: F.format_string("- [Subsystem: %s](#%s)", s["title"], s["anchor"]))
    contents = F.concat(contents, F.transform(more, lambda i: F.format_string("- [Subsystem: placeholder %d](#subsystem-placeholder-%d)", i, i)))
    blanks = F.transform(more, lambda i: F.format_string(f"## Subsystem: placeholder %d\n\n**Key files**: (none — placeholder section)\n\n**Hub symbols**: (none)\n\n{PLACEHOLDER}\n", i))
    head = f"# {project} — subsystem wiki\n\nGenerated on {date}.\n\n"
    body = F.array_join(F.concat(F.transform("s", lambda s: s["text"]), blanks), "\n")
    listed = F.concat(F.lit("## TOC\n"), F.array_join(contents, "\n"), F.lit("\n\n"))
    return rows.select(F.concat(F.lit(head), F.when(F.size("s") > 0, listed).otherwise(NOTHING + "\n\n"), body).alias("text"))
