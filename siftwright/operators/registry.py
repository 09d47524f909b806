"""Small tables of repositories and their links, by upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.operators.memory import latest_per_key, upsert


def add_repo(repos: DataFrame, fresh: DataFrame) -> DataFrame:
    """(name, path, language): a name that is there is replaced."""
    return upsert(repos, fresh, ["name"])


def remove_repo(repos: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Repositories and links without one repository."""
    gone = F.lit(name)
    return repos.where(F.col("name") != gone), links.where((F.col("src_repo") != gone) & (F.col("dst_repo") != gone))


def link(links: DataFrame, fresh: DataFrame) -> DataFrame:
    """(src_repo, dst_repo, edge_kind, confidence): the surest of equal links."""
    return latest_per_key(links.unionByName(fresh), ["src_repo", "dst_repo", "edge_kind"], [F.desc("confidence")])


def refresh_source(links: DataFrame, src: str, fresh: DataFrame) -> DataFrame:
    """All links of a source are replaced."""
    return links.where(F.col("src_repo") != src).unionByName(fresh)
