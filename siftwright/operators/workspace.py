"""Several repositories at once: union, link boosts, contract links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import scores
from siftwright.functions import text as tx


def merged(packs: DataFrame, repo: str = "repo", title: str = "title") -> DataFrame:
    """Titles prefixed with their repository; one table, no loop."""
    return packs.withColumn(title, F.concat(F.lit("["), F.col(repo), F.lit("] "), F.col(title)))


def link_boosts(items: DataFrame, linked: DataFrame, producers: DataFrame, conf: str = "confidence", repo: str = "repo") -> DataFrame:
    """+0.10 for linked repositories, +0.05 for contract producers."""
    a = linked.select(F.col(repo).alias("l_")).distinct()
    b = producers.select(F.col(repo).alias("p_")).distinct()
    joined = items.join(a, F.col(repo) == F.col("l_"), "left").join(b, F.col(repo) == F.col("p_"), "left")
    gain = F.when(F.col("l_").isNotNull(), 0.10).otherwise(0.0) + F.when(F.col("p_").isNotNull(), 0.05).otherwise(0.0)
    return joined.withColumn(conf, scores.capped(F.col(conf) + gain)).drop("l_", "p_")


#: Fixed value: base names of Python imports.
IMPORT = r"(?m)^\s*(?:import|from)\s+([a-zA-Z_][a-zA-Z0-9_]*)"
#: HTTP verbs as a call, as an option, and as a bare literal.
VERBS = "get|post|put|patch|delete|head|options"
VERB_CALL = rf"(?i)(?:\.|->)\s*({VERBS})\s*\("
VERB_OPTION = rf"(?i)method\s*[:=]\s*[\"']?({VERBS})[\"']?"
VERB_LITERAL = rf"(?i)[\"']({VERBS})[\"']"


def import_links(files: DataFrame, repos: DataFrame, repo: str, text: Column, pattern: str = IMPORT) -> DataFrame:
    """(src_repo, dst_repo): imported names that are another repository, whose
    dashes and blanks are underscores in code."""
    names = files.select(F.col(repo).alias("src_repo"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("name"))
    known = repos.select(F.col(repo).alias("dst_repo"), F.lower(F.regexp_replace(repo, "[- ]", "_")).alias("key"))
    hits = names.select("src_repo", F.lower("name").alias("key")).distinct().join(known, "key")
    return hits.where("src_repo <> dst_repo").select("src_repo", "dst_repo").distinct()


def endpoint_refs(files: DataFrame, endpoints: list[str], id_col: str, text: str) -> DataFrame:
    """(id, endpoint): files that quote an endpoint's path. Patterns are a
    literal list, so each file is read once and no rows are paired."""
    hits = F.filter(
        F.array(*[F.when(F.rlike(F.col(text), F.lit(tx.endpoint_pattern(e))), F.lit(e)) for e in endpoints]), lambda e: e.isNotNull()
    )
    return files.select(id_col, F.explode(hits).alias("endpoint"))


def contract_links(files: DataFrame, endpoints: dict[str, list[str]], repo: str, text: str, confidence: float = 0.9) -> DataFrame:
    """(src_repo, dst_repo, edge_kind, confidence) of consumers of a contract."""
    parts = None
    for owner, paths in endpoints.items():
        hit = F.lit(False)
        for p in paths:
            hit = hit | F.rlike(F.col(text), F.lit(tx.endpoint_pattern(p)))
        part = files.where((F.col(repo) != owner) & hit).select(F.col(repo).alias("src_repo"), F.lit(owner).alias("dst_repo")).distinct()
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("edge_kind", F.lit("consumes_openapi")).withColumn("confidence", F.lit(confidence))


def inferred_method(text: Column, at: Column, size: Column, window: int = 160) -> Column:
    """HTTP method of a call whose URL literal starts at ``at`` (from 1) and has
    ``size`` characters: the last ``.verb(`` or ``->verb(`` before it, else
    ``method:`` after it, else the last bare verb before it, else null."""
    before = F.substring(text, F.greatest(F.lit(1), at - window), F.least(at - 1, F.lit(window)))
    after = F.substring(text, at + size, F.lit(window))
    call, bare = (F.regexp_extract_all(before, F.lit(p), F.lit(1)) for p in (VERB_CALL, VERB_LITERAL))
    option = F.nullif(F.regexp_extract(after, VERB_OPTION, 1), F.lit(""))
    last = lambda found: F.when(F.size(found) > 0, F.element_at(found, -1))
    return F.upper(F.coalesce(last(call), option, last(bare)))


def references_endpoint(text: Column, path: str, method: str | None = None) -> Column:
    """Whether a text quotes an endpoint's path and, where a method is asked
    for, infers it at one of the places."""
    pattern = tx.endpoint_pattern(path)
    hit = F.rlike(text, F.lit(pattern))
    if not (method or "").strip():
        return hit
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), F.length)
    parts = F.zip_with(gaps, F.transform(found, F.length), lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("hit"))

    def step(a: Column, p: Column) -> Column:
        same = F.coalesce(inferred_method(text, a["at"] + p["gap"], p["n"]) == method.strip().upper(), F.lit(False))
        return F.struct((a["at"] + p["gap"] + p["n"]).alias("at"), (a["hit"] | same).alias("hit"))

    return hit & F.aggregate(parts, start, step, lambda a: a["hit"])


#: Lines of a bucket in which symbols and changed lines meet.
BUCKET_LINES = 64


def diff_overlap(symbols: DataFrame, changed: DataFrame, path: str, start: str, end: str) -> DataFrame:
    """Symbols with a changed line inside; ``changed`` is (path, line). Symbols
    and lines meet in buckets of lines of one path, so a long file with many of
    both is not paired whole. Symbols of no valid range never match."""
    lines = changed.select(F.col("path").alias("p_"), F.col("line").alias("line_"), F.floor(F.col("line") / BUCKET_LINES).alias("b_")).distinct()
    first, last = (F.floor(F.col(c) / BUCKET_LINES) for c in (start, end))
    spread = symbols.where((F.col(start) <= F.col(end)) & (F.col(start) > 0)).withColumn("bucket_", F.explode(F.sequence(first, last)))
    on = (F.col(path) == F.col("p_")) & (F.col("bucket_") == F.col("b_")) & F.col("line_").between(F.col(start), F.col(end))
    return spread.join(lines, on, "left_semi").drop("bucket_").distinct()


def test_links(symbols: DataFrame) -> DataFrame:
    """(src, dst): edges from what is tested to the test function named after
    it, as it stands or in CamelCase. ``symbols`` is (node, name, kind, path);
    test functions are functions in files with "test" in their name, and of
    equal names the greatest node counts."""
    in_test = F.contains(F.lower(tx.basename(F.col("path"))), F.lit("test"))
    tests = symbols.where(in_test & (F.col("kind") == "function")).groupBy("name").agg(F.max("node").alias("dst"))
    tests = tests.where(F.startswith("name", F.lit("test_"))).withColumn("plain", F.substring("name", 6, 2**31 - 1))
    camel = F.array_join(F.transform(F.split("plain", "_"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**31 - 1)))), "")
    wanted = tests.select("dst", F.explode(F.array_distinct(F.array("plain", camel))).alias("name"))
    best = symbols.where(~in_test).groupBy("name").agg(F.max("node").alias("src"))
    return wanted.join(best, "name").select("src", "dst").distinct()


def test_files(sources: DataFrame, tests: DataFrame, path: str = "path") -> DataFrame:
    """(source, test): test files by the naming conventions of Python, Java and
    C#; case does not matter, the suffix must agree."""
    low = F.lower(tx.stem(F.col(path)))
    ending = F.lower(F.regexp_extract(tx.basename(F.col(path)), r".(\.[^.]+)$", 1))
    after = F.array(F.concat(low, F.lit("test")), F.concat(low, F.lit("tests")))
    names = F.when(ending == ".py", F.array(F.concat(F.lit("test_"), low), F.concat(low, F.lit("_test")))).when(ending.isin(".java", ".cs"), after)
    wanted = sources.select(F.col(path).alias("source"), F.explode(names).alias("stem"), ending.alias("ending"))
    known = tests.select(F.col(path).alias("test"), low.alias("stem"), ending.alias("ending"))
    return wanted.join(known, ["stem", "ending"]).select("source", "test").distinct()


def tests_of_changed(tests: DataFrame, changed: DataFrame, path: str = "path") -> DataFrame:
    """Test files whose name says that they test a changed file."""
    stems = changed.select(tx.stem(F.col(path)).alias("stem_")).distinct()
    hit = tests.where(tx.is_test_file(F.col(path)))
    return hit.join(stems, tx.tested_stem(F.col(path)) == F.col("stem_"), "left_semi")


def cross_community_edges(edges: DataFrame, nodes: DataFrame, threshold: int = 50) -> DataFrame:
    """(repo, n, coupled): edges between different communities of a repository,
    against a threshold. ``edges`` is (repo, src, dst), ``nodes`` (node,
    community)."""
    a = nodes.where("community is not null").select(F.col("node").alias("a_"), F.col("community").alias("ca_"))
    b = nodes.where("community is not null").select(F.col("node").alias("b_"), F.col("community").alias("cb_"))
    both = edges.join(a, F.col("src") == F.col("a_"), "left").join(b, F.col("dst") == F.col("b_"), "left")
    n = F.count_if(F.coalesce(F.col("ca_") != F.col("cb_"), F.lit(False)))
    return both.groupBy("repo").agg(n.alias("n")).withColumn("coupled", F.col("n") > threshold)


def federated(own: DataFrame, siblings: DataFrame, committed: DataFrame, key: str = "id") -> DataFrame:
    """Rows of this repository, and of others only what they have committed,
    tagged with ``source_repo``. ``siblings`` and ``committed`` are keyed by
    (source_repo, key)."""
    mine = own.withColumn("source_repo", F.lit(None).cast("string"))
    theirs = siblings.join(committed.select("source_repo", key).distinct(), ["source_repo", key], "left_semi")
    return mine.unionByName(theirs.select(*mine.columns))
