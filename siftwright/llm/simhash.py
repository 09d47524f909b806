"""SimHash near-duplicates with vantage-point trees.

Fingerprints of equal value are one node. A vantage-point tree, built from a
bounded sample of fingerprints, deals them into shards by Hamming distance to
its pivots: the near side takes distances up to the median, the far side the
rest and also those of the near side that are less than the radius from the
boundary, so that every pair within the radius meets in a shard (triangle
bound). Only the balance of the shards depends on the sample. In a shard the
same split goes on until a block is small enough to compare. A shard sends on a
spanning forest of its links, never all pairs, and the forests are joined by
connected components.

Null text counts as empty: fingerprint zero, linked like any other. Rows with
a null id get a fingerprint, no component (null), and link nothing. Repeated
rows get equal results; an empty table gives an empty table. Texts of any
length are hashed whole, in bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import small_batches, staged, table, tmp_names, unstage
from siftwright.llm.components import Forest, components

#: Fingerprints that shape the tree at most, aimed at in a shard, compared at once.
SAMPLE, SHARD, BLOCK = 20_000, 8_192, 512
SEED = 42
#: Bands and their rows in the search for texts of similarity 0.8: the chance to
#: miss a pair is (1 - 0.8**5)**24, less than 1 in 13,000.
BANDS, ROWS = 24, 5
#: Hashes of shingles that a task compares at once, about.
BLOCK_HASHES = 1_000_000
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
FACTORS, ADDENDS = _DRAWN[0] | np.uint64(1), _DRAWN[1]


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 where it is set in over half the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65_536):
        part = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        h = np.array([digest(flat[a:b], SEED) for a, b in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per row of ``df``; fp is the fingerprint's 64 bits as a
    signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], ["id", "fp"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "id long, fp long")


def split(points: np.ndarray, radius: int, rng: np.random.Generator, tries: int = 6):
    """(pivot, median distance) with the smallest larger side, or None if no
    pivot divides the points."""
    best = None
    for pivot in points[rng.integers(0, len(points), tries)]:
        d = np.bitwise_count(points ^ pivot)
        mu = int(np.median(d))
        if mu == d.max():
            mu -= 1
        far = int((d > mu - radius).sum())
        near = int((d <= mu).sum())
        if near and far < len(points) and (best is None or max(near, far) < best[0]):
            best = (max(near, far), pivot, mu)
    return best and best[1:]


def build_tree(sample: np.ndarray, leaves: int, radius: int) -> list:
    """Nodes (pivot, mu, near, far); a negative child -k-1 is leaf k."""
    nodes: list = []
    count = [0]
    least = max(8, len(sample) // max(1, leaves))
    rng = np.random.default_rng(SEED)

    def grow(points: np.ndarray) -> int:
        cut = split(points, radius, rng) if len(points) > least else None
        if cut is None:
            count[0] += 1
            return -count[0]
        pivot, mu = cut
        d = np.bitwise_count(points ^ pivot)
        here = len(nodes)
        nodes.append(None)
        nodes[here] = (int(pivot), mu, grow(points[d <= mu]), grow(points[d > mu]))
        return here

    root = grow(sample)
    return [root, nodes]


def route(points: np.ndarray, tree: list, radius: int):
    """Yields (leaf, places): all shards that each point belongs to."""
    root, nodes = tree
    stack = [(root, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not len(at):
            continue
        if node < 0:
            yield -node - 1, at
            continue
        pivot, mu, near, far = nodes[node]
        d = np.bitwise_count(points[at] ^ np.uint64(pivot)).astype(np.int64)
        stack.append((near, at[d <= mu]))
        stack.append((far, at[d > mu - radius]))


def link_within(points: np.ndarray, radius: int) -> Forest:
    """Links all pairs of ``points`` within ``radius``, by the same splits."""
    forest, rng = Forest(len(points)), np.random.default_rng(SEED)
    stack = [(np.arange(len(points)), 0)]
    while stack:
        at, depth = stack.pop()
        mine = points[at]
        cut = split(mine, radius, rng) if len(at) > BLOCK and depth < 40 else None
        if cut is not None:
            pivot, mu = cut
            d = np.bitwise_count(mine ^ pivot).astype(np.int64)
            near, far = at[d <= mu], at[d > mu - radius]
            if max(len(near), len(far)) < 0.9 * len(at):
                stack += [(near, depth + 1), (far, depth + 1)]
                continue
        for low in range(0, len(at), BLOCK):
            rows = mine[low : low + BLOCK]
            for other in range(low, len(at), BLOCK):
                i, j = np.nonzero(np.bitwise_count(rows[:, None] ^ mine[None, other : other + BLOCK]) <= radius)
                i, j = at[i + low], at[j + other]
                for a, b in zip(i[i < j].tolist(), j[i < j].tolist()):
                    forest.join(a, b)
                for a, b in zip(i[i > j].tolist(), j[i > j].tolist()):
                    forest.join(a, b)
    return forest


def links(fps: DataFrame, radius: int = 2, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(a, b): links between ``rep`` values that join whatever lies within
    ``radius``. ``fps`` (fp, rep) has distinct fp and is staged."""
    total = fps.count()
    rows = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect() if total > shard else []
    tree = build_tree(np.array([r[0] for r in rows], "<i8").view("<u8"), -(-total // shard), radius) if rows else [-1, []]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().astype("<i8").view("<u8")
            for leaf, at in route(points, tree, radius):
                picked = batch.take(pa.array(at))
                leaves = pa.array(np.full(len(at), leaf, np.int64))
                yield pa.RecordBatch.from_arrays([leaves, picked.column(0), picked.column(1)], ["leaf", "fp", "rep"])

    def search(part: pa.Table) -> pa.Table:
        points = part.column("fp").to_numpy().astype("<i8").view("<u8")
        reps = part.column("rep").to_numpy()
        found = list(link_within(points, radius).edges())
        a, b = (np.array([e[k] for e in found], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(reps[a], pa.int64()), "b": pa.array(reps[b], pa.int64())})

    dealt = fps.mapInArrow(deal, "leaf long, fp long, rep long")
    return dealt.groupBy("leaf").applyInArrow(search, "a long, b long")


def near_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fp, component): component is the least id reachable over links."""
    docs = staged(fingerprints(df, id_col, text, shingle), "fingerprints")
    fps = staged(docs.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "fps")
    found = components(links(fps, radius))
    classes = (
        fps.join(found, F.col("rep") == F.col("node"), "left")
        .select(F.col("fp").alias("fp2"), F.coalesce("component", "rep").alias("component"))
    )
    return docs.join(classes, F.col("fp") == F.col("fp2"), "left").select(
        "id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")
    )


def similarity(a: str | None, b: str | None, shingle: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles, A-Z lower-cased."""

    def shingles(text: str | None) -> set[bytes]:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        k = min(shingle, len(words))
        return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_hashes(text: str | None, shingle: int = 5) -> np.ndarray:
    """Distinct XXH64 of the word shingles, sorted; of fewer words, of all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    k, digest = min(shingle, len(words)), xxhash.xxh64_intdigest
    flat, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[: len(words) - k + 1], ends[k - 1 :]
    found = np.empty(len(starts), "<u8")
    for at in range(0, len(starts), 65_536):
        part = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        found[at : at + 65_536] = [digest(flat[a:b], SEED) for a, b in part]
    return np.unique(found)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each of ``BANDS`` bands of ``ROWS`` least hashes of a
    text's shingles. Texts of similarity s have an equal key with a chance of
    1 - (1 - s**ROWS)**BANDS."""
    least = np.full(BANDS * ROWS, 2**64 - 1, "<u8")
    for at in range(0, len(hashes), 4_096):
        least = np.minimum(least, (hashes[at : at + 4_096, None] * FACTORS + ADDENDS).min(0))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(rows)], "<u8")


def band_buckets(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5) -> DataFrame:
    """(key, id): a row for each document and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            found = [band_keys(shingle_hashes(t.as_py(), shingle)) for t in batch.column(1)]
            keys = np.concatenate(found) if found else np.zeros(0, "<u8")
            yield pa.RecordBatch.from_arrays([pa.array(keys.view("<i8")), pa.array(np.repeat(ids, BANDS), pa.int64())], ["key", "id"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.where("id is not null").mapInArrow(run, "key long, id long")


def profiles(texts: DataFrame, shingle: int = 5) -> DataFrame:
    """(id, size, hashes) of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py(), shingle) for t in batch.column(1)]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.concatenate(found).view("<i8") if found else np.zeros(0, "<i8")
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "size", "hashes"])

    return texts.mapInArrow(run, "id long, size long, hashes array<long>")


class Sets:
    """Exact sizes of the intersections of sorted sets. Members that many sets
    hold are bits of a matrix; the others are lists of their sets; those of one
    set only are left out."""

    def __init__(self, sets: list[np.ndarray]):
        n = len(sets)
        self.size = np.fromiter(map(len, sets), np.int64, n)
        owner = np.repeat(np.arange(n), self.size)
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        often = max(2, n // 32)
        rank = np.cumsum(held >= often) - 1
        wide = int((held >= often).sum())
        bits = np.zeros((n, -(-max(wide, 1) // 64) * 8), np.uint8)
        dense = held[column] >= often
        spot = rank[column[dense]]
        np.bitwise_or.at(bits, (owner[dense], spot >> 3), (1 << (spot & 7)).astype(np.uint8))
        self.bits = bits.view("<u8")
        few = (held[column] >= 2) & ~dense
        order = np.argsort(column[few], kind="stable")
        self.lists, self.column = owner[few][order], column[few][order]
        self.of = [np.zeros(0, np.int64)] * n
        if len(self.column):
            mine = np.split(column[few], np.flatnonzero(np.diff(owner[few])) + 1)
            for i, part in zip(owner[few][np.concatenate([[0], np.flatnonzero(np.diff(owner[few])) + 1])].tolist(), mine):
                self.of[i] = part

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Members that set ``i`` shares with each of ``others``."""
        out = np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)
        if len(self.of[i]):
            a, b = np.searchsorted(self.column, self.of[i], "left"), np.searchsorted(self.column, self.of[i], "right")
            held = np.concatenate([self.lists[x:y] for x, y in zip(a.tolist(), b.tolist())])
            out += np.bincount(held, minlength=len(self.size))[others]
        return out


def link_sets(sets: list[np.ndarray], labels: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that join all of ``sets`` whose similarity is ``least`` or more;
    sets of one label are joined already. A set is compared with those after it
    that it is not joined with yet, so what one centre joins costs a comparison
    each."""
    some, label = Sets(sets), np.unique(labels, return_inverse=True)[1]
    count = np.bincount(label)
    order = np.argsort(count[label], kind="stable")
    if count.max() == 1:
        order = np.argsort(-some.bits.view(np.uint8).astype(bool).sum(1), kind="stable")
    out = []
    for place, i in enumerate(order.tolist()):
        rest = order[place + 1 :]
        rest = rest[label[rest] != label[i]]
        if not len(rest):
            if (label == label[0]).all():
                break
            continue
        mine, size = some.size[i], some.size[rest]
        rest = rest[(size >= least * mine - 1e-9) & (mine >= least * size - 1e-9)]
        if not len(rest):
            continue
        both = some.shared(i, rest)
        every = mine + some.size[rest] - both
        for j in rest[(both / np.maximum(every, 1) >= least) | (every == 0)].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def searched(rows: DataFrame, least: float) -> DataFrame:
    """(a, b): links found in each task's rows (task, id, label, hashes)."""

    def search(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        ids, lists = part.column("id").to_numpy(), part.column("hashes").combine_chunks()
        flat, ends = lists.flatten().to_numpy().view("<u8"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        found = link_sets([flat[a:b] for a, b in zip(ends[:-1], ends[1:])], part.column("label").to_numpy(), least)
        a, b = (np.array([ids[e[k]] for e in found], np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("task").applyInArrow(search, "a long, b long")


def verified_groups(docs: DataFrame, buckets: DataFrame, least: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text: str = "text", block: int = BLOCK_HASHES) -> DataFrame:
    """(node, component): components of the pairs of ids that share a bucket and
    are at least ``least`` similar, for the ids that have such a pair.
    ``buckets`` is (key, id); similarity is exact on the sets of 64-bit hashes.

    Buckets of the same ids are searched once. First, each id is searched in its
    largest bucket only, dealt into blocks of about ``block`` hashes that all
    hold the bucket's first id. Then, in each bucket that still holds several
    components, ids outside the largest one meet all others, block by block, so
    every pair of a bucket is compared unless it is joined already. A task sends
    on a spanning forest of its links, never pairs."""
    pairs = staged(buckets.distinct(), "buckets")
    sizes = pairs.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("ids"))
    sizes = sizes.where("n > 1").groupBy("n", "ids").agg(F.min("key").alias("key1")).select("key1", "n")
    pairs, used = staged(pairs.join(sizes, F.col("key") == F.col("key1")).select("key", "id", "n"), "shared-buckets"), pairs
    unstage(used)
    named = pairs.select(F.col("id").alias("named")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sets = staged(profiles(texts.join(named, F.col("id") == F.col("named"), "left_semi"), shingle), "profiles")
    weights = sets.select(F.col("id").alias("id1"), "size")
    pairs, used = staged(pairs.join(weights, F.col("id") == F.col("id1")).select("key", "id", "n", "size"), "weighed"), pairs
    unstage(used)
    held = sets.select(F.col("id").alias("id2"), "hashes")

    def of_blocks(weight: str):
        return F.greatest(F.lit(1), F.ceil(F.col(weight) / block)).cast("int")

    def dealt(blocks):
        return F.pmod(F.xxhash64("id"), blocks).cast("int")

    home = pairs.groupBy("id").agg(F.max(F.struct("n", "key")).alias("m")).select(F.col("m.key").alias("key"), "id")
    home = home.join(weights, F.col("id") == F.col("id1"))
    totals = home.groupBy(F.col("key").alias("key1")).agg(F.sum("size").alias("weight"), F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    home = home.join(totals, F.col("key") == F.col("key1")).withColumn("blocks", of_blocks("weight"))
    at = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(dealt(F.col("blocks"))))
    home = home.select("key", "id", F.explode(at).alias("at"))
    home = home.join(held, F.col("id") == F.col("id2")).select(F.struct("key", "at").alias("task"), "id", F.col("id").alias("label"), "hashes")
    first = staged(searched(home, least), "first-links")
    groups = staged(components(first), "first-groups")

    labelled = pairs.join(groups, F.col("id") == F.col("node"), "left").select("key", "id", "size", F.coalesce("component", "id").alias("label"))
    labelled = staged(labelled, "labelled")
    by_label = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    open_keys = by_label.groupBy(F.col("key").alias("key1")).agg(
        F.count("*").alias("labels"), F.max(F.struct("n", "label", "weight")).alias("most"), F.sum("weight").alias("total")
    ).where("labels > 1")
    # Rows outside the largest component are dealt over ``a`` blocks, those of it over ``m``; all over one where they fit.
    whole = F.col("total") <= block
    open_keys = open_keys.select(
        "key1", F.col("most.label").alias("largest"), whole.alias("whole"),
        F.greatest(F.lit(1), F.ceil((F.col("total") - F.col("most.weight")) / block)).cast("int").alias("a"),
        F.greatest(F.lit(1), F.ceil(F.col("most.weight") / block)).cast("int").alias("m"),
    )
    rows = labelled.join(open_keys, F.col("key") == F.col("key1"))
    own = F.when(F.col("label") == F.col("largest"), F.col("a") + dealt(F.col("m"))).otherwise(dealt(F.col("a"))).alias("own")
    rows = rows.select("key", "id", "label", "whole", "a", "m", own)
    lower = F.transform(F.sequence(F.lit(0), F.least("a", F.col("own") + 1) - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("t")))
    upper = F.when(F.col("own") < F.col("a"), F.transform(F.sequence(F.col("own") + 1, F.col("a") + F.col("m") - 1), lambda t: F.struct(F.col("own").alias("i"), t.alias("t"))))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")))
    tasks = F.when(F.col("whole"), one).otherwise(F.concat(lower, F.coalesce(upper, F.array().cast("array<struct<i:int,t:int>>"))))
    rows = rows.select("key", "id", "label", F.explode(tasks).alias("at"))
    rows = rows.join(held, F.col("id") == F.col("id2")).select(F.struct("key", "at").alias("task"), "id", "label", "hashes")
    second = staged(searched(rows, least), "second-links")
    return staged(components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).union(second)), "joined")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group, that of the least id. Equal
    texts are a group, and the exact check joins groups over pairs of texts that
    share a component of fingerprints or a band of least hashes.
    Rows with a null id stay; of rows that repeat an id, one stays. Columns of
    any name are kept as they are."""
    rows, ids = docs.agg(F.count(id_col), F.countDistinct(id_col)).first()
    if rows != ids:
        once = docs.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
        docs = staged(once, "once", "zstd")
    with small_batches(docs.sparkSession):
        (gone,) = tmp_names(docs, "copy_id_")
        copies = _copies(docs, id_col, text, shingle, radius, least).withColumnRenamed("id", gone)
        return docs.join(copies, F.col(id_col) == F.col(gone), "left_anti")


def _copies(docs: DataFrame, id_col: str, text: str, shingle: int, radius: int, least: float) -> DataFrame:
    """(id): the ids that go. ``id_col`` has no repeats but nulls."""
    known = staged(near_groups(docs, id_col, text, shingle, radius), "groups")
    content = F.coalesce(F.col(text), F.lit(""))
    hashed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.sha2(content, 256).alias("hash"))
    heads = hashed.groupBy("hash").agg(F.min("id").alias("head"))
    equal = staged(hashed.join(heads, "hash").select("id", "head"), "equal")
    only = equal.where("id = head").select("head")
    buckets = known.join(only, F.col("id") == F.col("head")).select(F.col("component").alias("key"), "id")
    banded = band_buckets(docs, id_col, text).join(only, F.col("id") == F.col("head"), "left_semi").select("key", "id")
    buckets = buckets.select(F.xxhash64("key").alias("key"), "id").union(banded)
    found = verified_groups(docs, buckets, least, id_col=id_col, text=text)
    copies = equal.where("id <> head").select("id").union(found.where("node <> component").select("node"))
    return staged(copies.distinct(), "copies")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_groups(docs).select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
