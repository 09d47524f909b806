import itertools

import numpy as np
import xxhash

from siftwright.llm import simhash, vectors
from siftwright.llm.components import components
from tests.llm.fixtures import Groups, documents, frame


def brute_fingerprint(t, k=3):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark):
    rows = documents()
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows if i is not None}
    groups = Groups(fp)
    for a, b in itertools.combinations(sorted(fp), 2):
        if (fp[a] ^ fp[b]).bit_count() <= 2:
            groups.join(a, b)
    got = simhash.near_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component"] is None if r["id"] is None else (r["fp"] % 2**64, r["component"]) == (fp[r["id"]], groups.find(r["id"]))


def test_vantage_point_shards_are_exact(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 150, dtype=np.uint64)
    points = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << rng.integers(0, 64, 150).astype("u8")) for _ in range(5)]]))
    fps = spark.createDataFrame([(int(x.astype("i8")), i) for i, x in enumerate(points)], "fp long, rep long").persist()
    links = simhash.links(fps, 2, sample=200, shard=64)
    got = dict(components(links).collect())
    groups = Groups(range(len(points)))
    for i in range(len(points)):
        for j in np.nonzero(np.bitwise_count(points[i + 1 :] ^ points[i]) <= 2)[0]:
            groups.join(i, i + 1 + int(j))
    assert all(got.get(i, i) == groups.find(i) for i in range(len(points)))


def test_simhash_stage_keeps_one_of_each_group(spark):
    kept = simhash.drop_near_copies(frame(spark), radius=3)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(4) == 1 and ids.count(None) == 1
    assert 0 in ids and not set(range(60, 72)) & set(ids)
    assert set(range(60)) <= set(ids)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


def brute_vectors(rows, cosine=0.93):
    usable = [(i, np.array(v, float), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    groups, count = Groups([i for i, _, _ in rows if i is not None]), {i: 0 for i, _, _ in rows if i is not None}
    for (i, x, a), (j, y, b) in itertools.combinations(usable, 2):
        if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
            groups.join(i, j)
            count[i] += 1
            count[j] += 1
    return {i: (count[i], groups.find(i)) for i in count}


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in centre + rng.normal(size=8) * s], c % 3) for k, s in enumerate([0.02] * 6 + [0.25] * 12)]
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(7)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 8, 0), (n + 2, [float("nan")] * 8, 0), (n + 3, [None] * 8, 0), (n + 4, rows[0][1], None), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[0][1], 0, "x", 1)], "vec_id long, embedding array<float>, label int, ok string, cell int")
    want = brute_vectors(rows)
    for cell in (16, 4096):
        got = vectors.near_vectors(df, cell=cell).collect()
        assert len(got) == len(rows) + 1
        for r in got:
            if r["vec_id"] is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, None)
            else:
                assert (r["n_links"], r["component_id"]) == want[r["vec_id"]], r
                assert r["kept"] == (r["component_id"] == r["vec_id"])


def test_empty_tables(spark):
    assert simhash.near_groups(frame(spark, [])).count() == 0
    assert simhash.drop_near_copies(frame(spark, [])).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_similarity():
    assert simhash.similarity("a b c d e f", "A b c d e f") == 1.0
    assert simhash.similarity("", None) == 1.0 and simhash.similarity("a", "") == 0.0


def edited(base, places, mark):
    return " ".join(f"{mark}{k}" if k in places else w for k, w in enumerate(base))


def brute_kept(rows, least=0.8):
    groups = Groups([i for i, _ in rows])
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if simhash.similarity(a, b) >= least:
            groups.join(i, j)
    return sorted(i for i, _ in rows if groups.find(i) == i)


def test_copies_of_a_text_that_differs_from_the_first_are_found(spark):
    base = [f"w{k}" for k in range(80)]
    # The first two are 0.88 similar to the last and less than 0.8 to each other.
    first, second, mine = edited(base, {20}, "x"), edited(base, {60}, "y"), " ".join(base)
    far = edited(base, set(range(0, 80, 8)), "z")
    rows = [(1, first), (2, second), (3, second), (4, second), (5, far), (6, far), (9, mine)]
    assert simhash.similarity(first, second) < 0.8 <= simhash.similarity(first, mine)
    buckets = spark.createDataFrame([(0, i) for i, _ in rows], "key long, id long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(simhash.verified_groups(docs, buckets).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 9: 1, 5: 5, 6: 5}
    # At 64 bits all fingerprints are in one component, as when links chain.
    kept = simhash.drop_near_copies(docs, radius=64)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows) == [1, 5]


def test_copies_beyond_the_fingerprint_radius_are_found(spark):
    rng = np.random.default_rng(3)
    rows, pairs = [], []
    for n, edits in [(80, 1), (200, 2), (200, 4)] * 20:
        base = [f"v{k}" for k in rng.integers(0, 5000, n)]
        places = set((np.arange(edits) * 5 + rng.integers(0, n - 30)).tolist())
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, edited(base, places, "e"))]
    assert all(simhash.similarity(rows[a][1], rows[b][1]) >= 0.8 for a, b in pairs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.drop_near_copies(docs, radius=3)
    assert sorted(r["doc_id"] for r in kept.collect()) == brute_kept(rows) == [a for a, _ in pairs]


def test_blocks_of_a_bucket_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        edits = int(rng.integers(0, 6))
        rows.append((i, edited(base, set(rng.integers(0, 120, edits).tolist()), f"e{i % 4}x")))
    rows += [(90 + k, edited(base[:60], {k}, "q")) for k in range(6)] + [(100, ""), (101, " \t"), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = spark.createDataFrame([(k, i) for k in range(3) for i, _ in rows if k < 2 or i % 2], "key long, id long")
    for block in (1_500, 1_000_000):
        got = dict(simhash.verified_groups(docs, buckets, block=block).collect())
        assert sorted(i for i, _ in rows if got.get(i, i) == i) == brute_kept(rows)


def test_intersections_are_exact():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 400, int(n)).astype("<u8")) for n in rng.integers(0, 120, 150)]
    some = simhash.Sets(sets)
    for i in (0, 7, 149):
        want = [len(np.intersect1d(sets[i], s)) for s in sets]
        got = some.shared(i, np.arange(150))
        assert [g for k, g in enumerate(got.tolist()) if k != i] == [w for k, w in enumerate(want) if k != i]


def test_vectors_equal_the_sql(spark, tmp_path):
    """The registered SQL on vectors with links, odd rows included."""
    import duckdb

    rng = np.random.default_rng(3)
    rows = []
    for c in range(10):
        centre = rng.normal(size=6)
        rows += [(len(rows) + k, [float(np.float32(x)) for x in centre + rng.normal(size=6) * s], c % 2 if k < 9 else None) for k, s in enumerate([0.02] * 4 + [0.3] * 8)]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 6, 0), (n + 2, [float("nan")] * 6, 0), (n + 3, [1.0, None], 0), (n + 4, rows[0][1], 0), (n + 5, [], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    want = sorted(map(tuple, con.sql(vectors.SQL).fetchall()))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(spark.read.parquet(str(tmp_path / "e"))).collect())
    assert got == want and sum(r[1] for r in want) > 20 and len(want) == len(rows)
