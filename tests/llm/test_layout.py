import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwright.llm import mixing, packing, shards, warc
from siftwright.llm.common import fresh_path
from tests.llm.fixtures import documents, frame


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(packing.default_vocabulary())


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("abcXYZéÀß'’.,;<|>0123 \n\t½²µªº«»×÷ÿ\x0b\x1c\x85\u00a0ǅΣİ日😀́"), st.characters(codec="utf-8")), max_size=50))
def test_token_ids_equal_the_library(library, words, text):
    ids, ends = words(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and ends.tolist() == [len(ids)]


def test_special_tokens_in_texts(library, words):
    for text in ["<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "it's we'll 'S 're <| x"]:
        assert words(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, library):
    rows = documents()
    got = packing.pack_documents(frame(spark, rows)).toPandas()
    assert sorted(Counter(got.sequence_id)) == list(range(got.sequence_id.nunique()))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= got.length.sum() / 2048 + 1
    for i, t, *_ in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = got[got.doc_id.isna() if i is None else got.doc_id == i].sort_values("start").drop_duplicates("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    assert packing.pack_documents(frame(spark, [])).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 6), min_size=1, max_size=12), st.integers(1, 60))
def test_subset_sum_is_the_fullest(counts, capacity):
    used = packing.fullest(counts, capacity)
    assert all(0 < n <= counts[k] for k, n in used.items())
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * m for s in sums for m in range(n + 1) if s + k * m <= capacity}
    assert sum(k * n for k, n in used.items()) == max(sums)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_patterns_use_every_piece_once(counts):
    total = Counter()
    for times, used in packing.min_bin_slack(counts, 64):
        assert sum(k * n for k, n in used.items()) <= 64
        for k, n in used.items():
            total[k] += times * n
    assert total == Counter(counts)


def test_shards_are_near_equal_and_slots_gapless(spark):
    rows = [(i % 900, f"text {i % 7}" if i % 3 == 0 else "x" * (i % 50), None, "hot" if i % 2 else None, i % 50, *[None] * 3) for i in range(3000)]
    rows += [(5000, None, *[None] * 6)]
    meta = {"n": F.col("n_chars"), "source": shards.number_of(F.col("source"))}
    got = shards.shard_documents(frame(spark, rows), shards=24, metadata=meta).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and sorted(sizes.index) == list(range(24))
    assert sizes.max() - sizes.min() < 0.08 * sizes.mean()
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    row = got[got.id == 5000].iloc[0]
    assert (row["size"], row["text_crc32"]) == (8, 0)
    assert shards.shard_documents(frame(spark, []), shards=24, metadata=meta).count() == 0
    assert shards.shard_documents(frame(spark), target_bytes=50_000).agg(F.countDistinct("shard")).first()[0] > 2


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        free = [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def brute_rates(sizes, target, tilt, cap=2.0):
    """Rates of documents of these sizes, by bisection on the dual."""
    mean = max(1.0, sum(sizes) / len(sizes))
    x = np.maximum(np.array(sizes) / mean, 1e-6) ** tilt
    low, high = -60.0, 60.0
    for _ in range(200):
        lam = (low + high) / 2
        rate = np.minimum(cap, np.exp(np.minimum(lam * x, 50)))
        low, high = (lam, high) if rate @ np.array(sizes, float) < target else (low, lam)
    return rate


@pytest.mark.parametrize("tilt", [0.0, 0.5])
def test_mixing_meets_its_targets(spark, tilt):
    rows = documents()
    got = mixing.mix(frame(spark, rows), size_tilt=tilt).toPandas()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, _, s, *_ in rows:
        sizes.setdefault(s, []).append(len((t or "").encode().split()))
    want = brute_targets({s: sum(v) for s, v in sizes.items()})
    varied = 0
    for s, g in got.groupby("source", dropna=False):
        s = None if s != s else s
        assert g.source_size.iloc[0] == sum(sizes[s]) and abs(g.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        positive = g["size"][g["size"] > 0]
        small = positive.max() < 0.05 * want[s]
        assert abs((g.copies * g["size"]).sum() - want[s]) <= (max(positive.min(), 1e-4 * want[s]) if small else positive.max() / 2) + 1
        assert g.copies.between(0, 2).all()
        if tilt and 0 < want[s] < 2 * sum(sizes[s]):
            rates = brute_rates(sizes[s], want[s], tilt)
            varied += rates.max() - rates.min() > 0.05
    assert not tilt or varied
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3), size_tilt=tilt).toPandas()
    key = lambda f: sorted(map(repr, f[["id", "size", "copies"]].itertuples(index=False)))
    assert key(got) == key(again)


def test_copies_are_the_rates_but_for_rounding(spark):
    """Of each source and size, whole copies differ from the brute-force rates by
    the rounding of running sums, and by what brings the source to its target."""
    rng = np.random.default_rng(6)
    sizes = {f"s{k}": rng.integers(1, 400, 300).tolist() for k in range(3)}
    rows = [(1000 * k + i, " ".join(["w"] * n), None, s, 0, "x", "y", "z") for k, (s, v) in enumerate(sizes.items()) for i, n in enumerate(v)]
    got = mixing.mix(frame(spark, rows)).toPandas()
    want = brute_targets({s: sum(v) for s, v in sizes.items()})
    for s, v in sizes.items():
        rates = brute_rates(v, want[s], mixing.SIZE_TILT)
        mine = got[got.source == s].groupby("size").copies.sum()
        wish = Counter()
        for n, r in zip(v, rates):
            wish[n] += r
        off = {n: mine[n] - wish[n] for n in wish}
        assert max(abs(x) for x in off.values()) <= 2 and sum(abs(x) > 1 for x in off.values()) <= 8
        assert abs(sum(off.values())) <= 3 and abs(sum(n * x for n, x in off.items())) <= max(1.0, 1e-4 * want[s]) + min(v)


def test_duals_equal_a_brute_force_solver(spark):
    rng = np.random.default_rng(2)
    classes, targets, want = [], [], {}
    for k, share in enumerate([0.2, 0.7, 1.0, 1.4, 1.9, 2.0, 0.0]):
        sizes = np.unique(rng.integers(1, 3000, 40)).tolist()
        mean = max(1.0, sum(sizes) / len(sizes))
        total = sum(sizes)
        classes += [(f"s{k}", s, 1, float(max(s / mean, 1e-6) ** 0.5)) for s in sizes]
        targets.append((f"s{k}", total, total * share))
        want[f"s{k}"] = (sizes, brute_rates(sizes, total * share, 0.5))
    duals = mixing.solve_dual(
        spark.createDataFrame(classes, "source string, size long, n long, x double"), spark.createDataFrame(targets, "source string, source_size long, target double")
    )
    lams = {r["source"]: r["lam"] for r in duals.collect()}
    assert lams.keys() == want.keys()
    for s, (sizes, rates) in want.items():
        mean = sum(sizes) / len(sizes)
        mine = np.minimum(2.0, np.exp(np.minimum(lams[s] * np.sqrt(np.array(sizes) / mean), 50)))
        assert np.allclose(mine, rates, atol=1e-5)


def test_mixing_an_empty_table(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_mixing_carries_all_columns(spark):
    df = frame(spark)
    out = mixing.mix(df, carry="copies_")
    assert out.columns == [*df.columns, "copies_"] and out.count() == df.count()


def test_warc_round_trip(spark):
    pages = [(1, "http://a/\r\nx", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (0, "u", ""), (None, "u", "<p>é</p>"), (4, "u", "y" * 300_000), (1, "u", "<p>é</p>"), (5, "v", "z")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    folder = fresh_path(spark, "test-warc")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    index = warc.write(df.select("page_id", "url", payload), folder, file_bytes=500)
    got = warc.read(index, folder).toPandas()
    assert len(got) == len(pages) and got.intact.all()
    seen = Counter((None if r.page_id != r.page_id else int(r.page_id), r.record_type, None if r.refers_to != r.refers_to else int(r.refers_to), r.payload_bytes, r.payload_digest) for r in got.itertuples())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    p, e = (9, sha("<p>é</p>")), (0, sha(""))
    assert seen == Counter([(1, "response", None, *p), (1, "response", None, *p), (2, "revisit", 1, *p), (None, "revisit", 1, *p), (0, "response", None, *e), (3, "revisit", 0, *e), (4, "response", None, 300_000, sha("y" * 300_000)), (5, "response", None, 1, sha("z"))])
    some = warc.read(index.where("url = 'v'"), folder).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in some] == [(5, b"z")]
    all_responses = warc.write(df.select("page_id", "url", payload), folder, min_bytes=10**6)
    assert all_responses.where("record_type = 'revisit'").count() == 0


def test_ranges_coalesce():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 40, 5), ("a", 500, 5), ("b", 0, 5)]
    assert [len(g) for g in warc.ranges(rows, read_bytes=100, gap=30)] == [3, 1, 1]
