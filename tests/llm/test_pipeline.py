import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from siftwright.llm import packing
from siftwright.llm.common import staged
from tests.llm.fixtures import documents, frame
from tests.llm.test_grouping import brute_kept
from tests.llm.test_layout import brute_targets
from tests.llm.test_text_scans import brute_redacted, quality_brute, secret_base

#: Names that the stages use themselves, as columns of the documents.
CLASHING = ["rejected_by", "copy_id_", "base_spans", "secret_spans", "copies_", "host", "path", "rule", "verdict", "fits_"]


def clashing(spark, rows=None):
    return frame(spark, rows).withColumns({c: F.lit("own") for c in CLASHING})


def test_stages_one_by_one(spark):
    docs = clashing(spark)
    COLUMNS = docs.columns
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_copies", "secret_scan", "mix_sources", "pack"]
    good = staged(stages["quality_rules"](spark, docs, ""), "t")
    assert good.columns == COLUMNS
    ids = {r["doc_id"] for r in good.collect()}
    short = {i for i, t, *_ in documents() if i is not None and len((t or "").split()) < 50}
    assert not ids & short and 0 in ids and 1 in ids

    single = staged(stages["near_copies"](spark, good, ""), "t")
    kept = [r["doc_id"] for r in single.collect()]
    assert len(kept) == len(set(kept)) and {0, 1, 2, 3} <= set(kept) and not set(range(60, 72)) & set(kept)
    known = {r["doc_id"]: r["text"] for r in good.collect() if r["doc_id"] is not None}
    assert sorted(i for i in kept if i is not None) == brute_kept(sorted(known.items()))

    clean = staged(stages["secret_scan"](spark, single, ""), "t")
    assert clean.columns == COLUMNS
    assert all(secret_base(r["text"]) == "" and r["n_chars"] == len(r["text"]) for r in clean.collect())

    mixed = staged(stages["mix_sources"](spark, clean, ""), "t")
    assert mixed.where(" or ".join(f"{c} <> 'own'" for c in CLASHING)).count() == 0
    assert mixed.columns == COLUMNS and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2

    packed = stages["pack"](spark, mixed, "").toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= packing.WINDOW
    assert packed[packed.start == 0].shape[0] == mixed.count()


def test_empty_corpus(spark):
    docs = clashing(spark, [])
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, ""), name)
    assert docs.count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Which documents stay, their redacted texts' tokens, and how often each is
    packed, from stages done by plain loops; of the mix, whose rounding is its own,
    each source's target and the bounds of copies."""
    from tokenizers import Tokenizer

    rows = documents()[:-2]
    frame(spark, rows).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).toPandas()

    def bad(t):
        n, chars, symbols, lines, dups, repeats, distinct, letters = quality_brute(t)
        return n < 50 or 100 * repeats > 50 * n or symbols > n or chars < 2 * n or chars > 20 * n or 2 * dups > lines or distinct < 8 or 10 * letters < chars

    good = [r for r in rows if not bad(r[1])]
    single = set(brute_kept([(r[0], r[1]) for r in good]))
    texts, sources = {}, {}
    for i, t, _, source, *_ in good:
        if i in single:
            spans = [tuple(map(int, s.split(":")[1:])) for s in secret_base(t).split(",") if s]
            texts[i], sources[i] = brute_redacted(t, spans), source
    sizes = {i: len(t.encode().split()) for i, t in texts.items()}
    totals = Counter()
    for i, n in sizes.items():
        totals[sources[i]] += n
    want = brute_targets(dict(totals))

    copies = Counter(got[got.start == 0].doc_id.astype(int))
    assert set(copies) <= single and max(copies.values()) <= 2
    for source, total in totals.items():
        mine = [i for i in texts if sources[i] == source]
        taken = sum(copies[i] * sizes[i] for i in mine)
        assert abs(taken - want[source]) <= max(sizes[i] for i in mine) / 2 + 1
        if want[source] >= 2 * total:
            assert all(copies[i] == 2 for i in mine)

    library = Tokenizer.from_file(packing.default_vocabulary())
    expected = Counter()
    for i, n in copies.items():
        ids = np.array(library.encode(texts[i], add_special_tokens=False).ids + [packing.END_ID], "<u4")
        for start in range(0, len(ids), packing.WINDOW):
            part = ids[start : start + packing.WINDOW]
            expected[i, start, len(part), zlib.crc32(part.tobytes()), len(ids)] += n
    assert Counter(zip(got.doc_id.astype(int), got.start, got.length, got.ids_crc32, got.doc_tokens)) == expected
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= packing.WINDOW
