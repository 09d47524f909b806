"""The stored inverted index against brute force, and what its plan reads."""

import math
import re

import pytest

from siftwright.functions.porter import stem
from siftwright.operators import graph, inverted

STEMS = (
    "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop "
    "falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit vietnamization vietnam "
    "decisiveness decis triplicate triplic formalize formal hopefulness hope adjustable adjust replacement replac adjustment adjust adoption adopt activate activ probate probat rate rate "
    "cease ceas controlling control roll roll is is be be y y"
).split()


@pytest.mark.parametrize("word,want", list(zip(STEMS[::2], STEMS[1::2])))
def test_stems_of_the_paper(word, want):
    assert stem(word) == want


def brute(rows, query, limit=200):
    docs = {i: [w for t in texts if t for w in inverted.stems(t)] for i, *texts in rows}
    mean = sum(map(len, docs.values())) / len(docs)
    total = {}
    for term in inverted.stems(query):
        n = {i: sum(w.startswith(term) for w in ws) for i, ws in docs.items()}
        df = sum(x > 0 for x in n.values())
        idf = max(1e-6, math.log((len(docs) - df + 0.5) / (df + 0.5))) if df else 0
        for i, x in n.items():
            if x:
                total[i] = total.get(i, 0) + idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    return [(i, round(s, 9)) for i, s in sorted(total.items(), key=lambda x: (-round(x[1], 9), x[0]))[:limit]]


ROWS = [
    (1, "prepareResources handles errors", "src/prepare.py"), (2, "error handling in prepared resources, preparing", None), (3, None, None), (4, "", "!!"), (5, "Café naïve ÉCOLE", "日本語 x"),
    (6, "a b c preparation", "src/a_b.py"), (7, "handle " * 50, "src/long.py"), (8, "errors erred erring", "p"), (9, "zeta", "q"), (10, "prepare", "prepare"), (11, "eta 9lives", "1.0.2"),
]


def test_search_equals_brute_force(spark):
    path = graph.shared_path(spark, "t")
    inverted.build(spark.createDataFrame(ROWS, "k long, name string, file string"), "k", ["name", "file"], path)
    for query in ("preparing error handling", "errors errors prepared", "cafe ecole", "日", "p", "9", "nothing here zzz", "", "!?", "prepare 1"):
        got = [(r["id"], r["score"]) for r in inverted.search(spark, path, query).collect()]
        want = brute(ROWS, query)
        assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(got, want)), query
    assert [r["id"] for r in inverted.search(spark, path, "error prepare", 2).collect()] == [i for i, _ in brute(ROWS, "error prepare", 2)]


def test_a_search_reads_its_partitions_only(spark):
    path = graph.shared_path(spark, "t")
    inverted.build(spark.createDataFrame(ROWS, "k long, name string, file string"), "k", ["name", "file"], path)
    plan = inverted.search(spark, path, "error prepare")._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[[^\]]*\]", plan)
    assert any("= er" in f and "= pr" in f for f in filters) and "StringStartsWith" in plan and "MapInArrow" not in plan
    assert len(filters) == 3 and sum(f == "PartitionFilters: []" for f in filters) == 1  # the one-row totals


def test_empty_table(spark):
    path = graph.shared_path(spark, "t")
    inverted.build(spark.createDataFrame([(1, None)], "k long, name string"), "k", ["name"], path)
    assert inverted.search(spark, path, "a").count() == 0
