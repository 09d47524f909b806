"""The wiki's page, note and record exports."""

from datetime import date

from pyspark.sql import functions as F

from siftwright.operators import sinks, wiki

NODES = [(1, 0, "src/owner/a.py", "Owner.add(x)"), (2, 0, "src/owner/b.py", "save"), (3, 1, "lib\\util\\c.cs", "x"), (4, 2, "solo.py", "y"), (5, None, "no.py", "z")]
EDGES = [(2, 1, "calls"), (3, 1, "imports"), (4, 2, "calls"), (1, 3, "tested_by")]


def page(spark, nodes, edges, **kw):
    n = spark.createDataFrame(nodes, "node long, community int, file string, name string")
    e = spark.createDataFrame(edges, "src long, dst long, edge_type string")
    return wiki.page(wiki.sections(n, e, **kw), "demo", "2024-01-31").first()["text"]


def test_page_in_order_with_titles_and_anchors(spark):
    text = page(spark, NODES, EDGES)
    assert text.startswith("# demo — subsystem wiki\n\nGenerated on 2024-01-31.\n\n## TOC\n- [Subsystem: Owner](#subsystem-owner-0)\n- [Subsystem: util](#subsystem-util-1)\n- [Subsystem: solo.py](#subsystem-solo-py-2)\n\n## Subsystem: Owner\n")
    assert "**Hub symbols**: Owner.add(x) (inbound=2), save (inbound=1)\n" in text and text.count(wiki.NO_HUBS) == 2
    assert "This subsystem contains 2 file(s) and 2 symbol(s). The most connected symbols are Owner.add(x), save. Total inbound references across hub edges: 3." in text


def test_placeholders_fill_up_to_three_sections(spark):
    one = page(spark, NODES, EDGES, top=1)
    assert one.count("## Subsystem: ") == 3 and "- [Subsystem: placeholder 2](#subsystem-placeholder-2)" in one and "placeholder 3" not in one
    none = page(spark, [(1, None, "a", "b")], [])
    assert wiki.NOTHING in none and none.count("## Subsystem: placeholder") == 3 and "TOC" not in none


def test_top_rows_of_a_hot_group(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("g"), F.col("id"), (F.col("id") * 7919 % 10007).alias("v"))
    got = wiki.top_rows(df, ["g"], [F.desc("v"), F.asc("id")], 3, F.col("id")).collect()
    for g in ("hot", "cold"):
        want = sorted(((-(i * 7919 % 10007), i) for i in range(20_000) if (i % 10 > 0) == (g == "hot")))[:3]
        assert [(-r["v"], r["id"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["nth"])] == want


def test_notes_and_records(spark):
    rows = [(i, f"Use X {i}", "accepted" if i % 2 else "proposed", date(2024, 1, i), 0.9, "c", "d", None, ["t"] if i > 1 else None, "9" if i == 3 else None) for i in range(1, 5)]
    df = spark.createDataFrame(rows, "id long, title string, status string, created_at date, confidence double, context string, decision string, consequences string, tags array<string>, superseded_by string")
    got = {r["file_name"]: r["content"] for r in sinks.decision_records(df, [F.col("created_at")]).collect()}
    assert sorted(got) == ["0001-use-x-1.md", "0002-use-x-3.md"]
    assert got["0001-use-x-1.md"] == "# Use X 1\n\n**Status:** accepted  **Date:** 2024-01-01  **Confidence:** 0.9\n\n## Context\n\nc\n\n## Decision\n\nd\n\n## Tags\n\n_none_\n"
    assert "\n> **Superseded by:** `9`\n" in got["0002-use-x-3.md"] and "`t`" in got["0002-use-x-3.md"]
    notes = sinks.markdown_notes(df, "id", F.col("title"), F.lit("token: abc"), [F.desc("created_at")]).collect()
    assert sorted((r["file_name"], r["id"]) for r in notes)[0] == ("0001-use-x-4.md", 4) and all("[REDACTED]" in r["content"] for r in notes)
    assert sinks.decision_records(df.limit(0), [F.col("created_at")]).count() == 0
