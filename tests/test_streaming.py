"""Streams that run, stop and go on: re-indexing, capture, replacement."""

from datetime import datetime, timedelta

from siftwright.operators.graph import shared_path
from siftwright.sources import code
from siftwright.streaming import events as ev
from siftwright.streaming import reindex

SCHEMA = "path string, ts timestamp, action string, text string"
BEGIN = datetime(2024, 1, 1)


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


class Project:
    def __init__(self, spark):
        self.spark, self.place = spark, shared_path(spark, "project")

    def change(self, *rows):
        self.spark.createDataFrame([(p, at(s), a, t) for p, s, a, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.place}/in")
        reindex.run(self.spark.readStream.schema(SCHEMA).parquet(f"{self.place}/in"), f"{self.place}/index", f"{self.place}/state", code.built_in(), late="1 second")

    def symbols(self):
        return sorted((r["path"], r["name"]) for r in reindex.snapshot(self.spark, f"{self.place}/index", "symbols").collect())

    def files(self):
        return {r["path"]: r for r in reindex.files(self.spark, f"{self.place}/index").collect()}


def test_bursts_deletes_errors_and_restarts(spark):
    p = Project(spark)
    p.change(("a.py", 0, "index", "def old(): pass"), ("a.py", 0.2, "index", "def a(): b()"), ("b.py", 1, "index", "def b(): pass"), ("c.py", 1, "index", "def c(): pass"), ("x.unknown", 1, "index", "?"), (None, 60, "index", None))
    assert p.symbols() == [("a.py", "a"), ("b.py", "b"), ("c.py", "c")]
    p.change(("a.py", 100, "delete", None), ("b.py", 100, "index", "def ("), ("c.py", 5, "index", "def late(): pass"), (None, 160, "index", None))
    assert p.symbols() == [("b.py", "b"), ("c.py", "c")]  # deleted; kept after an error; late
    assert [r["path"] for r in reindex.snapshot(spark, f"{p.place}/index", "errors").collect()] == ["b.py"]
    reindex.compact(spark, f"{p.place}/index")
    assert p.symbols() == [("b.py", "b"), ("c.py", "c")] and p.files()["a.py"]["action"] == "delete"
    p.change(("a.py", 200, "index", "def again(): pass"), ("a.py", 201, "index", "def again2(): pass"), (None, 260, "index", None))
    assert p.symbols() == [("a.py", "again2"), ("b.py", "b"), ("c.py", "c")]
    assert {k: r["bursts"] for k, r in p.files().items()} == {"a.py": 4, "b.py": 1, "c.py": 1}


def test_a_batch_that_runs_again_replaces_itself(spark):
    target = shared_path(spark, "index")
    write = reindex.into(target, code.built_in())
    bursts = spark.createDataFrame([("a.py", at(1), "index", "def a(): pass")], "path string, last timestamp, action string, text string")
    for _ in range(2):
        write(bursts, 0)
    write(bursts.limit(0), 1)
    assert reindex.snapshot(spark, target, "symbols").count() == 1 and reindex.folders(spark, f"{target}/batches", "batch") == [0, 1]


def test_nothing_indexed_yet(spark):
    target = shared_path(spark, "index")
    assert reindex.snapshot(spark, target, "symbols").count() == 0
    reindex.compact(spark, target)


def stream(spark, place, rows):
    spark.createDataFrame([(k, at(s), v) for k, s, v in rows], "k string, ts timestamp, v long").coalesce(1).write.mode("append").parquet(place)
    return ev.read_events(spark, place, spark.read.parquet(place).schema)


def test_capture_once_over_two_runs(spark):
    place = shared_path(spark, "capture")
    for rows in ([("a", 0, 1), ("a", 1, 2), ("b", 2, 3)], [("a", 3, 4), ("c", 4, 5)]):
        ev.run_available(ev.capture_once(stream(spark, f"{place}/in", rows), "k"), f"{place}/out", f"{place}/state")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{place}/out").collect() if r["k"] != "a") == [("b", 3), ("c", 5)]
    assert spark.read.parquet(f"{place}/out").where("k = 'a'").count() == 1


def test_replace_per_batch(spark):
    place = shared_path(spark, "replace")
    for rows in ([("a", 0, 1), ("b", 1, 2)], [("a", 2, 3), ("a", 3, 4)]):
        ev.replace_per_batch(stream(spark, f"{place}/in", rows), f"{place}/out", ["k"], f"{place}/state")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(f"{place}/out").collect()) == [("a", 3), ("a", 4), ("b", 2)]


#: Events of a key in seconds: less than six hours apart, exactly so, and by whole
#: seconds only (their fractions make the second pair less, the last one more).
GAPS = [("a", 0), ("a", 21599), ("b", 0), ("b", 21600), ("c", 0.2), ("c", 21600.1), ("d", 0.1), ("d", 21599.9), ("e", 0.9), ("e", 21601.8), ("f", 0), ("f", 0)]
BURSTS = {"a": 1, "b": 2, "c": 2, "d": 1, "e": 2, "f": 1}


def test_debounced_sessions_at_the_gap_equal_their_sql(spark, tmp_path):
    import duckdb

    from siftwright import catalog
    from tests.compare import assert_same

    rows = [(i, at(s), ord(k), "click") for i, (k, s) in enumerate(GAPS)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["debounce_sessions"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert_same(got, con.sql(catalog.SQL["debounce_sessions"]).df())
    assert {chr(u): n for u, n in got.groupby("user_id").size().items()} == BURSTS


def test_reindexed_bursts_at_the_gap_equal_their_sql(spark, tmp_path):
    import duckdb

    from siftwright import catalog
    from tests.compare import assert_same

    later = [("z", 30 * 86_400), ("z", 60 * 86_400 - 1)]  # of the second and the last third
    rows = [(i, at(s), ord(k), "click") for i, (k, s) in enumerate(GAPS + later)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["stream_reindex"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert_same(got, con.sql(catalog.SQL["stream_reindex"]).df())
    assert {chr(int(p[1:-3])): n for p, n in zip(got["path"], got["bursts"])} == BURSTS | {"z": 2}
