"""Runtime evidence: formats, order of frames, duplicates, odd files."""

from siftwright.sources import runtime

MIXED = """noise
Traceback (most recent call last):
  File "a/b.py", line 4, in run
    x()
  at com.x.Foo.bar(Foo.java:42)
  at N.C.M(Int32 a) in /p/q/Bar.cs:line 7
ValueError: bad 0x1f at line 12
tail

WARN slow File "x/y.py" and src/z.ts
later ERROR one
later ERROR one
fatal: two
"""

JUNIT = '<testsuites><testsuite name="s"><testcase classname="c.D" name="ok"/><testcase classname="c.D" name="bad"><failure message="boom">x\n  File "t.py", line 3\n</failure><error>also</error></testcase><testcase name="solo"><error/></testcase></testsuite></testsuites>'


def test_traces_and_logs_of_one_text():
    found = runtime.parse("x.log", MIXED)
    assert [(s.source, s.severity, s.message) for s in found] == [
        ("java", "error", "ValueError: bad 0x1f at line 12"), ("log", "warning", 'WARN slow File "x/y.py" and src/z.ts'), ("log", "error", "later ERROR one"), ("log", "error", "fatal: two"),
    ]
    assert found[0].top_frames == [{"file": "a/b.py", "function": "run", "line": 4}, {"file": "Foo.java", "function": "bar", "line": 42}, {"file": "Bar.cs", "function": "M(Int32 a)", "line": 7}]
    assert found[0].paths == ["a/b.py", "Foo.java", "/p/q/Bar.cs"] and found[0].stack[0] == "noise" and found[0].stack[-1] == "tail"
    assert found[0].error_hash == runtime.signature("ValueError", "ValueError: bad 0x2e at line 99") and found[1].paths == ["x/y.py", "src/z.ts"]


def test_frames_are_the_first_five_and_blocks_end_at_blank_lines():
    text = "".join(f'  File "f{i}.py", line {i}, in g\n' for i in range(8)) + "\n\n" + '  File "z.py", line 1, in h\nKeyError: k\n'
    first, second = runtime.traces(text)
    assert [f["line"] for f in first.top_frames] == [0, 1, 2, 3, 4] and len(first.paths) == 8
    assert (first.message, first.source, first.error_hash) == ("Stack trace detected", "unknown", "") and second.message == "KeyError: k"


def test_reports():
    found = runtime.parse("R.XML", JUNIT)
    assert [(s.message, s.failing_tests) for s in found] == [("c.D.bad: boom", ["c.D.bad"]), ("c.D.bad: also", ["c.D.bad"]), ("solo: ", ["solo"])]
    assert found[0].source == "junit:s" and found[0].paths == ["t.py"] and len(found[0].error_hash) == 16
    assert runtime.parse("r.xml", "<oops") == [] and runtime.parse("r.xml", "") == []


def test_runner_output_comes_before_traces():
    text = "Passed A\nFailed N.C.One\n  Error Message:\n   Assert.Equal() Failure\n  Stack Trace:\n     at N.C.One() in /p/Foo.cs:line 42\nFailed N.C.Two\nERROR x\n"
    found = runtime.parse("out.txt", text)
    assert [(s.message, s.paths) for s in found] == [("N.C.One: Assert.Equal() Failure", ["/p/Foo.cs"]), ("N.C.Two: Test failed", [])]


def test_rows_and_files(spark, tmp_path):
    rows = [("a.xml", JUNIT), ("b.txt", None), (None, "ERROR x"), ("c.log", MIXED)]
    got = runtime.signals(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted((r["path"], r["source"]) for r in got)[:2] == [("", "log"), ("a.xml", "junit:s")] and len(got) == 8
    (tmp_path / "d").mkdir()
    (tmp_path / "a.xml").write_text(JUNIT)
    (tmp_path / "d" / "c.log").write_bytes(MIXED.encode() + b"ERROR \xff\n")
    (tmp_path / "_SUCCESS").write_text("ERROR hidden")
    spark.dataSource.register(runtime.RuntimeSource)
    for files, parts in ((1, 2), (9, 1)):
        df = spark.read.format("runtime_signals").option("filesPerPartition", files).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == parts and df.count() == 8
    assert spark.read.format("runtime_signals").load(f"file://{tmp_path}/a.xml").count() == 3
    assert spark.read.format("runtime_signals").load(str(tmp_path / "none")).count() == 0


def test_files_of_the_query_are_written_by_several_tasks(spark):
    import re
    from pathlib import Path

    from siftwright import catalog
    from tests.conftest import SMALL

    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "siftwright"
    before = set(top.glob("runtime-*"))
    assert catalog.QUERIES["runtime_signals"](spark, SMALL).count() > 0
    (place,) = set(top.glob("runtime-*")) - before
    assert len({re.match(r"part-(\d+)", f.name)[1] for f in place.glob("texts/*/part-*")}) > 1
