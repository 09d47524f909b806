"""Runtime evidence as rows: test reports, test output, stack traces and logs.

The format of a file follows from its name and content: ``.xml`` is a JUnit
report; other text is test-runner output where it has failed tests, and else
stack traces and log lines together. Of signals of one file with one message the
first stays. ``RuntimeSource`` is a Spark data source, with partitions of some
files each, for folders that Arrow's file systems reach; ``signals`` takes rows of path and
text, for instance of Spark's own readers. A file that can't be parsed has no
signals; null text is empty.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftwright.functions import text as tx

SCHEMA = (
    "path string, source string, severity string, message string, stack array<string>, paths array<string>, error_hash string, "
    "top_frames array<struct<file:string,function:string,line:bigint>>, failing_tests array<string>"
)
FRAME_TYPE = pa.struct([("file", pa.string()), ("function", pa.string()), ("line", pa.int64())])
TYPES = [*[pa.string()] * 4, pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.list_(FRAME_TYPE), pa.list_(pa.string())]
NAMES = [x.split(" ")[0] for x in re.split(r", (?=\w+ )", SCHEMA)]

#: Lines of stack traces, by language.
FRAMES = (r'\s*File "[^"]+", line \d+', r"\s+at \S+\(\w+\.(?:java|kt|scala):\d+\)", r"\s+at .+ in .+\.cs:line \d+")
#: Fixed values: (file, function, line) of a frame, as groups by name.
DETAILS = (
    r'File "(?P<file>[^"]+)", line (?P<line>\d+), in (?P<function>\S+)', r"at (?P<function>[\w$.]+)\((?P<file>\w+\.(?:java|kt|scala)):(?P<line>\d+)\)",
    r"at (?P<function>[\w.`<>[\]]+\(.*?\))\s+in (?P<file>.+\.cs):line (?P<line>\d+)",
)
#: Heads of exceptions, in the order in which they are tried.
HEADS = (
    ("java", r"^(?:[\w.]+\.)?(\w+Exception|\w+Error):\s*(.+)"), ("dotnet", r"^(?:[\w.]+\.)?(\w+Exception):\s*(.+)"), ("python", r"^(?:\w+\.)*(\w+Error|\w+Exception|\w+Warning):\s*(.+)"),
)
#: Paths in frames, in frames of test reports, and in log lines; severity words.
FRAME_PATHS = (r'File "([^"]+)"', r"\((\w+\.(?:java|kt|scala)):\d+\)", r"in (.+\.cs):line")
REPORT_PATHS = (r'File "([^"]+)", line \d+', r"\((\w+\.(?:java|kt|scala)):\d+\)", r"in (.+\.cs):line \d+")
LOG_PATHS = r'File "([^"]+)"|(\S+\.(?:py|java|cs|kt|rb|go|ts|js))'
SEVERITY = r"(?i)\b(ERROR|WARN(?:ING)?|CRITICAL|FATAL|SEVERE)\b"
#: Characters of a log message, frames kept, characters of a message
#: taken from a report's text.
LOG_CHARS, TOP_FRAMES, REPORT_CHARS = 500, 5, 200


@dataclass
class Signal:
    source: str
    severity: str
    message: str
    stack: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    error_hash: str = ""
    top_frames: list[dict] = field(default_factory=list)
    failing_tests: list[str] = field(default_factory=list)


def signature(name: str, message: str) -> str:
    """Hash of an error without its volatile parts."""
    text = f"{name}: {message}"
    for pattern in tx.VOLATILE:
        text = re.sub(pattern, "", text)
    return hashlib.sha256(" ".join(text.split()).lower().encode()).hexdigest()[:16]


def first_paths(lines: list[str], patterns: tuple[str, ...], once: bool) -> list[str]:
    """A path a line at most, in order."""
    found = [next((m[1] for p in patterns if (m := re.search(p, line))), None) for line in lines]
    found = [p for p in found if p]
    return list(dict.fromkeys(found)) if once else found


def top_frames(lines: list[str]) -> list[dict]:
    """The first frames in text order, whatever their language."""
    out = []
    for line in lines:
        if m := next((m for p in DETAILS if (m := re.search(p, line))), None):
            java, dotnet = "(" in line and m["file"].endswith((".java", ".kt", ".scala")), m["file"].endswith(".cs")
            name = m["function"].split(".")[-1] if java or dotnet else m["function"]
            out.append({"file": re.split(r"[/]", m["file"])[-1] if dotnet else m["file"], "function": name, "line": int(m["line"])})
            if len(out) == TOP_FRAMES:
                break
    return out


def trace_blocks(text: str) -> Iterator[list[str]]:
    """Lines up to the first blank one after a frame, again and again."""
    block, framed = [], False
    for line in text.splitlines():
        framed = framed or any(re.search(p, line) for p in FRAMES)
        if framed and not line.strip():
            yield block
            block, framed = [], False
        else:
            block.append(line)
    if framed:
        yield block


def traces(text: str) -> list[Signal]:
    out = []
    for block in trace_blocks(text):
        whole = "\n".join(block)
        source, m = next(((s, m) for s, p in HEADS if (m := re.search(p, whole, re.M))), ("unknown", None))
        stack = [x.strip() for x in block if x.strip()]
        message = f"{m[1]}: {m[2]}" if m else "Stack trace detected"
        out.append(Signal(source, "error", message, stack, first_paths(block, FRAME_PATHS, True), signature(m[1], message) if m else "", top_frames(stack)))
    return out


def log_signals(text: str) -> list[Signal]:
    out = []
    for line in text.splitlines():
        if m := re.search(SEVERITY, line):
            severity = "warning" if m[1].upper().startswith("WARN") else "error"
            out.append(Signal("log", severity, line.strip()[:LOG_CHARS], paths=[a or b for a, b in re.findall(LOG_PATHS, line)]))
    return out


def runner_signals(text: str) -> list[Signal]:
    """Failed tests of a test runner's output, each with the lines up to the next."""
    out = []
    for block in re.split(r"^(?=(?:Failed|Error)\s+\S)", text, flags=re.M):
        if name := re.match(r"(?:Failed|Error)\s+(\S+)", block):
            message = re.search(r"Error Message:\s*\n\s*([^\n]+)", block)
            stack = [x.strip() for x in block.splitlines() if re.search(r"\s*at .+ in .+\.cs:line \d+", x)]
            out.append(Signal("dotnet", "error", f"{name[1]}: {message[1].strip() if message else 'Test failed'}", stack, first_paths(stack, (r"\s*at .+ in (.+\.cs):line",), False)))
    return out


def report_signals(text: str) -> list[Signal]:
    """Failures and errors of a JUnit report; a report that isn't XML has none."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return []
    out = []
    for suite in root.findall("testsuite") if root.tag == "testsuites" else [root]:
        for case in suite.findall("testcase"):
            test = ".".join(x for x in (case.get("classname", ""), case.get("name", "")) if x) if case.get("classname") else case.get("name", "")
            for bad in (case.find("failure"), case.find("error")):
                if bad is not None:
                    body = (bad.text or "").strip()
                    message = bad.get("message", "") or body[:REPORT_CHARS]
                    stack = [x.strip() for x in body.splitlines() if x.strip()]
                    digest = hashlib.sha256(f"{test}:{message}".lower().strip().encode()).hexdigest()[:16]
                    out.append(Signal(f"junit:{suite.get('name', '')}", "error", f"{test}: {message}", stack, first_paths(stack, REPORT_PATHS, False), digest, failing_tests=[test]))
    return out


def parse(path: str, text: str) -> list[Signal]:
    if path.lower().endswith(".xml"):
        return report_signals(text)
    if found := runner_signals(text):
        return found
    return list({s.message: s for s in reversed([*traces(text), *log_signals(text)])}.values())[::-1]


def batch(path: str, text: str | None) -> pa.RecordBatch:
    found = parse(path, text or "")
    columns = [[path] * len(found), *([getattr(s, n) for s in found] for n in NAMES[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES)], NAMES)


def signals(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Signals of rows of path and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, t in zip(*(c.to_pylist() for c in b.columns)):
                yield batch(p or "", t)

    return files.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


#: Bytes and files of a partition of the source, at most, unless one file has more.
PARTITION_BYTES, PARTITION_FILES = 32_000_000, 200


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RuntimeSource(DataSource):
    """``spark.read.format("runtime_signals").load(folder or file)``."""

    @classmethod
    def name(cls) -> str:
        return "runtime_signals"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RuntimeReader(self.options["path"], int(self.options.get("filesPerPartition", PARTITION_FILES)))


class RuntimeReader(DataSourceReader):
    def __init__(self, place: str, files: int):
        self.files = files
        self.place = re.sub(r"^file:/(?!/)", "file:///", place)

    def opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.place) if "://" in self.place else (fs.LocalFileSystem(), self.place)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, at = self.opened()
        info = store.get_file_info(at)
        if info.type == fs.FileType.File:
            return [Files([at])]
        found = store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
        out, held = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                if not out or held + f.size > PARTITION_BYTES or len(out[-1].paths) == self.files:
                    out.append(Files([]))
                    held = 0
                out[-1].paths.append(f.path)
                held += f.size
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files
            return
        store, _ = self.opened()
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                yield batch(path, f.read().decode("utf-8", "replace"))
