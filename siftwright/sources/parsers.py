"""Text sources as rows: diffs, traces, logs, test reports, notes, contracts.

Every parser is an expression over a text column, so one file or a million are
read alike; only code analysis and SDL parsing use a Python table function.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Status letters of name-status diffs.
STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "type_changed", "U": "unmerged"}


def ignored(relative: Column, patterns: Sequence[str]) -> Column:
    """Whether a shell-like pattern matches a part of a path, or all of it."""
    out = F.lit(False)
    for p in patterns:
        found = F.lit("^" + fnmatch.translate(p).replace("\\Z", "$").replace("\\z", "$"))
        out = out | F.exists(F.split(relative, "/"), lambda part: F.rlike(part, found)) | F.rlike(relative, found)  # noqa: B023
    return out


def scan_files(spark: SparkSession, root: str, extensions: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """(path, text) of the files below ``root`` with a known extension, whose path
    from there no ``ignore`` pattern matches. Paths are filtered before contents
    are decoded."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    known = F.rlike("path", F.lit(r"\.(" + "|".join(re.escape(e.lstrip(".")) for e in extensions) + ")$"))
    base = re.sub(r"^file:/+", "", root).strip("/")
    relative = F.substring_index(F.col("path"), base + "/", -1)
    return df.where(known & ~ignored(relative, ignore)).select("path", F.decode("content", "UTF-8").alias("text"))


def name_status(df: DataFrame, text: str) -> DataFrame:
    """(status, path): a rename or copy keeps its old path."""
    line = df.select(F.explode(F.split(text, "\n")).alias("line")).where("trim(line) <> ''")
    parts = F.split("line", "\t")
    names = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    return line.select(
        F.element_at(names, F.substring(F.get(parts, 0), 1, 1)).alias("status"), F.get(parts, 1).alias("path")
    ).where("path is not null and status is not null")


def unified_diff(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, path, line): changed lines of the new side; an empty hunk counts its
    first line. The path of a hunk is the last ``+++`` line before it."""
    lines = df.select(id_col, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    header = F.regexp_extract("line", r"^\+\+\+ (?:b/)?(.+?)\s*$", 1)
    over = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    held = lines.withColumn("path", F.last(F.when(header != "", header), ignorenulls=True).over(over))
    hunk = held.where(F.rlike("line", F.lit(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))).where("path is not null and path <> '/dev/null'")
    first = F.regexp_extract("line", r"\+(\d+)", 1).cast("int")
    count = F.regexp_extract("line", r"\+\d+,(\d+)", 1)
    size = F.greatest(F.lit(1), F.when(count == "", 1).otherwise(count.cast("int")))
    return hunk.select(id_col, "path", F.explode(F.sequence(first, first + size - 1)).alias("line")).distinct()


#: Fixed value: words that make a log line a signal.
SEVERITY = r"(?i)\b(ERROR|WARN(?:ING)?|CRITICAL|FATAL|SEVERE)\b"


def severity_of(line: Column) -> Column:
    """By the first severity word of a line, in any case; null without one."""
    word = F.upper(F.regexp_extract(line, SEVERITY, 1))
    return F.when(word == "", None).when(F.startswith(word, F.lit("WARN")), "warning").otherwise("error")


def log_lines(df: DataFrame, text: str, most: int = 500) -> DataFrame:
    """(severity, message): one row for each line with a severity word."""
    line = df.select(F.explode(F.split(text, "\n")).alias("line"))
    return line.select(severity_of(F.col("line")).alias("severity"), F.substring(F.trim("line"), 1, most).alias("message")).where("severity is not null")


#: Frames of Python, Java and .NET traces.
PYTHON_FRAME = r'File "[^"]+", line \d+, in \S+'
JAVA_FRAME = r"at [\w.$<>]+\([\w$]+\.(?:java|kt|scala):\d+\)"
DOTNET_FRAME = r"at [\w.<>]+\([^)]*\) in [^:\n]+(?::\\[^:\n]+)?:line \d+"


def stack_frames(df: DataFrame, id_col: str, text: str, most: int = 5) -> DataFrame:
    """(id, frames): the first frames of Python, Java and .NET traces as structs,
    in the order of the text."""

    def frame(s: Column) -> Column:
        python, dotnet = s.startswith("File"), F.rlike(s, F.lit(r":line \d+$"))
        file = F.when(python, F.regexp_extract(s, 'File "([^"]+)"', 1)).when(dotnet, F.regexp_extract(s, r" in (.+):line", 1)).otherwise(F.regexp_extract(s, r"\(([^:]+):", 1))
        function = F.when(python, F.regexp_extract(s, r"in (\S+)$", 1)).otherwise(F.regexp_extract(s, r"at ([\w.$<>]+)\(", 1))
        line = F.when(python, F.regexp_extract(s, r"line (\d+)", 1)).when(dotnet, F.regexp_extract(s, r":line (\d+)", 1)).otherwise(F.regexp_extract(s, r":(\d+)\)", 1))
        return F.struct(file.alias("file"), function.alias("function"), line.cast("int").alias("line"))

    found = F.regexp_extract_all(text, F.lit(f"({PYTHON_FRAME}|{JAVA_FRAME}|{DOTNET_FRAME})"), F.lit(1))
    return df.select(id_col, F.transform(F.slice(found, 1, most), frame).alias("frames"))


def dotnet_failures(df: DataFrame, text: str) -> DataFrame:
    """(test, message) of ``Failed <name>`` blocks."""
    block = df.select(F.explode(F.split(text, r"\n(?=\s*Failed )")).alias("block")).where(F.rlike("block", F.lit(r"^\s*Failed \S")))
    return block.select(
        F.regexp_extract("block", r"^\s*Failed (\S+)", 1).alias("test"),
        F.trim(F.regexp_extract("block", r"Error Message:\s*\n\s*([^\n]+)", 1)).alias("message"),
    )


def junit_failures(spark: SparkSession, path: str) -> DataFrame:
    """(test, kind, message) of failing test cases, by Spark's XML reader."""
    schema = "_classname string, _name string, failure struct<_message:string,_VALUE:string>, error struct<_message:string,_VALUE:string>"
    df = spark.read.format("xml").option("rowTag", "testcase").schema(schema).load(path)
    bad = F.coalesce("failure", "error")
    return df.where(bad.isNotNull()).select(
        F.concat_ws(".", "_classname", "_name").alias("test"), F.when(F.col("failure").isNotNull(), "failure").otherwise("error").alias("kind"),
        F.coalesce(bad["_message"], bad["_VALUE"]).alias("message"),
    )


def frontmatter(df: DataFrame, text: str, fields: list[str]) -> DataFrame:
    """Fields of a ``---`` header and the body; tolerant of a missing header."""
    has = F.rlike(text, F.lit(r"^---\n"))
    parts = F.split(text, r"(?m)^---\n", 3)
    head = F.when(has, F.get(parts, 1)).otherwise("")
    body = F.when(has, F.coalesce(F.get(parts, 2), F.lit(""))).otherwise(F.col(text))
    found = {f: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{f}:[ ]*(.*)$", 1)), F.lit("")) for f in fields}
    return df.withColumns(found).withColumn("body", body)


def queries_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, q, gold, repos, problem): a problem is named, not thrown."""
    df = spark.read.schema("id string, q string, gold array<string>, repos array<string>").json(path)
    seen = F.count("*").over(Window.partitionBy("id"))
    problem = (
        F.when(F.col("id").isNull() | F.col("q").isNull(), "missing field").when(F.coalesce(F.size("gold"), F.lit(0)) <= 0, "empty gold")
        .when(seen > 1, "duplicate id")
    )
    return df.withColumn("problem", problem)


def session_notes(df: DataFrame, text: str, schema: str) -> DataFrame:
    """Rows of a JSON text that holds an object or a list of them."""
    whole = F.when(F.rlike(text, F.lit(r"^\s*\[")), F.col(text)).otherwise(F.concat(F.lit("["), F.col(text), F.lit("]")))
    return df.select(F.explode(F.from_json(whole, f"array<struct<{schema}>>")).alias("s")).select("s.*")


def openapi_endpoints(df: DataFrame, repo: str, text: str) -> DataFrame:
    """(repo, path, method, operation_id) of an OpenAPI document in JSON."""
    op = "operationId:string,summary:string"
    paths = F.from_json(text, f"paths map<string,map<string,struct<{op}>>>")["paths"]
    first = df.select(repo, F.explode(paths).alias("path", "verbs"))
    verbs = first.select(repo, "path", F.explode("verbs").alias("method", "op"))
    return verbs.where(F.lower("method").isin("get", "post", "put", "patch", "delete", "head", "options")).select(
        repo, "path", F.upper("method").alias("method"), F.col("op.operationId").alias("operation_id")
    )


def proto_rpcs(df: DataFrame, repo: str, text: str) -> DataFrame:
    """(repo, service, rpc, request_type, response_type, streams)."""
    blocks = F.regexp_extract_all(text, F.lit(r"(service\s+\w+\s*\{(?:[^{}]|\{[^{}]*\})*\})"), F.lit(1))
    rows = df.select(repo, F.explode(blocks).alias("b")).withColumn("service", F.regexp_extract("b", r"service\s+(\w+)", 1))
    rpcs = F.regexp_extract_all("b", F.lit(r"(rpc\s+\w+\s*\([^)]*\)\s*returns\s*\([^)]*\))"), F.lit(1))
    rows = rows.select(repo, "service", F.explode(rpcs).alias("r"))
    part = lambda n: F.regexp_extract("r", r"rpc\s+(\w+)\s*\(\s*(stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(stream\s+)?([\w.]+)\s*\)", n)
    return rows.select(
        repo, "service", part(1).alias("rpc"), part(3).alias("request_type"), part(5).alias("response_type"),
        (part(2) != "").alias("request_stream"), (part(4) != "").alias("response_stream"),
    )


def graphql_operations(df: DataFrame, repo: str, text: str) -> DataFrame:
    """(repo, kind, name, return_type) of the root types' fields."""
    plain = F.regexp_replace(text, r"#[^\n]*", "")
    blocks = F.regexp_extract_all(plain, F.lit(r"(type\s+(?:Query|Mutation|Subscription)\b[^{]*\{[^}]*\})"), F.lit(1))
    rows = df.select(repo, F.explode(blocks).alias("b")).withColumn("kind", F.lower(F.regexp_extract("b", r"type\s+(\w+)", 1)))
    fields = F.regexp_extract_all("b", F.lit(r"(\w+\s*(?:\([^)]*\))?\s*:\s*[\[\]\w!]+)\s*(?=\n|\}|$)"), F.lit(1))
    rows = rows.select(repo, "kind", F.explode(fields).alias("f"))
    return rows.select(repo, "kind", F.regexp_extract("f", r"^(\w+)", 1).alias("name"), F.regexp_extract("f", r":\s*([\[\]\w!]+)$", 1).alias("return_type"))
