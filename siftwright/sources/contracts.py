"""Contracts of repositories by file name: OpenAPI, Protocol Buffers, GraphQL.

Files are picked by their path alone, so other texts are neither read nor sent
to Python: ``.proto``, ``.graphql`` and ``.gql``, and JSON or YAML whose name
hints at an API, outside of folders of tools and builds. A file that can't be
read as its kind has no contracts. YAML goes through PyYAML where it is
installed, and else through a reader of its block form (nested mappings, plain and
quoted scalars; lists and inline collections count as without content).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import text as tx
from siftwright.sources import parsers

#: Folders without contracts, suffixes by kind, hints in file names, verbs.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "target",
)
PROTO, GRAPHQL, OPENAPI = (".proto",), (".graphql", ".gql"), (".yaml", ".yml", ".json")
HINTS = ("openapi", "swagger", "api", "spec")
VERBS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")
ENDPOINT = "repo string, file string, method string, path string, operation_id string, request_ref string, response_ref string"


def kind_of(path: Column) -> Column:
    """proto, graphql, openapi, or null for other files."""
    name = F.lower(tx.basename(path))
    ends = lambda suffixes: F.rlike(name, F.lit("(" + "|".join(map(re.escape, suffixes)) + ")$"))
    skipped = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.array(*map(F.lit, SKIP_DIRS)))
    hint = F.rlike(name, F.lit("|".join(HINTS)))
    return F.when(~skipped, F.when(ends(PROTO), "proto").when(ends(GRAPHQL), "graphql").when(ends(OPENAPI) & hint, "openapi"))


def block_yaml(text: str) -> dict:
    """The nested mappings of a YAML text in block form."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for line in text.split("\n"):
        m = re.match(r"""^(\s*)(?:"([^"]*)"|'([^']*)'|([^\s#'"-][^#]*?|/[^#]*?)):(?:\s+(.*))?$""", line.rstrip())
        if not m:
            continue
        while stack[-1][0] >= len(m[1]):
            stack.pop()
        key = m[2] or m[3] or (m[4] or "").strip()
        value = re.sub(r"\s+#.*$", "", m[5] or "").strip()
        if value:
            stack[-1][1][key] = value.strip("\"'")
        else:
            stack[-1][1][key] = inner = {}
            stack.append((len(m[1]), inner))
    return root


def load(path: str, text: str):
    try:
        if path.lower().endswith(".json"):
            return json.loads(text)
        try:
            import yaml
        except ImportError:
            return block_yaml(text)
        return yaml.safe_load(text)
    except Exception:  # noqa: BLE001, whatever a reader raises on a text that isn't its kind
        return None


def reference(part) -> str:
    """The schema that a body or response refers to, at any media type."""
    if not isinstance(part, dict):
        return ""
    if isinstance(part.get("$ref"), str):
        return part["$ref"]
    content = part.get("content")
    media = content.values() if isinstance(content, dict) else ()
    return next((r for m in media if isinstance(m, dict) and (r := reference(m.get("schema")))), "")


def endpoints(path: str, text: str) -> list[tuple[str, str, str, str, str]]:
    """(method, path, operation_id, request_ref, response_ref) of a document."""
    doc = load(path, text)
    if not isinstance(doc, dict) or not {"openapi", "swagger"} & doc.keys() or not isinstance(doc.get("paths"), dict):
        return []
    out = []
    for route, verbs in doc["paths"].items():
        for verb, op in verbs.items() if isinstance(verbs, dict) and isinstance(route, str) else ():
            if str(verb).lower() in VERBS and isinstance(op, dict):
                responses = op.get("responses")
                codes = sorted(responses, key=lambda k: (not str(k).startswith("2"), str(k))) if isinstance(responses, dict) else ()
                found = next((r for c in codes if (r := reference(responses[c]))), "")
                out.append((str(verb).upper(), route, str(op.get("operationId") or ""), reference(op.get("requestBody")), found))
    return out


def openapi(files: DataFrame, repo: str = "repo", path: str = "path", text: str = "text") -> DataFrame:
    """Endpoints (as ``ENDPOINT``) of OpenAPI documents in JSON or YAML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, p, *e) for r, p, t in zip(*(c.to_pylist() for c in batch.columns)) for e in endpoints(p or "", t or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], [x.split(" ")[0] for x in ENDPOINT.split(", ")])

    return files.select(F.col(repo).cast("string"), path, text).mapInArrow(run, ENDPOINT)


def contracts(files: DataFrame, repo: str = "repo", path: str = "path", text: str = "text") -> DataFrame:
    """(repo, kind, name, detail) of all contracts: ``METHOD /path`` and its
    operation, ``Service/Rpc`` and its types, query or mutation and its type."""
    known = files.withColumn("kind_", kind_of(F.col(path)))
    http = openapi(known.where("kind_ = 'openapi'"), repo, path, text)
    rpcs = parsers.proto_rpcs(known.where("kind_ = 'proto'"), repo, text)
    fields = parsers.graphql_operations(known.where("kind_ = 'graphql'"), repo, text)
    return (
        http.select(F.col("repo"), F.lit("openapi").alias("kind"), F.concat_ws(" ", "method", "path").alias("name"), F.col("operation_id").alias("detail"))
        .unionByName(rpcs.select(F.col(repo).alias("repo"), F.lit("proto").alias("kind"), F.concat_ws("/", "service", "rpc").alias("name"), F.concat_ws(" -> ", "request_type", "response_type").alias("detail")))
        .unionByName(fields.select(F.col(repo).alias("repo"), F.lit("graphql").alias("kind"), F.concat_ws(" ", "kind", "name").alias("name"), F.col("return_type").alias("detail")))
    )
