"""Contracts by file name, the scan's patterns, the registry of packs."""

import pytest

from siftwright.operators.graph import shared_path
from siftwright.operators.packstore import PackStore
from siftwright.sources import contracts, parsers

YAML = """# a comment
openapi: "3.0.0"
info:
  title: x  # not a path
paths:
  /users/{id}:
    parameters: []
    get:
      operationId: getUser
      responses:
        '404':
          description: none
        '200':
          content:
            application/json:
              schema:
                $ref: '#/components/schemas/User'
    "post":
      requestBody:
        content:
          application/json:
            schema:
              $ref: "#/components/schemas/New"
  '/other':
    x-note:
      a: b
    delete:
      summary: gone
"""
WANT = [("GET", "/users/{id}", "getUser", "", "#/components/schemas/User"), ("POST", "/users/{id}", "", "#/components/schemas/New", ""), ("DELETE", "/other", "", "", "")]


def test_block_yaml_equals_a_full_reader():
    assert contracts.endpoints("a.yaml", YAML) == WANT
    doc = contracts.block_yaml(YAML)
    assert list(doc["paths"]) == ["/users/{id}", "/other"] and doc["paths"]["/users/{id}"]["get"]["operationId"] == "getUser"
    full = pytest.importorskip("yaml").safe_load(YAML)
    strip = lambda d: {str(k): strip(v) if isinstance(v, dict) else None for k, v in d.items()}
    assert strip(doc) == strip(full)


def test_without_the_yaml_package(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "yaml", None)
    assert contracts.endpoints("a.yaml", YAML) == WANT


def test_documents_that_are_none():
    for path, text in [("a.yaml", "paths: {}"), ("a.json", "{"), ("a.yaml", "openapi: 3\npaths:\n"), ("a.yaml", "- x"), ("a.json", '{"openapi": "3", "paths": {"/a": []}}'), ("a.yml", "")]:
        assert contracts.endpoints(path, text) == []


def test_dispatch_by_path(spark):
    paths = {"a/openapi.yaml": "openapi", "Swagger.JSON": "openapi", "x/my_spec.yml": "openapi", "plain.yaml": None, "s.PROTO": "proto", "a/q.gql": "graphql", "node_modules/x/api.json": None, "build": None, "src/build.proto": "proto", "dist/s.proto": None, "api.txt": None}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["path"]: r["k"] for r in df.select("path", contracts.kind_of(df["path"]).alias("k")).collect()} == paths


def test_scan_ignores_parts_of_paths(spark, tmp_path):
    for name in ("a/x.py", "a/y.pyc", "a/.git/z.py", "b/vendor/w.py", "b/test_q.py", "b/c.GO", "d.go", "e"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    got = parsers.scan_files(spark, str(tmp_path), ["py", ".go"], [".git", "vend*", "b/test_?.py"]).collect()
    assert sorted(r["text"] for r in got) == ["a/x.py", "d.go"]


def test_registry_keeps_the_newest(spark):
    now = [1.0]
    store = PackStore(spark, shared_path(spark, "registry"), keep=2, clock=lambda: now[0])
    pack = spark.createDataFrame([(1, 10), (2, 5)], "ord long, est_tokens long")
    assert store.list().count() == 0 and store.get("a") is None
    for name in "abac":
        store.save(pack, name, "review", "q " + name)
        now[0] += 1
    assert [tuple(r) for r in store.list().collect()] == [("c", "review", "q c", 4000, 15), ("a", "review", "q a", 3000, 15)]
    assert store.get("b") is None and sorted(map(tuple, store.get("a").collect())) == [(1, 10), (2, 5)]
    assert store.delete("a") and not store.delete("a") and store.list().count() == 1
    store.save(pack.limit(0), "e", "debug", "")
    assert store.list().first()["tokens"] == 0
