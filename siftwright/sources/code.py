"""Code files as symbol and edge rows: the analyzers of this library.

Python files go through the standard library's parser, curly-bracket languages
through the bracket stack of ``brackets``, the others through patterns of their
declarations, line by line.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from siftwright.sources import brackets
from siftwright.sources.analyzers import Registry, Rows, index, parts

#: Declarations by extension: (kind, pattern with the name in group 1).
DECLARATIONS = {
    "rb": [("class", r"^\s*class\s+(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("method", r"^\s*def\s+(?:self\.)?([\w?!]+)")],
    "sql": [("table", r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([\w.]+)"), ("view", r"(?i)create\s+(?:or\s+replace\s+)?view\s+([\w.]+)"), ("function", r"(?i)create\s+(?:or\s+replace\s+)?function\s+([\w.]+)")],
    "yaml": [("k8s_resource", r"^kind:\s*(\w+)"), ("compose_service", r"^  ([\w-]+):\s*$")],
}
#: Extensions that another's analyzer reads.
ALIASES = {"tsx": "ts", "js": "ts", "jsx": "ts", "mjs": "ts", "yml": "yaml", "kt": "java"}


class PythonFiles:
    """Symbols and edges by the standard library's parser; a file that does not
    parse is an error."""

    def rows(self, path: str, text: str) -> Rows:
        import ast

        symbols, edges = [], []

        def visit(node: ast.AST, scope: str | None, owner: str | None) -> None:
            for child in ast.iter_child_nodes(node):
                name, of = scope, owner
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    args = ", ".join(a.arg for a in child.args.args)
                    symbols.append(("method" if owner else "function", child.name, child.lineno, child.end_lineno, f"{child.name}({args})", owner, ast.get_docstring(child) or ""))
                    name, of = child.name, None
                elif isinstance(child, ast.ClassDef):
                    symbols.append(("class", child.name, child.lineno, child.end_lineno, child.name, owner, ast.get_docstring(child) or ""))
                    edges.extend((child.name, b.id if isinstance(b, ast.Name) else b.attr, "extends") for b in child.bases if isinstance(b, (ast.Name, ast.Attribute)))
                    name, of = child.name, child.name
                elif isinstance(child, ast.Import):
                    edges.extend((scope or path, a.name, "imports") for a in child.names)
                elif isinstance(child, ast.ImportFrom) and child.module:
                    edges.append((scope or path, child.module, "imports"))
                elif isinstance(child, ast.Call):
                    f = child.func
                    called = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if called and scope:
                        edges.append((scope, called, "calls"))
                visit(child, name, of)

        visit(ast.parse(text), None, None)
        return symbols, edges


class BracketFiles:
    def __init__(self, language: str):
        self.language = language

    def rows(self, path: str, text: str) -> Rows:
        out = brackets.outline(path, text, self.language)
        return [(s.kind, s.name, s.line_start, s.line_end, s.signature, s.owner, s.docstring) for s in out.symbols], out.edges


class PatternFiles:
    """Declarations on lines of their own, without ends and edges."""

    def __init__(self, extension: str):
        self.patterns = DECLARATIONS[extension]

    def rows(self, path: str, text: str) -> Rows:
        out = []
        for n, line in enumerate(text.split("\n"), 1):
            for kind, pattern in self.patterns:
                if m := re.search(pattern, line):
                    out.append((kind, m[1], n, n, line.strip()[:200], None, ""))
                    break
        return out, []


@lru_cache
def built_in() -> Registry:
    """This library's analyzers; installed plug-ins may add other extensions."""
    registry = Registry()
    registry.register("py", PythonFiles)
    for k in brackets.LANGUAGES:
        registry.register(k, lambda k=k: BracketFiles(k))
    for k in DECLARATIONS:
        registry.register(k, lambda k=k: PatternFiles(k))
    for alias, k in ALIASES.items():
        registry.register(alias, lambda k=k: registry.found[k])
    registry.discover()
    return registry


def analyze(files: DataFrame, what: str = "symbols", path: str = "path", text: str = "text", registry: Registry | None = None) -> DataFrame:
    """``symbols``, ``edges`` or ``errors`` of (path, text) rows."""
    return parts(index(files, registry or built_in(), path, text), what)
