"""Mode classifiers: the first rule that matches gives category and weight."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwright.functions import text as tx

#: Weights by mode and category.
REVIEW = {"changed_file": 0.95, "blast_radius": 0.70, "impacted_test": 0.60, "config": 0.25, "query_match": 0.55, "file": 0.20}
IMPLEMENT = {"entrypoint": 0.90, "contract": 0.80, "extension_point": 0.70, "class": 0.40, "function": 0.30, "file": 0.20}
DEBUG = {"runtime_signal": 0.95, "past_debug": 0.90, "changed_file": 0.70, "failing_test": 0.85, "blast_radius": 0.50, "file": 0.20}
HANDOVER = {"changed_file": 0.90, "blast_radius": 0.50, "file": 0.15, "memory": 0.80, "decision": 0.75}
#: Names of entry points and extension points, parts of paths of
#: contracts, and parts of file names that hold no entry point.
ENTRY = r"(?i)^(main|app|router|handler|endpoint|create_app|get_app|make_app|run|serve)$"
EXTENSION = r"(?i)(Base|Abstract|Protocol|Interface|Mixin)"
CONTRACT = r"(?i)(contract|model|schema|interface)"
NO_ENTRY = r"(?i)(test_|_test|conftest|fix_|_fix|setup|migrate)"


def first_match(rules: Sequence[tuple[str, Column]], default: str) -> Column:
    out = None
    for name, hit in rules:
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default) if out is not None else F.lit(default)


def weight_of(category: Column, weights: Mapping[str, float], overrides: Mapping[str, float] | None = None) -> Column:
    merged = {**weights, **(overrides or {})}
    out = None
    for name, w in merged.items():
        out = F.when(category == name, w) if out is None else out.when(category == name, w)
    return out


def changed_prior(category: Column, weight: Column, path: Column) -> Column:
    """Changed source files gain 15 %, changed tests lose 15 %, up to 0.95."""
    factor = F.when(category == "changed_file", F.when(tx.is_test_path(path), 0.85).otherwise(1.15)).otherwise(1.0)
    return F.least(F.lit(0.95), weight * factor)


def review(changed: Column, blast: Column, impacted: Column, config: Column, matched: Column) -> Column:
    return first_match(
        [("changed_file", changed), ("blast_radius", blast), ("impacted_test", impacted), ("config", config), ("query_match", matched)], "file"
    )


def implement(name: Column, kind: Column, path: Column) -> Column:
    skip = F.rlike(tx.basename(path), F.lit(NO_ENTRY))
    entry = kind.isin("function", "method") & F.rlike(name, F.lit(ENTRY)) & ~skip
    contract = F.rlike(path, F.lit(CONTRACT))
    extension = (kind == "class") & F.rlike(name, F.lit(EXTENSION))
    return first_match(
        [("entrypoint", entry), ("contract", contract), ("extension_point", extension), ("class", kind == "class"), ("function", kind.isin("function", "method"))],
        "file",
    )


def debug(signal: Column, past: Column, changed: Column, failing: Column, blast: Column) -> Column:
    return first_match(
        [("runtime_signal", signal), ("past_debug", past), ("changed_file", changed), ("failing_test", failing), ("blast_radius", blast)], "file"
    )


def risk(in_diff: Column, size: Column, conf: Column) -> Column:
    return (
        F.when(~in_diff, "none").when((size > 2000) | (conf >= 0.8), "high").when(size > 500, "medium").otherwise("low")
    )


def depth_label(c1: Column, c2: Column) -> Column:
    a, b = F.coalesce(c1, F.lit(0.0)), F.coalesce(c2, F.lit(0.0))
    return F.when((a >= 0.75) & (a - b >= 0.15), "narrow").when(a >= 0.55, "standard").otherwise("broad")
