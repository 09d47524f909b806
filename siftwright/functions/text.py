"""Text and path expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of query widening.
STOP = (
    "fix", "add", "update", "remove", "the", "and", "for", "with", "from", "that", "this", "into", "out", "off", "doc", "docs",
    "code", "test", "tests", "src", "main", "new", "old", "use", "all", "any", "set",
)
#: Tests by folder or file name, and auxiliary folders.
TEST_PATH = r"(^|[\\/])(tests?|__tests__|spec)[\\/]|(^|[\\/])test_[^/\\]|[^/\\](_test|[Tt]est|[Ss]pec)\.[a-zA-Z]"
AUX_PATH = r"(?i)(^|[\\/])(scripts?|docs_src|examples?|fixtures|stubs|mocks)[\\/]"
#: Documentation by suffix, folder, and name at the top level.
DOCS_SUFFIX = r"(?i)[^/]\.(md|rst|adoc)$"
DOCS_FOLDER = r"(?i)(^|/)(docs|documentation|doc)(/|$)"
DOCS_NAME = (
    r"(?i)^(release-notes|changelog|history|notice|license|contributing|code_of_conduct|security|authors|maintainers|readme)[^/]*$"
)
#: Names where a flow starts.
VERBS = "get|post|put|delete|patch|head|options"
ENTRY_NAME = rf"^(?i:main)$|^(?i:test_)|^(?i:test)[A-Z]|^(?i:{VERBS})(_|[A-Z])"
#: What error messages lose before they are hashed.
VOLATILE = (r"(?i)\b(at\s+)?line[:\s]+\d+", "0x[0-9a-fA-F]+", r"\b\d{3,}\b")
#: Paths in lines of stack traces, tried in this order.
TRACE_PATHS = (r'File "([^"]+)"', r"\((\w+\.(?:java|kt|scala)):\d+\)", r"in (.+\.cs):line")
#: Keys of secrets, and bearer tokens.
SECRET_PAIR = r"(?i)((?:password|passwd|secret|token|api[_-]?key)\s*)([=:])\s*\S+"
BEARER = r"Bearer\s+[A-Za-z0-9\-._~+/]+=*"
#: Fixed value: what may follow an endpoint's path.
AFTER_ENDPOINT = r"[\"'`?/)\s]"


def camel_split(c: Column) -> Column:
    first = F.regexp_replace(c, "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(first, "([a-z0-9])([A-Z])", "$1 $2")


def tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-case tokens of ``least`` characters or more."""
    parts = F.split(F.lower(camel_split(F.coalesce(c, F.lit("")))), "[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= least))


def query_tokens(query: str, least: int = 3) -> list[str]:
    """The same tokens of a literal query, on the driver."""
    import re

    text = re.sub("([A-Z])([A-Z][a-z])", r"\1 \2", query)
    text = re.sub("([a-z0-9])([A-Z])", r"\1 \2", text).lower()
    return list(dict.fromkeys(t for t in re.split("[^a-z0-9]+", text) if len(t) >= least))


def token_estimate(c: Column, overhead: int = 0) -> Column:
    """A quarter of the characters, at least one; none for empty text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return (F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))) + overhead).cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The file's name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]+$", "$1")


def normal_path(path: Column) -> Column:
    """Trimmed, without leading dots and slashes, lower case."""
    return F.lower(F.regexp_replace(F.trim(path), "^[./]+", ""))


def is_test_path(path: Column) -> Column:
    """Tests and auxiliary scripts."""
    return F.rlike(path, F.lit(TEST_PATH)) | F.rlike(path, F.lit(AUX_PATH))


def is_docs_path(path: Column) -> Column:
    return F.rlike(path, F.lit(DOCS_SUFFIX)) | F.rlike(path, F.lit(DOCS_FOLDER)) | F.rlike(path, F.lit(DOCS_NAME))


def docs_only(paths: Column) -> Column:
    """Whether an array of changed paths has some, and all are documentation."""
    return F.coalesce((F.size(paths) > 0) & F.forall(paths, is_docs_path), F.lit(False))


def is_test_file(path: Column) -> Column:
    return F.startswith(stem(path), F.lit("test_")) | F.endswith(stem(path), F.lit("_test"))


def tested_stem(path: Column) -> Column:
    """The stem of the file that a test file tests, by its name."""
    name = stem(path)
    return F.when(F.startswith(name, F.lit("test_")), F.substring(name, 6, 2**31 - 1)).otherwise(F.regexp_replace(name, "_test$", ""))


def is_entry_name(name: Column) -> Column:
    """Names of flow entries: main, tests, and HTTP verbs with something after."""
    return F.coalesce(F.rlike(name, F.lit(ENTRY_NAME)), F.lit(False))


def slug(c: Column) -> Column:
    """Lower case; punctuation goes, blanks and underscores become one dash."""
    kept = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s_]+", "-"), "-+", "-"), "^-+|-+$", "")


def file_slug(c: Column, most: int = 40) -> Column:
    """ASCII slug of the first ``most`` characters, for file names."""
    dashed = F.regexp_replace(F.replace(F.substring(F.lower(c), 1, most), F.lit(" "), F.lit("-")), "[^a-z0-9-]", "")
    return F.regexp_replace(F.regexp_replace(dashed, "-{2,}", "-"), "^-+|-+$", "")


def anchor(title: Column, number: Column) -> Column:
    """In-page link of a numbered section."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.concat(F.lit("subsystem-"), F.coalesce(F.nullif(dashed, F.lit("")), F.lit("community")), F.lit("-"), number.cast("string"))


def redact(c: Column) -> Column:
    """Values of secret-like keys, up to white space, and bearer tokens
    replaced; keys stay."""
    return F.regexp_replace(F.regexp_replace(c, SECRET_PAIR, "$1$2[REDACTED]"), BEARER, "Bearer [REDACTED]")


def normal_error(c: Column) -> Column:
    """An error message without line references, addresses and long numbers."""
    for pattern in VOLATILE:
        c = F.regexp_replace(c, pattern, "")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def error_hash(name: Column, message: Column) -> Column:
    """Signature of an error's name and message."""
    return short_hash(normal_error(F.concat(name, F.lit(": "), message)))


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def paths_in(lines: Column) -> Column:
    """Paths of an array of stack-trace lines, one a line at most, in order."""

    def first(line: Column) -> Column:
        found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in TRACE_PATHS]
        return F.coalesce(*found)

    return F.array_distinct(F.filter(F.transform(lines, first), lambda p: p.isNotNull()))


def endpoint_pattern(path: str) -> str:
    """A regular expression that finds quoted uses of an endpoint path."""
    import re

    parts = re.split(r"(\{[^}]+\})", path)
    body = "".join(r"[^/\s\"'`)]*" if p.startswith("{") and p.endswith("}") else re.escape(p) for p in parts)
    return r"[\"'`]" + body + AFTER_ENDPOINT


def lines(c: Column, first: Column | int, last: Column | int) -> Column:
    """Lines ``first`` to ``last`` of a text, from 1."""
    first, last = (x if isinstance(x, Column) else F.lit(x) for x in (first, last))
    return F.array_join(F.slice(F.split(c, "\n"), first, last - first + 1), "\n")
