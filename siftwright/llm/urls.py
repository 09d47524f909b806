"""URL filter: pattern rules indexed by their rarest literal token [native].

A rule states the literal tokens that any matching URL must hold. Token counts
over all URLs tell which of a rule's tokens is rarest, and the rule is filed
under that one only. A URL's tokens fetch candidate rules, and only those run
their regular expression. Small rule lists live in the expression as a map;
longer ones are a table joined on the token over distinct URLs, so that neither
a hot token nor a hot URL multiplies work.

A null URL, or one without ``://``, has an empty host and path, matches no
rule, and is allowed. Repeated rows get equal verdicts; an empty table gives an
empty table. Added columns whose names are taken get underscores (``tmp_names``
tells them); the columns of the table pass through as they are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import table, tmp_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many become a literal map; beyond it, a joined table.
LITERAL_RULES = 64
#: Rules up to this many (their size is bounded by it) may be broadcast.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Pattern:
    """``regex`` runs on host and path, joined; ``tokens`` are whole tokens of
    every match. A higher ``rank`` wins."""

    label: str
    action: str
    regex: str
    tokens: tuple[str, ...] = field(default=())
    rank: int = 0


def host_rule(action: str, host: str, path: str) -> Pattern:
    """Fits ``host`` and its subdomains where the path starts with ``path``.

    A token that ends the prefix may go on in the URL, so it is not literal.
    """
    regex = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path)
    whole = host + path
    tokens = re.findall("[a-z0-9]+", whole.lower())
    if tokens and re.search("[A-Za-z0-9]$", whole):
        tokens = tokens[:-1]
    return Pattern(host + path, action, regex, tuple(dict.fromkeys(tokens)), 1000 + len(whole))


def listed_rule(line: str) -> Pattern | None:
    """A line of a filter list: ``||host^`` and ``||host/path`` fit a host and
    its subdomains, ``|start`` the start of the host, ``*`` anything, ``^`` a
    separator or the end; ``@@`` allows, all else blocks. Comments, options and
    rules for page elements give None. Its tokens are those whose both ends are
    fixed by the rule."""
    text = line.strip()
    if not text or text.startswith(("!", "[")) or "##" in text or "$" in text or "#@#" in text:
        return None
    allow, body = text.startswith("@@"), text.removeprefix("@@")
    host, start = body.startswith("||"), body.startswith("|") and not body.startswith("||")
    end = body.endswith("|") and len(body) > 1
    core = body.lstrip("|").removesuffix("|") if end else body.lstrip("|")
    core = core.removeprefix("https://").removeprefix("http://") if start else core
    if not core.strip("*^"):
        return None
    regex = "".join({"*": ".*", "^": "(?:[^A-Za-z0-9_.%-]|$)"}.get(c, re.escape(c)) for c in core)
    regex = ("^(?:[^/]*\\.)?" if host else "^" if start else "") + regex + ("$" if end else "")
    padded = (" " if host or start else "x") + core.replace("*", "x").lower() + (" " if end else "x")
    tokens = re.findall(r"(?<![a-z0-9])[a-z0-9]+(?![a-z0-9])", padded)
    tokens = [t for t in tokens if re.search(r"(?<![a-z0-9*])" + t + r"(?![a-z0-9*])", core.lower())]
    return Pattern(text, "allow" if allow else "block", regex if host or start else "(?i)" + regex, tuple(dict.fromkeys(tokens)), (10_000 if allow else 0) + len(core))


def listed_rules(lines: Sequence[str]) -> list[Pattern]:
    """The rules of a filter list, first of each kind."""
    rules = [r for r in map(listed_rule, lines) if r is not None]
    return list({r.label: r for r in rules}.values())


#: The contract's rules.
RULES = (
    host_rule("allow", "com", "/"),
    host_rule("block", "example.com", "/en/"),
    host_rule("allow", "www.example.com", "/en/"),
    host_rule("block", "net", "/es/"),
    host_rule("block", "net", "/fr/"),
)
#: The method's own verdict where no host rule fits.
PATTERNS = (
    Pattern("ad host", "block", r"^(?:[^/]*\.)?ads\.", ("ads",), 1),
    Pattern("ad server", "block", r"/adserver(?:/|$)", ("adserver",), 1),
    Pattern("casino", "block", r"(?:^|[./-])casino[./-]", ("casino",), 1),
)


def lowered(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(address: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(lowered(address), "[^a-z0-9]+", -1), ""))


def index_rules(addresses: DataFrame, column: str, rules: Sequence[Pattern]) -> dict[str, list[int]]:
    """Token -> numbers of the rules filed under it; "" holds rules without a
    literal token. Counts cover all addresses; only rule tokens are counted, so
    the driver gets at most one row for each."""
    words = sorted({t for r in rules for t in r.tokens})
    seen: dict[str, int] = {}
    if words and max(len(r.tokens) for r in rules) > 1:
        spark = addresses.sparkSession
        known = spark.createDataFrame([(w,) for w in words], "token string")
        held = addresses.select(F.explode(tokens_of(F.col(column))).alias("token"))
        if len(words) <= BROADCAST_RULES:
            known = F.broadcast(known)
        seen = {r[0]: r[1] for r in held.join(known, "token").groupBy("token").count().collect()}
    out: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        rarest = min(r.tokens, key=lambda t: (seen.get(t, 0), t)) if r.tokens else ""
        out.setdefault(rarest, []).append(i)
    return out


def best_literal(address: Column, rules: Sequence[Pattern], index: dict[str, list[int]]) -> Column:
    """Number of the best matching rule, from a literal token map."""
    free = F.array(*[F.lit(i) for i in index.get("", [])]).cast("array<int>")
    pairs = [x for t, ids in index.items() if t for x in (F.lit(t), F.array(*[F.lit(i) for i in ids]))]
    filed = free
    if pairs:
        by_token = F.create_map(*pairs)
        known = F.filter(tokens_of(address), lambda t: F.map_contains_key(by_token, t))
        filed = F.concat(free, F.flatten(F.transform(known, lambda t: F.element_at(by_token, t))))
    regexes = F.array(*[F.lit(r.regex) for r in rules])
    ranks = F.array(*[F.lit(r.rank) for r in rules])
    fits = F.filter(filed, lambda i: F.rlike(address, F.element_at(regexes, i + 1)))
    scored = F.transform(fits, lambda i: F.struct(F.element_at(ranks, i + 1).alias("rank"), (-i).alias("i")))
    return -F.array_max(scored)["i"]


def best_joined(addresses: DataFrame, column: str, rules: Sequence[Pattern], index: dict[str, list[int]]) -> DataFrame:
    """(column, rule number, label, action) of distinct addresses that some rule
    fits."""
    spark = addresses.sparkSession
    rows = [(t, i, rules[i].regex, rules[i].rank, rules[i].label, rules[i].action) for t, ids in index.items() for i in ids]
    filed = spark.createDataFrame(rows, "token string, i int, regex string, rank int, label string, action string")
    filed = F.broadcast(filed) if len(rows) <= BROADCAST_RULES else filed
    urls = addresses.select(column).distinct()
    keyed = urls.select(column, F.explode(F.array_append(tokens_of(F.col(column)), F.lit(""))).alias("token"))
    hits = keyed.join(filed, "token").where(F.rlike(F.col(column), F.col("regex")))
    top = F.max(F.struct("rank", (-F.col("i")).alias("i"), "label", "action"))
    return hits.groupBy(column).agg(top.alias("top")).select(column, (-F.col("top.i")).alias("best"), "top.label", "top.action")


def judge(df: DataFrame, rules: Sequence[Pattern], url: str = "url", default: str = "allow", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """Add host, path, rule (label or null) and verdict."""
    host, path, rule, verdict, address, best, fits = tmp_names(df, "host", "path", "rule", "verdict", "address_", "best_", "fits_")
    out = df.withColumn(host, host_of(F.col(url))).withColumn(path, path_of(F.col(url)))
    out = out.withColumn(address, F.concat(host, path))
    index = index_rules(out, address, rules)
    if len(rules) <= literal_rules:
        out = out.withColumn(best, best_literal(F.col(address), rules, index) if rules else F.lit(None).cast("int"))
    else:
        found = best_joined(out, address, rules, index).select(F.col(address).alias(fits), F.col("best").alias(best), "label", "action")
        found = found.withColumnsRenamed({"label": rule, "action": verdict})
        out = out.join(found, F.col(address) == F.col(fits), "left").withColumn(verdict, F.coalesce(verdict, F.lit(default)))
        return out.select(*df.columns, host, path, rule, verdict)
    labels = F.array(*[F.lit(r.label) for r in rules]) if rules else F.array().cast("array<string>")
    actions = F.array(*[F.lit(r.action) for r in rules]) if rules else F.array().cast("array<string>")
    out = out.withColumn(rule, F.get(labels, F.col(best))).withColumn(verdict, F.coalesce(F.get(actions, F.col(best)), F.lit(default)))
    return out.select(*df.columns, host, path, rule, verdict)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = judge(pages, RULES + PATTERNS)
    own = F.array(*[F.lit(r.label) for r in RULES])
    rule = F.when(F.array_contains(own, F.col("rule")), F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '://([^/?#]*)', 1)), '') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT page_id, host, path, CASE
    WHEN regexp_matches(host || path, '^([^/]*\.)?www\.example\.com/en/') THEN 'www.example.com/en/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?example\.com/en/') THEN 'example.com/en/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?net/es/') THEN 'net/es/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?net/fr/') THEN 'net/fr/'
    WHEN regexp_matches(host || path, '^([^/]*\.)?com/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || path, '^([^/]*\.)?ads\.') THEN 'block'
    WHEN regexp_matches(host || path, '/adserver(/|$)') THEN 'block'
    WHEN regexp_matches(host || path, '(^|[./-])casino[./-]') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
