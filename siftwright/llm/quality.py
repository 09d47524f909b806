"""Quality rules as a short-circuit cascade [native].

Every rule is a boolean over a few text statistics. A sample gives each rule's
cost and selectivity (the share it rejects); rules are ordered by rejection per
cost, and the ordered list becomes one CASE expression, so a row pays only for
the rules up to the first that rejects it.

The sample is taken by a hash of the row's place over all partitions, about
``SAMPLE_ROWS`` rows of the text column only. A rule's cost is that of the
statistics it looks at, each so many nanoseconds a word and a character
(``COSTS``, measured once), over the sample's mean words and characters: timing
the rules anew in every run gave another order from run to run on a busy machine.

Null text counts as empty text and fails ``too_few_words``. Rows are judged one
by one: repeated rows get equal verdicts, an empty table gives an empty table.
Added columns whose names are taken get underscores (``tmp_names`` tells them);
the columns of ``df`` pass through as they are. ``rejected_by`` depends on the
measured order where several rules reject a row; ``kept`` does not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import SPACES, let, table, tmp_names, words_of

#: Rows, about, of the sample on which cost and selectivity are estimated (twice as
#: many at most).
SAMPLE_ROWS = 512

@dataclass(frozen=True)
class Parts:
    """A text without nulls and its words, as columns."""

    text: Column
    words: Column


def n_words(p: Parts) -> Column:
    return F.size(p.words).cast("long")


def word_chars(p: Parts) -> Column:
    """Code points in words."""
    return F.length(F.array_join(p.words, "")).cast("long")


def n_symbols(p: Parts) -> Column:
    return F.regexp_count(p.text, F.lit("[#*$%&|<>]")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")


def n_lines(p: Parts) -> Column:
    return F.size(worded_lines(p.text)).cast("long")


def n_dup_lines(p: Parts) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(
        worded_lines(p.text),
        lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    )


def n_distinct(p: Parts) -> Column:
    """Different words."""
    return F.size(F.array_distinct(p.words)).cast("long")


def n_letters(p: Parts) -> Column:
    return F.length(F.regexp_replace(p.text, r"\P{L}+", "")).cast("long")


def n_repeat_words(p: Parts) -> Column:
    """Words in 3-word windows that occur twice or more in the text.

    Texts whose windows have different 64-bit hashes are done; else the hashes
    are sorted with their places, equal neighbours give the repeated places, and
    a place covers the words up to the next one, three at most. Words are compared
    where hashes are equal; should they differ, the text's windows are sorted by
    their words too. Linear but for the sort, whatever repeats.
    """
    zero = F.lit(0).cast("long")

    def window(words: Column, i: Column) -> list[Column]:
        return [F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c")]

    def hashes(words: Column) -> Column:
        return F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda x, i: F.xxhash64(*window(words, i)))

    def twins(rows: Column) -> Column:
        """Rows (w, i), sorted, whose w equals a neighbour's."""

        def same(i: Column, j: Column) -> Column:
            return F.get(rows, i)["w"] == F.get(rows, j)["w"]

        return F.filter(
            rows,
            lambda x, i: F.coalesce(same(i, i + 1), F.lit(False))
            | ((i > 0) & F.coalesce(same(i, F.greatest(i - 1, F.lit(0))), F.lit(False))),
        )

    def places(rows: Column) -> Column:
        return F.array_sort(F.transform(rows, lambda x: x["i"]))

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda x, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - x, F.lit(3))),
        )
        return F.aggregate(steps, zero, lambda a, x: a + x)

    def collided(words: Column, rows: Column) -> Column:
        """Whether neighbours of equal hashes differ in their words."""

        def differ(x: Column, i: Column) -> Column:
            near = F.get(rows, i + 1)
            unlike = F.lit(False)
            for k in range(3):
                unlike = unlike | (F.get(words, x["i"] + k) != F.get(words, near["i"] + k))
            return F.when(F.coalesce(x["w"] == near["w"], F.lit(False)), unlike).otherwise(F.lit(False))

        return F.size(F.filter(rows, differ)) > 0

    def by_words(words: Column) -> Column:
        rows = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda x, i: F.struct(F.struct(*window(words, i)).alias("w"), i.alias("i")))
        return let(let(let(F.sort_array(rows), twins), places), covered)

    def of_hashes(words: Column, hs: Column) -> Column:
        rows = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("w"), i.alias("i"))))
        some = let(let(rows, twins), lambda r: F.when(collided(words, r), by_words(words)).otherwise(let(places(r), covered)))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), zero).otherwise(some)

    return F.when(F.size(p.words) < 4, zero).otherwise(let(p.words, lambda w: let(hashes(w), lambda hs: of_hashes(w, hs))))


#: Statistics by name; each is a function of a text's parts.
STATISTICS: dict[str, Callable[[Parts], Column]] = {
    "n_words": n_words,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_distinct": n_distinct,
    "n_letters": n_letters,
}


#: Nanoseconds a word and a character of each statistic, in round figures, beside
#: splitting the words, which all rules share.
COSTS = {
    "n_words": (1, 0), "word_chars": (100, 1), "n_symbols": (0, 10), "n_lines": (0, 4), "n_dup_lines": (0, 5), "n_repeat_words": (2000, 0),
    "n_distinct": (50, 0), "n_letters": (20, 10),
}


@dataclass(frozen=True)
class Rule:
    """``fails`` gets a lookup from statistic name to column."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


BASE_RULES = (
    Rule("too_few_words", lambda s: s("n_words") < 50),
    Rule("repeated_windows", lambda s: 100 * s("n_repeat_words") > 50 * s("n_words")),
)
#: Beyond the base rules, only gross defects, so that clean documents stay.
METHOD_RULES = (
    Rule("mostly_symbols", lambda s: s("n_symbols") > s("n_words")),
    Rule("odd_word_length", lambda s: (s("word_chars") < 2 * s("n_words")) | (s("word_chars") > 20 * s("n_words"))),
    Rule("repeated_lines", lambda s: 2 * s("n_dup_lines") > s("n_lines")),
    Rule("few_different_words", lambda s: s("n_distinct") < 8),
    Rule("few_letters", lambda s: 10 * s("n_letters") < s("word_chars")),
)
RULES = BASE_RULES + METHOD_RULES


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejects: float


def sampled(df: DataFrame, text: str, sample_rows: int) -> DataFrame:
    """Texts of about ``sample_rows`` rows of all partitions, twice as many at
    most, in one partition."""
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    bound = min(1 << 30, -(-sample_rows * (1 << 30) // max(1, df.count())))
    return df.select(F.coalesce(F.col(text), F.lit("")).alias("t")).where(place < bound).limit(2 * sample_rows).repartition(1)


def looked_at(rule: Rule) -> set[str]:
    """Statistics that a rule asks for."""
    seen: set[str] = set()

    def lookup(name: str) -> Column:
        seen.add(name)
        return F.lit(0).cast("long")

    rule.fails(lookup)
    return seen


def estimate(df: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """Nanoseconds a row and rejected share of each rule on a sample, by one
    aggregation."""
    sample = sampled(df, text, sample_rows).withColumn("w", words_of(F.col("t")))
    parts = Parts(F.col("t"), F.col("w"))
    bad = [F.coalesce(r.fails(lambda s: STATISTICS[s](parts)), F.lit(False)) for r in rules]
    row = sample.agg(F.count("*"), F.avg(F.size("w")), F.avg(F.length("t")), *[F.count_if(b) for b in bad]).first()
    rows, words, chars = row[0], row[1] or 0.0, row[2] or 0.0
    out = []
    for rule, n in zip(rules, row[3:]):
        costs = [COSTS[s] for s in sorted(looked_at(rule))]
        out.append(Estimate(rule.name, 1 + sum(w * words + c * chars for w, c in costs), (n + 0.5) / (rows + 1)))
    return out


def ordered(rules, estimates: list[Estimate]) -> list[Rule]:
    """By rejection per cost, highest first; ties by name. Shares are smoothed,
    so among rules that reject nothing in the sample, cheap ones come first."""
    worth = {e.name: e.rejects / e.cost for e in estimates}
    return sorted(rules, key=lambda r: (-worth.get(r.name, 0.0), r.name))


def cascade(rules, stat: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, else null."""
    out = None
    for rule in rules:
        bad = F.coalesce(rule.fails(stat), F.lit(False))
        out = F.when(bad, rule.name) if out is None else out.when(bad, rule.name)
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def judge(df: DataFrame, rules=RULES, text: str = "text", statistics: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``rejected_by`` and ``kept``; and ``statistics``, where asked for.

    Statistics that are asked for are computed for all rows and shared with the
    rules; the others are computed only where the cascade reaches their rule.
    """
    order = ordered(rules, estimate(df, rules, text, sample_rows))
    wanted = (*statistics, "rejected_by", "kept")
    name = dict(zip(wanted, tmp_names(df, *wanted)))

    def of_parts(body) -> Column:
        """``body`` of a row's parts, in one expression: the optimizer may move
        it, into a filter for one, but never computes the words twice."""
        clean = F.coalesce(F.col(text), F.lit(""))
        return let(clean, lambda t: let(words_of(t), lambda w: body(Parts(t, w))))

    if not statistics:
        verdict = of_parts(lambda p: cascade(order, lambda s: STATISTICS[s](p)))
        return df.withColumn(name["rejected_by"], verdict).withColumn(name["kept"], F.col(name["rejected_by"]).isNull())

    def judged(p: Parts, known: Column) -> Column:
        return cascade(order, lambda s: known[s] if s in statistics else STATISTICS[s](p))

    verdict = of_parts(
        lambda p: let(
            F.struct(*[STATISTICS[s](p).alias(s) for s in statistics]),
            lambda k: F.struct(*[k[s].alias(s) for s in statistics], judged(p, k).alias("rejected_by")),
        )
    )
    (held,) = tmp_names(df.withColumns({n: F.lit(0) for n in name.values()}), "statistics_")
    out = df.withColumn(held, verdict)
    out = out.withColumns({name[s]: F.col(held)[s] for s in (*statistics, "rejected_by")})
    return out.withColumn(name["kept"], F.col(name["rejected_by"]).isNull()).drop(held)


#: The contract's statistics; those of the method's own rules are computed only
#: where the cascade reaches them.
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, statistics=CONTRACT)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), "kept",
    )


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, t, ws, ls, CAST(len(ws) AS BIGINT) AS n_words FROM w),
p AS (SELECT doc_id, n_words, ws, unnest(range(1, n_words - 1)) AS i FROM g WHERE n_words >= 4),
q AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM q),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM c WHERE n > 1) x GROUP BY doc_id),
s AS (SELECT g.doc_id, n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_distinct(ws)) AS n_distinct,
             length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters
      FROM g LEFT JOIN r ON g.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_dup_lines > n_lines
            OR n_distinct < 8 OR 10 * n_letters < word_chars) AS kept
FROM s
"""
