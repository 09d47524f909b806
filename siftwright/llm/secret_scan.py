"""Secret scan by patterns and a randomness test battery [native].

Patterns find assignments, access keys and hex strings. Beyond them, every long
token is tested for randomness. Its encoding is inferred from its characters
(hex, base32, base36, base62, base64, base64url, or mixed).

Against "natural text" stand two tests: random strings repeat characters less
often than words do (coincidences, the sum in the chi-squared statistic), and
their classes (upper, lower, digit, other) change more often (runs). Against
"random in its encoding" stand three: chi-squared uniformity over the encoding's
alphabet, the number of runs, and lag-1 serial correlation. Each set's p-values
are joined by Fisher's method.

A token is a secret where "natural" is rejected and "random" is not. Both limits
follow the Benjamini-Hochberg rule within a stratum (encoding and length class),
learnt from a histogram over all tokens of the corpus, whose size is bounded by
the strata and bins: an encoding that prose hardly uses needs less evidence.

Null and empty texts have no spans; repeated rows get equal spans; an empty
table gives an empty table. Texts of any length and number of secrets are read
whole, in nearly linear time. Spans are code points, end exclusive. Added columns
whose names are taken get underscores (``tmp_names`` tells them); the columns of
the table pass through as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import let, table, tmp_names

#: Kinds in their order, and the pattern of each.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"

#: Natural text: chance that two letters are equal, of three, and that the
#: class changes between neighbours.
SAME_TWO, SAME_THREE, CHANGE = 0.066, 0.0064, 0.12
#: Length classes; false discovery rates of "not natural" and of "not random";
#: bins of -ln p and their number.
LENGTHS = (20, 32, 48, 96)
RATE, RATE_RANDOM = 0.002, 0.001
#: Prose hardly writes long words in these encodings: their tokens get more of the
#: rate (Benjamini-Hochberg with weights).
WEIGHTS = {"base32": 5.0, "hex": 5.0}
BIN, BINS = 0.25, 400
ENCODINGS = ("decimal", "hex", "base32", "base36", "base62", "base64", "base64url", "mixed")
#: Items and code points that an append or a cut works on at once.
CHUNK, PAGE = 256, 4_096

SPAN = "array<struct<start:int,end:int,kind:string>>"


def appended(items: Column, start: Column, kind: str, step, finish) -> Column:
    """A fold that appends: ``step(state, item)`` gives the next state and an
    array of ``kind`` to append; ``finish(state, array)`` is the result. Appending
    copies, so it is done in chunks, and chunks are joined at the end."""
    none = F.array().cast(f"array<{kind}>")
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(items, i + 1, F.lit(CHUNK)))

    def add(a: Column, item: Column) -> Column:
        state, out = step(a["state"], item)
        return F.struct(state.alias("state"), F.concat(a["out"], out).alias("out"))

    def add_chunk(a: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(a["state"].alias("state"), none.alias("out")), add)
        return let(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(a["out"], F.array(x["out"])).alias("out")))

    first = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.aggregate(chunks, first, add_chunk, lambda a: finish(a["state"], F.flatten(a["out"])))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, length of ``group``, whole match) of leftmost
    matches.

    ``split`` gives what lies between the matches, so places are running sums
    of lengths.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.zip_with(
        F.slice(F.transform(between, F.length), F.lit(1), F.size(found)),
        found,
        lambda gap, own: F.struct(gap.alias("gap"), own.alias("own")),
    )
    parts = F.zip_with(
        parts, F.transform(inner, F.length),
        lambda p, n: F.struct(p["gap"].alias("gap"), p["own"].alias("own"), n.alias("n")),
    )

    def step(at: Column, p: Column):
        end = at + p["gap"] + F.length(p["own"])
        return end, F.array(F.struct((at + p["gap"]).alias("start"), end.alias("end"), p["n"].alias("n"), p["own"].alias("own")))

    return let(parts, lambda x: appended(x, F.lit(0), "struct<start:int,end:int,n:int,own:string>", step, lambda _, out: out))


def kind_spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Spans of one kind whose group has ``least`` characters or more."""
    found = F.filter(matches(text, pattern, group), lambda m: m["n"] >= least)
    spans = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """A shorter run of an access key or hex string has no longer match inside
    it, so these two state their least length in the pattern."""
    return F.concat(
        kind_spans(text, ASSIGN, "assign", 2, 6),
        kind_spans(text, ACCESS, "access"),
        kind_spans(text, HEX, "hex"),
    )


def tail(z: Column) -> Column:
    """-ln P(Z > z) of a normal variable (Abramowitz-Stegun 26.2.17; beyond 4,
    the asymptotic form)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    inner = -F.ln(F.when(z >= 0, upper).otherwise(1 - upper))
    return F.when(z > 4, z * z / 2 + F.ln(z * math.sqrt(2 * math.pi))).otherwise(inner)


def joint(parts: list[Column]) -> Column:
    """Fisher's method on two or three values of -ln p: the chance of so large
    a sum, as -ln p."""
    total = sum(parts[1:], parts[0])
    series = 1 + total if len(parts) == 2 else 1 + total + total * total / 2
    return F.greatest(total - F.ln(series), F.lit(0.0))


def either(z: Column) -> Column:
    """-ln of the two-sided p-value of z."""
    return F.greatest(tail(F.abs(z)) - math.log(2), F.lit(0.0))


def battery(token: Column) -> Column:
    """Struct of ``score`` (-ln p against natural text), ``misfit`` (-ln p against
    random in its encoding), ``encoding`` and ``n``."""
    body = F.rtrim(F.regexp_replace(token, "=+$", ""))

    def of_body(t: Column) -> Column:
        n = F.length(t).cast("double")
        encoding = (
            F.when(F.rlike(t, F.lit("^[0-9]+$")), F.lit("decimal"))
            .when(F.rlike(t, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), F.lit("hex"))
            .when(F.rlike(t, F.lit("^[A-Z2-7]+$")), F.lit("base32"))
            .when(F.rlike(t, F.lit("^([0-9a-z]+|[0-9A-Z]+)$")), F.lit("base36"))
            .when(F.rlike(t, F.lit("^[0-9A-Za-z]+$")), F.lit("base62"))
            .when(F.rlike(t, F.lit("^[0-9A-Za-z+/]+$")), F.lit("base64"))
            .when(F.rlike(t, F.lit("^[0-9A-Za-z_-]+$")), F.lit("base64url"))
            .otherwise(F.lit("mixed"))
        )
        one_case = F.rlike(t, F.lit("^([a-z]+|[A-Z]+)$"))
        k = (
            F.when(encoding == "hex", 16.0).when(encoding == "decimal", 10.0).when(one_case, 26.0).when(encoding == "base32", 32.0)
            .when(encoding == "base36", 36.0).when(encoding == "base62", 62.0).otherwise(64.0)
        )
        chars = F.array_remove(F.split(t, "", -1), "")
        counts = F.transform(F.array_distinct(chars), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        runs = F.regexp_count(t, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+")).cast("double")
        share = [F.regexp_count(t, F.lit(c)) / n for c in ("[a-z]", "[A-Z]", "[0-9]", "[^a-zA-Z0-9]")]
        codes = F.transform(chars, lambda c: F.ascii(c).cast("double"))
        mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n

        def serial(dev: Column) -> Column:
            own = F.aggregate(dev, F.lit(0.0), lambda a, x: a + x * x)
            lag = F.aggregate(
                F.transform(dev, lambda x, i: x * F.coalesce(F.get(dev, i + 1), F.lit(0.0))), F.lit(0.0), lambda a, x: a + x
            )
            return F.when(own > 0, lag / own).otherwise(1.0)

        lagged = let(let(F.struct(codes.alias("c"), mean.alias("m")), lambda s: F.transform(s["c"], lambda x: x - s["m"])), serial)
        drawn = F.struct(
            n.alias("n"), k.alias("k"), squares.alias("squares"), (runs - 1).alias("changes"), encoding.alias("encoding"),
            one_case.alias("one"), lagged.alias("serial"), (1 - share[0] * share[0] - share[1] * share[1] - share[2] * share[2] - share[3] * share[3]).alias("mix"),
        )
        return let(drawn, verdict)

    def verdict(s: Column) -> Column:
        n, k = s["n"], s["k"]
        pairs = n * (n - 1) / 2
        same = (s["squares"] - n) / 2
        spread = F.sqrt(pairs * SAME_TWO * (1 - SAME_TWO) + n * (n - 1) * (n - 2) * (SAME_THREE - SAME_TWO**2))
        chi = tail((pairs * SAME_TWO - same - 0.5) / spread)
        runs = tail((s["changes"] - 0.5 - (n - 1) * CHANGE) / F.sqrt((n - 1) * CHANGE * (1 - CHANGE)))
        score = F.when(s["one"], chi).otherwise(joint([chi, runs]))
        x2 = (k * s["squares"] / n - n) / (k - 1)
        uniform = tail((F.pow(x2, F.lit(1 / 3)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1))))
        mixed = either((s["changes"] - (n - 1) * s["mix"]) / F.sqrt((n - 1) * s["mix"] * (1 - s["mix"]) + 1e-9))
        lagged = either(s["serial"] * F.sqrt(n))
        misfit = F.when(s["one"], joint([uniform, lagged])).otherwise(joint([uniform, mixed, lagged]))
        return F.struct(
            F.greatest(score, F.lit(0.0)).alias("score"), misfit.alias("misfit"), s["encoding"].alias("encoding"), n.alias("n")
        )

    return let(body, of_body)


def length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, i).otherwise(out)
    return out


def score_bin(score: Column) -> Column:
    return F.least(F.floor(score / BIN), F.lit(BINS)).cast("int")


def stratum(b: Column) -> Column:
    """Number of a tested token's encoding and length class."""
    encodings = F.array(*[F.lit(e) for e in ENCODINGS])
    return ((F.array_position(encodings, b["encoding"]) - 1) * len(LENGTHS) + length_class(b["n"])).cast("int")


def learn(df: DataFrame, text: str = "text", rate: float = RATE, rate_random: float = RATE_RANDOM) -> list[list[float]]:
    """Least score, and least misfit, that count in each stratum, by
    Benjamini-Hochberg over all tokens.

    One aggregation over (test, stratum, bin): the driver gets at most 2 x 32 x
    401 rows. Decimal numbers are never secrets.
    """
    tokens = df.where(F.rlike(F.col(text), F.lit(TOKEN))).select(
        F.explode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("t")
    )
    tested = tokens.select(battery(F.col("t")).alias("b")).select(stratum(F.col("b")).alias("c"), F.posexplode(F.array(score_bin(F.col("b.score")), score_bin(F.col("b.misfit")))))
    rows = tested.groupBy("pos", "c", F.col("col").alias("s")).count().collect()
    bins: dict[tuple, dict] = {}
    for r in rows:
        bins.setdefault((r["pos"], r["c"]), {})[r["s"]] = r["count"]
    out = []
    for test, allowed in enumerate((rate, rate_random)):
        cuts = []
        for c in range(len(ENCODINGS) * len(LENGTHS)):
            mine = bins.get((test, c), {})
            total, above, cut = sum(mine.values()), 0, math.inf
            weight = 1.0 if test else WEIGHTS.get(ENCODINGS[c // len(LENGTHS)], 1.0)
            for s in sorted(mine, reverse=True):
                above += mine[s]
                if total * math.exp(-BIN * s) <= allowed * weight * above:
                    cut = BIN * s
            cuts.append(cut)
        out.append(cuts)
    out[0][: len(LENGTHS)] = [math.inf] * len(LENGTHS)
    return out


def random_spans(text: Column, base: Column, cuts: list[list[float]]) -> Column:
    """Random tokens that touch no base span."""
    found = matches(text, TOKEN)
    least, most = (F.array(*[F.lit(x) for x in side]) for side in cuts)

    def tested(m: Column) -> Column:
        b = battery(m["own"])
        return let(b, lambda x: (F.floor(x["score"] / BIN) * BIN >= F.get(least, stratum(x))) & (F.floor(x["misfit"] / BIN) * BIN < F.get(most, stratum(x))))

    passed = F.transform(F.filter(found, tested), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    none = F.array().cast(SPAN)
    spans = let(passed, lambda t: F.when(F.size(t) == 0, none).otherwise(apart(t, base)))
    return F.when(F.rlike(text, F.lit(TOKEN)), spans).otherwise(none)


def apart(tokens: Column, base: Column) -> Column:
    """Tokens (start, end), as random spans, that touch no base span.

    Both are put in order together and passed twice: going right, the furthest
    end of the base spans so far tells whether one reaches into a token, and
    going left, the nearest start of those after it.
    """

    def pair(spans: Column, of: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(of).alias("of"), s["end"].alias("end")))

    def one_way(tokens: Column, right: bool) -> Column:
        def step(at: Column, e: Column):
            isbase = e["of"] == 0
            clear = (at <= e["start"]) if right else (at >= e["end"])
            reach = F.greatest(at, e["end"]) if right else F.least(at, e["start"])
            own = F.array(F.struct(e["start"].alias("start"), e["end"].alias("end"), F.lit("random").alias("kind")))
            return F.when(isbase, reach).otherwise(at), F.when(~isbase & clear, own).otherwise(F.array().cast(SPAN))

        both = F.sort_array(F.concat(pair(base, 0), pair(tokens, 1)), right)
        begin = F.lit(0 if right else 2**31 - 1)
        return appended(both, begin, "struct<start:int,end:int,kind:string>", step, lambda _, out: out)

    return let(one_way(tokens, True), lambda left: one_way(left, False))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def find(df: DataFrame, text: str = "text", cuts: list[list[float]] | None = None) -> DataFrame:
    """Add ``base_spans`` and ``secret_spans`` (base and random), in order.

    ``cuts`` are the limits by stratum; by default they are learnt from all of
    ``df``.
    """
    cuts = learn(df, text) if cuts is None else cuts
    base, secret, clean = tmp_names(df, "base_spans", "secret_spans", "clean_text_")
    out = df.withColumn(clean, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn(base, in_order(base_spans(F.col(clean))))
    found = F.concat(F.col(base), random_spans(F.col(clean), F.col(base), cuts))
    return out.withColumn(secret, in_order(found)).drop(clean)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch of touching spans replaced by ``mark``. The
    text is cut into pages first, as a place in a long string is found by walking
    to it."""
    pages = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PAGE), F.lit(0))

    def between(held: Column, a: Column, b: Column) -> Column:
        low = F.floor(a / PAGE).cast("int")
        near = F.array_join(F.slice(held, low + 1, F.floor(b / PAGE).cast("int") - low + 1), "")
        return F.substring(near, a - low * PAGE + 1, F.greatest(b - a, F.lit(0)))

    def of_pages(held: Column) -> Column:
        def step(at: Column, s: Column):
            own = F.array(between(held, at, s["start"]), F.lit(mark))
            inside = (s["start"] < at) & (at > 0)
            return F.greatest(at, s["end"]), F.when(inside, F.array().cast("array<string>")).otherwise(own)

        return appended(
            spans, F.lit(0), "string", step,
            lambda at, out: F.concat(F.array_join(out, ""), between(held, at, F.length(text))),
        )

    return F.when(F.size(spans) == 0, text).otherwise(let(pages, of_pages))


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter(F.col("base_spans"), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
