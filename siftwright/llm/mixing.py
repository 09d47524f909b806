"""Mixing sources to target weights by entropy balancing [native].

Targets: sources, in code-point order with null last, weigh by a repeating
list; they share a multiple of all tokens by weight, and what exceeds a
source's cap is reshared by weight until none is above.

Rates: of all document rates that meet a source's token constraint, those
nearest to 1 in relative entropy are exponentially tilted,
``min(cap, exp(lambda_source * x))``, where x is the document's size relative to
its source's mean, to the power ``size_tilt``: where a source must grow, longer
documents are repeated more readily, and where it must shrink, they go first.
The dual is convex in lambda. All sources are solved at once by Newton steps
kept inside brackets; each step is one aggregation of the table of rows per
(source, size), which the cluster counts with a map-side combine, and a source
that has converged takes no part in later steps.

Copies: going down the sizes of a source, running sums of the classes' rates
are rounded, so a source is off by half its longest document at most. While that
is more than ``TOLERANCE`` of a target, whole documents no longer than what is
missing (or too much) are added (or taken off), longest first; this at least
halves the rest each time. Within a class, documents are numbered by salted
ranks, and the first ones take the odd copies.

Null text and empty text have size 0 and are never copied more than their rate
asks. Repeated rows are separate documents; rows equal in id and size may swap
their copies. An empty table gives an empty table. Columns of any name are
carried as they are; ``mix`` is told the name of the column that it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from siftwright.llm.common import slots, staged, table, unstage, words_of

#: The contract's weights, share of all sizes, and cap.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
#: Power of a document's relative size in its feature; share of a target that the
#: dual and the copies may miss it by.
SIZE_TILT, EXACT, TOLERANCE = 0.5, 1e-9, 1e-4
#: Bracket of lambda; a bracket halves where a Newton step leaves it, so the number
#: of steps is bounded by the bits of a double.
LOW, HIGH, MOST_STEPS = -60.0, 60.0, 120


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank``: the place in code-point order, null last. Range partitions
    are numbered apart and lifted by the rows before them, one count for each
    partition; no task sees all sources."""
    parts = max(1, sources.count() // 50_000)
    key = F.col("source").asc_nulls_last()
    rows = sources.repartitionByRange(parts, key).sortWithinPartitions(key)
    rows = staged(rows.withColumn("nth", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("nth", 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("p")).count().collect())
    lift, before = F.lit(0).cast("long"), 0
    for p, n in counts:
        lift = F.when(part == p, F.lit(before)).otherwise(lift) if before else lift
        before += n
    return rows.withColumn("rank", F.col("nth").bitwiseAND(F.lit((1 << 33) - 1)) + lift).drop("nth")


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``target`` to (source, source_size). The level at which sources are
    cut rises until no more are; each round is one aggregation."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked(sources).withColumn("weight", weight).withColumn("most", F.col("source_size") * float(cap))
    level, cut = None, -1
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    while True:
        full = F.lit(False) if level is None else F.col("most") <= F.lit(level) * F.col("weight")
        r = rows.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if r[2] == cut or not r[1]:
            break
        level, cut = (total - (r[0] or 0.0)) / r[1], r[2]
    target = F.col("most") if level is None else F.least("most", F.lit(level) * F.col("weight"))
    return rows.withColumn("target", target.cast("double")).drop("rank", "weight", "most")


def tilted(lam: Column, x: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve_dual(classes: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, lam) of every source; ``classes`` is (source, size, n, x) and
    ``targets`` (source, source_size, target), both staged."""
    # A source at its cap has every rate there, one without tokens or target none.
    full = F.col("target") >= F.col("source_size") * float(cap) * (1 - EXACT)
    none = (F.col("source_size") == 0) | (F.col("target") <= 0)
    state = targets.select(
        "source", "target", F.when(none, -1e6).when(full, 1e6).otherwise(F.ln(F.col("target") / F.col("source_size"))).alias("lam"),
        F.lit(LOW).alias("low"), F.lit(HIGH).alias("high"), (none | full).alias("done"),
    )
    state = staged(state, "duals")
    for _ in range(MOST_STEPS):
        active = state.where("not done").select(F.col("source").alias("of"), "target", "lam", "low", "high")
        if active.isEmpty():
            break
        rate = tilted(F.col("lam"), F.col("x"), cap)
        tokens = F.col("n") * F.col("size") * rate
        on = F.col("source").eqNullSafe(F.col("of"))
        sums = classes.select("source", "size", "n", "x").join(active, on).groupBy("source", "target", "lam", "low", "high").agg(
            F.sum(tokens).alias("g"), F.sum(F.when(rate < cap, tokens * F.col("x")).otherwise(0.0)).alias("h")
        )
        short = F.col("g") < F.col("target")
        moved = sums.withColumns({"low": F.when(short, F.col("lam")).otherwise(F.col("low")), "high": F.when(short, F.col("high")).otherwise(F.col("lam"))})
        newton = F.col("lam") + (F.col("target") - F.col("g")) / F.col("h")
        middle = (F.col("low") + F.col("high")) / 2
        near = F.abs(F.col("g") - F.col("target")) <= EXACT * F.col("target")
        tight = F.col("high") - F.col("low") <= 1e-12
        moved = moved.select(
            "source", "target",
            F.when(near, F.col("lam")).when((F.col("h") > 0) & (newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle).alias("lam"),
            "low", "high", (near | tight).alias("done"),
        )
        used, state = state, staged(state.where("done").unionByName(moved), "duals")
        unstage(used)
    return state.select("source", F.round("lam", 10).alias("lam"))


def rounded(wishes: DataFrame, cap: float = CAP) -> DataFrame:
    """Add ``copies``, whole copies of each class, to (source, size, n, wish,
    target); the classes of a source are a row for each of its sizes."""
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    upto, above = (F.coalesce(F.sum("wish").over(down.rowsBetween(Window.unboundedPreceding, k)), F.lit(0.0)) for k in (0, -1))
    most = F.col("n") * F.lit(int(cap))
    copies = F.least(most, F.greatest(F.lit(0), F.round(upto) - F.round(above))).cast("long")
    at = staged(wishes.withColumn("copies", copies).drop("wish"), "copies")
    for _ in range(64):
        owed = at.groupBy(F.col("source").alias("of"), F.col("target").alias("goal")).agg((F.col("target") - F.sum(F.col("copies") * F.col("size"))).alias("owed"))
        owed = owed.where(F.abs("owed") > TOLERANCE * F.col("goal"))
        room = F.when(F.col("owed") > 0, most - F.col("copies")).otherwise(F.col("copies"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("owed")) & (room > 0)
        open_at = at.join(owed, F.col("source").eqNullSafe(F.col("of"))).withColumn("room", room).where(fits)
        before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        take = F.least(F.col("room"), F.floor((F.abs("owed") - before) / F.col("size")))
        steps = open_at.withColumn("take", take).where("take > 0").select(
            "of", F.col("size").alias("of_size"), (F.signum("owed") * F.col("take")).cast("long").alias("step")
        )
        steps = staged(steps, "steps")
        if steps.isEmpty():
            break
        on = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
        moved = at.join(steps, on, "left").withColumn("copies", F.col("copies") + F.coalesce("step", F.lit(0).cast("long")))
        used, at = at, staged(moved.select("source", "size", "n", "target", "copies"), "copies")
        unstage(used)
        unstage(steps)
    return at


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, size_tilt: float = SIZE_TILT, id_col: str = "doc_id", source: str = "source", text: str = "text", carry: str | None = None) -> DataFrame:
    """(id, source, size, source_size, target, copies) of every document; or, if
    ``carry`` names it, all columns of ``docs`` and the copies under that name."""
    size = F.size(words_of(F.col(text))).cast("long")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"))
    narrow = staged(narrow, "sizes")
    counted = staged(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sources = counted.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    targets = staged(with_targets(sources, weights, share, cap), "targets")
    known = targets.withColumnRenamed("source", "of")
    mean = F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs"))
    x = F.pow(F.greatest(F.col("size") / mean, F.lit(1e-6)), F.lit(float(size_tilt)))
    classes = counted.join(known, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "n", x.alias("x"), "target")
    classes = staged(classes, "features")
    duals = solve_dual(classes, targets, cap).withColumnRenamed("source", "of")
    wish = F.col("n") * tilted(F.col("lam"), F.col("x"), cap)
    wishes = classes.join(duals, F.col("source").eqNullSafe(F.col("of"))).select("source", "size", "n", wish.alias("wish"), "target")
    plan = rounded(wishes, cap).select(F.col("source").alias("of_source"), F.col("size").alias("of_size"), "n", F.col("copies").alias("class_copies"))
    copies = (F.floor(F.col("class_copies") / F.col("n")) + (F.col("nth_") < F.col("class_copies") % F.col("n")).cast("long")).cast("long")
    on = F.col("source").eqNullSafe(F.col("of_source")) & (F.col("size") == F.col("of_size"))
    if carry:
        at = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
        rows = docs.select(at.alias("row_"), F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), size.alias("size"))
        whole = plan.withColumnsRenamed({"of_source": "source", "of_size": "size"})
        numbered = slots(rows, ["source", "size"], ["id"], "nth_", counted=narrow, more=whole)
        return numbered.select(*[F.col("row_")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)], copies.alias(carry))
    plan = plan.join(known, F.col("of_source").eqNullSafe(F.col("of"))).select(*plan.columns, "source_size", "target")
    numbered = slots(narrow, ["source", "size"], ["id"], "nth_")
    return numbered.join(plan, on).select("id", "source", "size", "source_size", "target", copies.alias("copies"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )
