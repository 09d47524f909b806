"""Repair of conversation structure by cost layers of reachable grammar states.

A well-formed conversation's role initials read ``(s?(ua)+)?``. The grammar has
four states (at the start, after s, u, a), a layer is the bitset of the states
from which the turns to come can be brought to an accepting end at no more than
its cost, and a turn's layers are those of increasing cost: each follows from
the layers of the turn after it by shifts of an edit's cost (keep, rerole,
delete) and from its own cheaper ones by an insert. The first layer with the
starting state gives the conversation's cost, and walking the bits forward,
the least edit first that keeps to the remaining cost, gives the least audit.
States differ by a few units of cost at most, so a turn's layers are a base
cost and ``LAYERS`` bitsets: a conversation takes time and memory in proportion
to its turns. Layers repeat, so they are looked up.

Texts never meet in one task. Rows carry a code (initial and fault); codes are
put in order within ranges of the sorted rows (so a long conversation is sorted
in many tasks), and a conversation's codes are one byte a turn, as long as the
audit that is returned anyway. Edits go back to rows by their number. The hash
of the repaired text takes its lines one after another, as SHA-256 is a chain:
rows stream through it sorted by conversation and turn, whose memory doesn't
depend on a conversation's length.

Nulls count as one space (a null conv_id is a conversation of its own; its key
too has one space), null turns come first, and equal turns are ordered by role,
then by the first 16 characters and the hash of the text; equal rows in any
order. Roles other than user and assistant can't be inserted; initials other
than s, u and a are never legal. Empty tables give no rows. Columns other than
the four named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import small_batches, staged, table, unstage
from siftwright.llm.numbering import dealt

START, S, U, A = 1, 2, 4, 8
#: Where an initial leads from each state, and the role that an edit may give there.
STEP = {"s": {START: S}, "u": {START: U, S: U, A: U}, "a": {U: A}}
NEXT = {START: U, S: U, U: A, A: U}
ROLE = {U: "user", A: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Costs that layers span: no state is further from the cheapest one.
LAYERS = 12
#: Codes of turns: 4 x initial + fault.
INITIALS, FAULTS = "sua?", ("none", "blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")


def before(states: int, arc: dict[int, int]) -> int:
    """States from which the arc leads into ``states``."""
    return sum(s for s, t in arc.items() if t & states)


@lru_cache(maxsize=100_000)
def layers_before(after: tuple[int, ...], code: int) -> tuple[int, tuple[int, ...]]:
    """(cost by which the base grows, layers) of a turn, from those of the next."""
    initial, fault = INITIALS[code >> 2], FAULTS[code & 3]
    extra = TRUNCATED if fault == "truncated" else 0
    keeps = fault not in ("blank", "duplicate")
    out: list[int] = []
    for cost in range(LAYERS + DELETE):

        def at(c: int) -> int:
            return 0 if c < 0 else after[min(c, LAYERS - 1)]

        states = at(cost - DELETE) | (out[-1] if out else 0)
        if keeps:
            states |= before(at(cost - extra), STEP.get(initial, {})) | before(at(cost - REROLE - extra), NEXT)
        if cost >= INSERT:
            states |= before(out[cost - INSERT], NEXT)
        out.append(states)
    base = next(k for k, x in enumerate(out) if x)
    out = out[base:] + [out[-1]] * base
    return base, tuple(out[:LAYERS])


def end_layers() -> tuple[int, ...]:
    """After the last turn: only inserts are left."""
    out: list[int] = []
    for cost in range(LAYERS):
        out.append(START | A | (before(out[cost - INSERT], NEXT) | out[-1] if cost >= INSERT else 0))
    return tuple(out)


def repair(codes: bytes) -> tuple[int, list[str]]:
    """(cost, edits by turn): the edits of a turn are inserts before it and its
    own edit; the last entry holds inserts at the end."""
    found = [(0, end_layers())]
    for code in reversed(codes):
        base, layers = found[-1]
        grown, layers = layers_before(layers, code)
        found.append((base + grown, layers))
    found.reverse()

    def within(i: int, states: int, cost: int) -> bool:
        base, layers = found[i]
        return cost >= base and bool(layers[min(cost - base, LAYERS - 1)] & states)

    total = found[0][0]
    while not within(0, START, total):
        total += 1
    at, left, out, mine = START, total, [], ""
    i, n = 0, len(codes)
    while i < n or left > 0:
        if i < n and within(i + 1, at, left - DELETE):
            mine, left, i = mine + "D", left - DELETE, i + 1
        elif within(i, NEXT[at], left - INSERT):
            mine, left, at = mine + "I", left - INSERT, NEXT[at]
            continue
        else:
            initial, extra = INITIALS[codes[i] >> 2], TRUNCATED if codes[i] & 3 == 3 else 0
            to = STEP.get(initial, {}).get(at)
            if to and within(i + 1, to, left - extra):
                mine, left, at, i = mine + "K", left - extra, to, i + 1
            else:
                mine, left, at, i = mine + "R", left - REROLE - extra, NEXT[at], i + 1
        out.append(mine)
        mine = ""
    return total, [*out, mine]


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations as the contract damages them, nulls as a space."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1)))
    return rows.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def coded(rows: DataFrame) -> DataFrame:
    """Narrow rows (conv_id, turn, role, head, digest, row, code) of a staged
    table with a ``row`` number: what is blank, seen earlier or cut off."""
    digest = F.md5("text")
    narrow = rows.select("conv_id", "turn", "role", F.substring("text", 1, 16).alias("head"), digest.alias("digest"), "row", *_marks())
    order = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "row")
    first = narrow.groupBy(F.col("conv_id").alias("c_"), F.col("role").alias("r_"), F.col("digest").alias("d_")).agg(F.min(order).alias("first_"))
    on = F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("role") == F.col("r_")) & (F.col("digest") == F.col("d_"))
    both = narrow.join(first, on)
    fault = F.when(F.col("blank"), 1).when(F.col("first_.row") != F.col("row"), 2).when(F.col("truncated"), 3).otherwise(0)
    initial = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    return both.select("conv_id", "turn", "role", "head", "digest", "row", (initial * 4 + fault).cast("int").alias("code"))


def _marks() -> list[Column]:
    trimmed = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    return [(trimmed == "").alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated")]


def turns(rows: DataFrame) -> DataFrame:
    """A staged table of the rows with a number each."""
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "turns", "zstd")


def repaired(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For ``turns``: a row per conversation (conv_id, blank, duplicate,
    truncated, illegal, cost, audit), and the repaired lines (conv_id, part, nth,
    lines), in order of part and nth, each ended by a line feed."""
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("head"), F.col("digest"), F.col("row")]
    ranges = dealt(coded(numbered), order, "part", 20_000)
    # The rows of a conversation in one range, in order: as many as a range has.
    turn = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "role", "head", "digest", "row", "code")
    blocks = ranges.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    blocks = staged(blocks.select("conv_id", "part", F.col("turns.row").alias("rows"), F.col("turns.code").alias("codes")), "blocks")
    code = F.array_join(F.transform("codes", lambda c: F.chr(c + 65)), "")  # a byte a turn
    whole = blocks.select("conv_id", "part", code.alias("codes")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "codes"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "pieces")}
            for conv, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                codes = bytes(ord(c) - 65 for p in parts for c in p["codes"])
                cost, edits = repair(codes)
                initials = [INITIALS[c >> 2] for c in codes]
                out["conv_id"].append(conv)
                for k, fault in enumerate(FAULTS[1:], 1):
                    out[fault].append(sum(c & 3 == k for c in codes))
                out["illegal"].append(sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])))
                out["cost"].append(cost)
                out["audit"].append("".join(edits))
                pieces, at, state = [], 0, START
                for p in parts:
                    to = at + len(p["codes"])
                    mine = edits[at:to] + ([edits[-1]] if to == len(codes) else [])
                    pieces.append({"part": p["part"], "state": state, "edits": ",".join(mine)})
                    for c, e in zip(codes[at:to], edits[at:to]):
                        state = after(state, e, c)
                    at = to
                out["pieces"].append(pieces)
            kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("part", pa.int64()), ("state", pa.int64()), ("edits", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], [*out])

    schema = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, pieces array<struct<part:long,state:long,edits:string>>"
    solved = staged(whole.mapInArrow(run, schema), "audits")
    pieces = solved.select(F.col("conv_id").alias("c_"), F.explode("pieces").alias("p")).select("c_", F.col("p.part").alias("p_"), "p.state", "p.edits")
    placed = blocks.join(pieces, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("part") == F.col("p_"))).select("conv_id", "part", "rows", "codes", "state", "edits")
    with_edits = placed.mapInArrow(_lines, "conv_id long, part long, nth long, row long, before string, role string, keep boolean")
    texts = numbered.select(F.col("row").alias("row_"), F.col("role").alias("role_"), "text")
    line = F.concat(F.col("before"), F.when(F.col("keep"), F.concat(F.coalesce("role", "role_"), F.lit(":"), F.coalesce("text", F.lit("")), F.lit("\n"))).otherwise(""))
    lines = with_edits.join(texts, F.col("row") == F.col("row_"), "left").select("conv_id", "part", "nth", line.alias("lines")).where("lines <> ''")
    return solved.drop("pieces"), lines


def after(state: int, edits: str, code: int) -> int:
    """The state after a turn's edits."""
    for e in edits:
        if e in "IR":
            state = NEXT[state]
        elif e == "K":
            state = STEP[INITIALS[code >> 2]][state]
    return state


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn of a block that yields lines: inserted lines before it,
    its new role (null: its own), whether it stays; inserts at the end have no row."""
    for batch in batches:
        out: list[tuple] = []
        for conv, part, rows, codes, state, edits in zip(*(c.to_pylist() for c in batch.columns)):
            for nth, e in enumerate(edits.split(",")):
                own, inserted, role = e.rstrip("I") and e[-1], "", None
                for _ in range(e.count("I")):
                    state = NEXT[state]
                    inserted += ROLE[state] + ":\n"
                if own in ("R", "K"):
                    state = after(state, own, codes[nth])
                    role = ROLE[state] if own == "R" else None
                if inserted or own in ("R", "K"):
                    out.append((conv, part, nth, rows[nth] if nth < len(rows) else None, inserted, role, own in ("R", "K")))
        if out:
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["conv_id", "part", "nth", "row", "before", "role", "keep"])


def chained(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the hash of each conversation's lines, read in
    order; only the hash is kept from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, h, last = none, None, b""
        for batch in batches:
            out = []
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if now is none or conv != now:
                    if now is not none:
                        h.update(last[:-1])
                        out.append((now, h.hexdigest()))
                    now, h, last = conv, hashlib.sha256(), b""
                h.update(last)
                last = text.encode()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out])], ["conv_id", "repaired_sha256"])
        if now is not none:
            h.update(last[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "nth")
    return rows.select("conv_id", "lines").mapInArrow(run, "conv_id long, repaired_sha256 string")


def digest(rows: DataFrame) -> DataFrame:
    """A row per original conversation of ``rows`` (conv_id, turn, role, text)."""
    bad = turns(damage(rows))
    found, lines = repaired(bad)
    gap = (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long")
    gaps = staged(bad.where("turn is not null").groupBy(F.col("conv_id").alias("g_")).agg(gap.alias("gaps")), "gaps")
    with small_batches(rows.sparkSession):
        hashes = staged(chained(lines).withColumnRenamed("conv_id", "h_"), "hashes")
    unstage(bad)
    both = rows.select("conv_id").distinct()
    for part, name in ((found.withColumnRenamed("conv_id", "f_"), "f_"), (gaps, "g_"), (hashes, "h_")):
        both = both.join(part, F.col("conv_id").eqNullSafe(F.col(name)), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.lit(hashlib.sha256().hexdigest())
    return both.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
