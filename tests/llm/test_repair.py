"""Conversation repair against brute force."""

import hashlib
import random
import zlib
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwright.llm import queries, repair
from tests.conftest import SMALL

SPACES = " \t\n\x0b\x0c\r"
LEADS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def cheapest(turns):
    """Least (cost, audit) by trying every edit, with up to four inserts in a gap."""
    n = len(turns)

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == n and state in ("", "a") else []
        if inserted < 4:
            to = "a" if state == "u" else "u"
            c, rest = best(i, to, inserted + 1)
            found.append((c + 2, "I" + rest))
        if i < n:
            initial, fault = turns[i]
            c, rest = best(i + 1, state, 0)
            found.append((c + 3, "D" + rest))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if initial in LEADS[state]:
                    c, rest = best(i + 1, LEADS[state][initial], 0)
                    found.append((c + extra, "K" + rest))
                c, rest = best(i + 1, "a" if state == "u" else "u", 0)
                found.append((c + 2 + extra, "R" + rest))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


def applied(rows, audit):
    out, state, i = [], "", 0
    for e in audit:
        role = "assistant" if state == "u" else "user"
        if e == "D":
            i += 1
            continue
        if e == "I":
            out.append(role + ":")
        elif e == "R":
            out.append(f"{role}:{rows[i][1]}")
        else:
            role = rows[i][0]
            out.append(f"{role}:{rows[i][1]}")
        i += e in "KR"
        state = role[0]
    assert i == len(rows)
    return out


def brute(rows):
    """Digest rows of (conv_id, turn, role, text) rows."""
    def spaced(x):
        return " " if x is None else str(x)

    after = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        after[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, mine in after.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:16], hashlib.md5(r[2].encode()).hexdigest()))
        seen, turns, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in mine:
            core = text.strip(SPACES)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "none"
            seen.add((role, text))
            if fault in count:
                count[fault] += 1
            turns.append((role[:1], fault))
        cost, audit = cheapest(tuple(turns))
        given_ = [t for t, *_ in mine if t is not None]
        gaps = max(given_) - min(given_) + 1 - len(set(given_)) if given_ else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        lines = applied([r[1:] for r in mine], audit)
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


CODES = st.lists(st.integers(0, 15), max_size=14)


@settings(max_examples=600, deadline=None)
@given(CODES)
def test_layers_give_the_least_cost_and_audit(codes):
    cost, edits = repair.repair(bytes(codes))
    assert (cost, "".join(edits)) == cheapest(tuple((repair.INITIALS[c >> 2], repair.FAULTS[c & 3]) for c in codes))
    assert len(edits) == len(codes) + 1


def test_layers_span_all_states():
    """What lies beyond the last layer is in it: every state gets to the end within them."""
    seen, todo = set(), [repair.end_layers()]
    while todo:
        layers = todo.pop()
        assert layers[-1] == repair.START | repair.S | repair.U | repair.A and layers[-1] == layers[-2]
        for code in range(16):
            nxt = repair.layers_before(layers, code)[1]
            if nxt not in seen:
                seen.add(nxt)
                todo.append(nxt)
    assert len(seen) < 1000


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.QUERIES["op11_conversation_repair"](spark, SMALL).collect(), brute(rows))


def odd_rows():
    rng = random.Random(5)
    texts = ["Hello there.", "No end", "", " \n", None, "Same.", "Same.", "x" * 3000 + "!", "a:b\nc?\n", "Ünï 日本."]
    roles = ["system", "user", "assistant", "tool", None, "", "Stranger"]
    rows = [(c, None if rng.random() < 0.1 else rng.randrange(12), rng.choice(roles[: 3 if c % 2 else 7]), rng.choice(texts)) for c in range(120) for _ in range(rng.randrange(1, 10))]
    return rows + [(None, t, "user", "Null id.") for t in (None, 0, 0, 1)] + rows[:9] + [(500, None, None, None)]


def test_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, row string")
    same(repair.digest(df.select("conv_id", "turn", "role", "text")).collect(), brute(rows))


def test_one_conversation_over_many_ranges(spark):
    """A conversation that holds most rows is put in order in several tasks."""
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"text {t % 90}.") for t in range(100)] + [(8, t, "user", "Hi.") for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    bad = repair.turns(repair.damage(df))
    assert repair.dealt(repair.coded(bad), [F.col("turn"), F.col("row")], "part", 30).select("part").distinct().count() > 2
    same(repair.digest(df).collect(), brute(rows))


def test_empty_table(spark):
    assert repair.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
