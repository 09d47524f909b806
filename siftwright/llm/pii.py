"""Personal data by patterns and a semi-Markov conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. A
semi-Markov CRF adds what they miss (phone numbers without a plus sign, spelt
addresses, social security numbers): candidate segments of a bounded number of
tokens are scored as a whole (shape, digits, checksum, octets, cues, borders),
and an entity's type is scored against the type of the entity before it on the
line. Dynamic programming over token borders and types chooses boundaries and
types together. Pattern spans are fixed; segments that touch one are no
candidates. No segment crosses a line break, and only lines that hold no
candidate at all are passed over (see ``regions``).

The field is trained here, by gradient steps on the log-likelihood with
forward-backward sums over segmentations, on sentences made by rule from a
seed. Its weights are a small dictionary that goes to the workers with the code.

Null and empty texts have no spans; texts of any length are read whole, in time
linear in their length; repeated rows get equal spans; an empty table gives an
empty table; other columns, whatever their names, are not read. Spans are code
points, end exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import table

#: Base kinds in order; the field may add "ssn" too.
KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "ssn")
#: A digit run cannot match from its inside if it doesn't from its start, so the
#: look-behind only spares the attempt.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

#: Tokens of a segment, of a local part and characters of a token at most; steps.
MAX_TOKENS, LOCAL_TOKENS, LONG_TOKEN, EPOCHS, RATE, SHRINK = 18, 8, 64, 10, 0.3, 1e-3
#: Log-odds that a segment must have over leaving its tokens out.
MARGIN = 1.0
#: Digits of a numeric segment at least and at most, and its runs of digits at most.
LEAST_DIGITS, MOST_DIGITS, MOST_RUNS = 7, 20, 6
#: What every candidate holds: seven digits with no letter or line break between
#: them, an at sign, or the word "dot".
TRIGGER = re.compile(r"(?:[0-9][^0-9A-Za-z\n]*+){7}|@|(?<![^\W\d_])[dD][oO][tT](?![^\W\d_])")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_")
SPELT = re.compile(r"[A-Za-z0-9._%+-]+\W{1,3}at\W{1,3}[A-Za-z0-9-]+(?:\W{1,3}dot\W{1,3}[A-Za-z0-9-]+)+", re.I)
GOES_ON = re.compile(r"\W{1,3}dot\W{1,3}[A-Za-z0-9]", re.I)
DASHES = str.maketrans("\u2010\u2011\u2012\u2013\u2014\u2212", "------")
CUES = {
    **dict.fromkeys("tel telephone phone call mobile cell fax".split(), "phone"),
    **dict.fromkeys("ssn social security".split(), "ssn"),
    **dict.fromkeys("card visa credit".split(), "card"),
    **dict.fromkeys("mail email contact".split(), "email"),
}
ENDINGS = frozenset("com org net edu gov info io de fr es uk".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Each match holds one @, the characters before it as far as they go, and
    the domain after it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def cue_before(text: str, start: int) -> str:
    word = re.search(r"([^\W\d_]+)\W{0,3}\Z", text[max(0, start - 24) : start])
    return CUES.get(word[1].lower(), "none") if word else "none"


def features(text: str, start: int, end: int, cue: str) -> list[str]:
    """Features of a whole segment; each counts once for each type."""
    span = text[start:end].translate(DASHES)
    runs = re.findall("[0-9]+", span)
    digits = "".join(runs)
    shape = re.sub(r"[^\W\d_]+", "a", re.sub("[0-9]+", lambda m: f"d{len(m[0])}", span))[:24]
    out = ["bias", f"digits={len(digits)}", f"shape={shape}", "groups=" + ",".join(str(len(r)) for r in runs), "between=" + "".join(sorted(set(re.sub(r"\w", "", span))))]
    out += ["cue=" + cue, f"cue={cue} shape={shape}", f"cue={cue} digits={len(digits)}"]
    if len(digits) >= 13:
        out.append("luhn" if luhn(digits) else "not-luhn")
    parts = span.split(".")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        out.append("octets" if all(int(p[:4]) <= 255 for p in parts) else "not-octets")
    if "@" in span:
        out.append("at-sign")
    if span[0].isalpha():
        out.append("spelt" if SPELT.fullmatch(span) else "not-spelt")
        out.append("ending" if re.split(r"\W", span)[-1].lower() in ENDINGS else "no-ending")
        if GOES_ON.match(text, end):
            out.append("goes-on")
    if span[0] == "+":
        out.append("plus")
    before, after = text[start - 1 : start].translate(DASHES), text[end : end + 1].translate(DASHES)
    out.append("joined" if (before.isalnum() or after.isalnum() or before in {".", "-", "/", "$"} or after in {"-", "/", "%"}) else "free")
    # A number that goes on behind a blank is a part of a longer one.
    if re.match(r"[ .,][0-9]", text[end : end + 2]) or re.match(r"[0-9][ .,]", text[max(0, start - 2) : start]):
        out.append("number-beside")
    return out


def candidates(text: str, tokens: list[tuple[int, int]], taken) -> list[tuple[int, int]]:
    """(first, last + 1) token of segments that might be an entity: numbers of 7
    to 20 digits in 6 runs at most without letters, words with an at sign, words with "at" and "dot"."""
    out = []
    anchors = [k for k, (x, y) in enumerate(tokens) if (text[x] == "@" or (y - x == 2 and text[x:y].lower() == "at")) and not taken(x, y)]
    p = 0
    for i, (a, _) in enumerate(tokens):
        head = text[a]
        if "0" <= head <= "9" or head in "+(":
            digits = runs = 0
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                x, y = tokens[j]
                piece = text[x : min(y, x + MOST_DIGITS + 1)]
                if piece[0].isalpha() or taken(x, y) or (j > i and "\n" in text[tokens[j - 1][1] : x]):
                    break
                if "0" <= piece[0] <= "9":
                    digits, runs = digits + len(piece), runs + 1
                    if digits > MOST_DIGITS or runs > MOST_RUNS:
                        break
                    if digits >= LEAST_DIGITS and not any(c.isalpha() for c in text[a:y]):
                        out.append((i, j + 1))
        elif anchors and head.isalpha():
            while p < len(anchors) and anchors[p] <= i:
                p += 1
            if p == len(anchors):
                anchors = []
                continue
            if anchors[p] > i + LOCAL_TOKENS:
                continue
            sign = at = dot = False
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                x, y = tokens[j]
                if y - x > LONG_TOKEN or taken(x, y) or (j > i and "\n" in text[tokens[j - 1][1] : x]):
                    break
                piece = text[x:y].lower()
                sign, at, dot = sign or piece == "@", at or piece == "at", dot or piece == "dot"
                if j > i and piece[-1].isalnum() and (sign or (at and dot and piece not in {"at", "dot"})):
                    out.append((i, j + 1))
    return out


def scores(weights: dict, text: str, tokens, found):
    """(first, last + 1, features, score by type) of each candidate."""
    out, cues = [], {}
    for i, j in found:
        start = tokens[i][0]
        if i not in cues:
            cues[i] = cue_before(text, start)
        f = features(text, start, tokens[j - 1][1], cues[i])
        rows = [weights[x] for x in f if x in weights]
        out.append((i, j, f, [sum(c) for c in zip(*rows)] if rows else [0.0] * len(TYPES)))
    return out


#: States of the field: the type of the line's last entity, or none so far.
STATES = (*TYPES, "none")
ALL, FIRST = range(len(TYPES)), len(TYPES)


def follow(weights: dict) -> list[list[float]]:
    """Score of a type (column) after a state (row)."""
    return [weights.get(f"after={s}", [0.0] * len(TYPES)) for s in STATES]


def logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def laid_out(scored):
    """Borders of candidates in order, and candidates by first and last border."""
    points = sorted({p for c in scored for p in c[:2]})
    place = {p: k for k, p in enumerate(points)}
    into: list[list] = [[] for _ in points]
    out_of: list[list] = [[] for _ in points]
    for i, j, _, s in scored:
        into[place[j]].append((place[i], s))
        out_of[place[i]].append((place[j], s))
    return points, place, into, out_of


def sums(scored, after):
    """Forward and backward log-sums over all segmentations: tokens outside
    entities keep the state, an entity sets it to its type."""
    points, place, into, out_of = laid_out(scored)
    n = len(points)
    ahead = [[-math.inf] * len(STATES) for _ in range(n)]
    entered = [[-math.inf] * len(TYPES) for _ in range(n)]
    for k in range(n):
        ahead[k] = ahead[k - 1][:] if k else [-math.inf] * FIRST + [0.0]
        if into[k]:
            for t in ALL:
                ahead[k][t] = logsum([ahead[k][t], *(entered[i][t] + s[t] for i, s in into[k])])
        if out_of[k]:
            entered[k] = [logsum([ahead[k][y] + after[y][t] for y in range(len(STATES))]) for t in ALL]
    back = [[0.0] * len(STATES) for _ in range(n)]
    leaving = [[-math.inf] * len(TYPES) for _ in range(n)]
    for k in range(n - 1, -1, -1):
        back[k] = back[k + 1][:] if k + 1 < n else [0.0] * len(STATES)
        if out_of[k]:
            leaving[k] = [logsum([s[t] + back[j][t] for j, s in out_of[k]]) for t in ALL]
            back[k] = [logsum([back[k][y], *(after[y][t] + leaving[k][t] for t in ALL)]) for y in range(len(STATES))]
    return place, ahead, back, entered, leaving


def best(scored, after, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """Segments and types of the best segmentation; each must be worth ``margin``."""
    if not scored:
        return []
    points, _, into, _ = laid_out(scored)
    top: list[list[float]] = []
    via: list[list] = []
    for k in range(len(points)):
        row = top[k - 1][:] if k else [-math.inf] * FIRST + [0.0]
        came: list = [None] * len(STATES)
        for i, s in into[k]:
            for t in ALL:
                y = max(range(len(STATES)), key=lambda y: top[i][y] + after[y][t])
                value = top[i][y] + after[y][t] + s[t] - margin
                if value > row[t]:
                    row[t], came[t] = value, (i, y)
        top.append(row)
        via.append(came)
    k = len(points) - 1
    y = max(range(len(STATES)), key=lambda y: top[k][y])
    out = []
    while k >= 0:
        if via[k][y] is None:
            k -= 1
        else:
            i, before = via[k][y]
            out.append((points[i], points[k], TYPES[y]))
            k, y = i, before
    return out[::-1]


def examples(seed: int = 7, count: int = 800) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines made by rule, with their entities; half of the numbers are lookalikes.

    Some shapes (ten bare digits, a social security number with blanks) are
    entities behind a cue and lookalikes without one. A second entity is often
    of the first one's type, as in lists."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(rng.randint(2, 9)))
    cues = {kind: sorted(c for c, k in CUES.items() if k == kind) for kind in set(CUES.values())}

    def card() -> str:
        body = d(15)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def bad_card() -> str:
        while luhn(x := d(rng.choice([13, 16, 16, 16, 19]))):
            pass
        return x

    def spelt() -> str:
        at, dot = rng.choice([(" at ", " dot "), (" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]")])
        local = rng.choice([word(), word(), f"{word()}.{word()}", f"{word()}_{word()}", f"{word()}{d(2)}"])
        made = local + at + dot.join(word() for _ in range(rng.choice([1, 1, 2]))) + dot + rng.choice(sorted(ENDINGS))
        return made.upper() if rng.random() < 0.2 else made

    def phone() -> str:
        sep = rng.choice("--./\u2013")
        return rng.choice([f"({d(3)}) {d(3)}{sep}{d(4)}", f"({d(3)}){d(3)}{sep}{d(4)}", *[sep.join([d(3), d(3), d(4)])] * 3, f"1-{d(3)}-{d(3)}-{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(4)} {d(4)}"])

    unclear = {
        "phone": lambda: rng.choice([d(10), "0" + d(10), f"0{d(4)} {d(6)}", f"{d(3)} {d(3)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-{d(4)}"]),
        "ssn": lambda: rng.choice([f"{d(3)} {d(2)} {d(4)}", d(9), f"{d(3)}.{d(2)}.{d(4)}"]),
    }
    makers = {
        "phone": phone,
        "ssn": lambda: rng.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}\u2013{d(2)}\u2013{d(4)}"]),
        "card": card,
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "email": lambda: rng.choice([f"{word()}@{word()}.com", spelt(), spelt()]),
    }
    decoys = [
        bad_card, lambda: d(rng.randint(7, 12)), lambda: f"20{d(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{d(3)},{d(3)}.{d(2)}",
        lambda: f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}9", lambda: f"{d(4)} {d(4)}", lambda: f"{d(2)} {d(3)} {d(4)} {d(2)}",
        lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)}/{d(2)}/{d(4)} {d(2)}:{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"${d(7)}", lambda: f"{word()}@ {word()}", lambda: f"{d(5)}-{d(6)}-{d(3)}",
        lambda: " ".join(d(rng.randint(1, 4)) for _ in range(rng.randint(4, 9))), lambda: f"{word()} at {word()} {word()} dot {word()}", lambda: f"{word()} at {word()} dot {word()}",
        lambda: ", ".join(d(rng.randint(2, 5)) for _ in range(4)), lambda: f"{d(3)}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: unclear[rng.choice(["phone", "ssn"])](), lambda: unclear["phone"](),
    ]
    out = []
    for _ in range(count):
        text, spans, last = " ".join(word() for _ in range(rng.randint(1, 5))), [], None
        for _ in range(rng.randint(1, 3)):
            text += " "
            if rng.random() < 0.5:
                last = last if last and rng.random() < 0.5 else rng.choice(sorted(makers))
                made = makers[last]()
                if last in unclear and rng.random() < 0.4:
                    made, cue = unclear[last](), rng.choice(cues[last])
                    text += (cue.upper() if rng.random() < 0.2 else cue) + rng.choice([" ", ": ", " "])
                elif last in cues and rng.random() < 0.4:
                    text += rng.choice(cues[last]) + rng.choice([" ", ": "])
                spans.append((len(text), len(text) + len(made), last))
            else:
                made = rng.choice(decoys)()
            text += made + rng.choice(["", ".", ","]) + " " + " ".join(word() for _ in range(rng.randint(1, 3)))
        out.append((text, spans))
    return out


@functools.cache
def train(seed: int = 7, epochs: int = EPOCHS) -> dict:
    """Weights by feature, a number for each type, that raise the likelihood of
    the examples' segmentations."""
    rng, weights = random.Random(seed), {f"after={s}": [0.0] * len(TYPES) for s in STATES}
    prepared = []
    for text, spans in examples(seed):
        tokens = [m.span() for m in TOKEN.finditer(text)]
        gold = {(a, b): TYPES.index(k) for a, b, k in spans}
        feats, steps, state = [], [], FIRST
        for i, j, f, _ in scores({}, text, tokens, candidates(text, tokens, lambda a, b: False)):
            kind = gold.get((tokens[i][0], tokens[j - 1][1]))
            feats.append((i, j, f, kind))
            if kind is not None:
                steps.append((state, kind))
                state = kind
            for x in f:
                weights.setdefault(x, [0.0] * len(TYPES))
        if feats:
            prepared.append((feats, steps))
    for epoch in range(epochs):
        rng.shuffle(prepared)
        step = RATE / (1 + 0.3 * epoch)
        for feats, steps in prepared:
            scored = [(i, j, f, [sum(c) for c in zip(*(weights[x] for x in f))]) for i, j, f, _ in feats]
            after = follow(weights)
            place, ahead, back, entered, leaving = sums(scored, after)
            whole = logsum(ahead[-1])
            for y in range(len(STATES)):
                row = weights[f"after={STATES[y]}"]
                gain = [0.0] * len(TYPES)
                for k, values in enumerate(leaving):
                    for t in ALL:
                        gain[t] -= math.exp(ahead[k][y] + after[y][t] + values[t] - whole)
                for state, kind in steps:
                    gain[kind] += state == y
                weights[f"after={STATES[y]}"] = [v + step * (g - SHRINK * v) for v, g in zip(row, gain)]
            for (i, j, f, s), (_, _, _, gold) in zip(scored, feats):
                gains = [(gold == t) - math.exp(entered[place[i]][t] + s[t] + back[place[j]][t] - whole) for t in ALL]
                for t, g in enumerate(gains):
                    if abs(g) > 1e-4:
                        for x in f:
                            row = weights[x]
                            row[t] += step * (g - SHRINK * row[t])
    return {x: [round(v, 4) for v in row] for x, row in weights.items() if max(map(abs, row)) > 0.01}


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Lines that may hold a candidate. Candidates cross no line break and each
    holds a match of TRIGGER, so a line without a match has none."""
    done = -1
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        low = text.rfind("\n", 0, m.start()) + 1
        done = text.find("\n", m.end())
        done = len(text) if done < 0 else done
        yield low, done


def added_spans(text: str, base: list[tuple[str, int, int]], weights: dict) -> list[tuple[str, int, int]]:
    edges = sorted((a, b) for _, a, b in base)
    after = follow(weights)
    out = []
    at = 0
    for low, high in regions(text):
        while at < len(edges) and edges[at][1] <= low:
            at += 1
        near = []
        for k in range(at, len(edges)):
            if edges[k][0] >= high:
                break
            near.append(edges[k])
        covered = set()
        for a, b in near:
            covered.update(range(max(a, low), min(b, high)))
        tokens = [m.span() for m in TOKEN.finditer(text, low, high)]
        found = candidates(text, tokens, lambda a, b: a in covered or b - 1 in covered)
        for i, j, kind in best(scores(weights, text, tokens, found), after):
            out.append((kind, tokens[i][0], tokens[j - 1][1]))
    return out


def find_spans(text: str | None, weights: dict) -> tuple[list, list]:
    """(base spans, all spans), by kind as listed, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    every = base + added_spans(text, base, weights)
    return base, sorted(every, key=lambda s: (TYPES.index(s[0]), s[1], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text", weights: dict | None = None) -> DataFrame:
    """(id, counts of base kinds, base_sha256, spans, n_added) of every row."""
    weights = train() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in FOUND.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in FOUND.split(", ")]
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                base, every = find_spans(value.as_py(), weights)
                count = [sum(k == kind for k, _, _ in base) for kind in KINDS]
                rows.append((key, *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, FOUND)


def op2_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumnRenamed("id", "doc_id")
