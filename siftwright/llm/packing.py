"""Packing token sequences with minimum bin slack.

Documents become token ids, are cut into full windows and a rest, and the rests
are packed. Packing needs only how many pieces have each length, at most one
row per length up to the window: seeded with the longest piece left, a bitset
subset-sum over the lengths at hand finds the multiset that fills the window
closest to its capacity, backtracking gives its counts, and it is used as often
as the counts allow. Pieces of a length are numbered by salted ranks and look
their place up in the (bounded) list of patterns, so no task or driver holds
more than that.

Null text counts as empty: one piece with the end id. Texts of any length are
tokenized whole. Repeated rows are separate documents. An empty table gives an
empty table.
"""

from __future__ import annotations

import json
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm.common import slots, small_batches, staged, table

WINDOW, END_ID = 2048, 1
#: Bytes of text tokenized at once (a longer text is by itself); bytes of each of
#: a worker's four generations of cached ids; longest word of the fast path and of
#: the caches.
BATCH_BYTES, CACHE_BYTES, LONG_WORD = 8_000_000, 40_000_000, 48
#: Bytes of a cached entry beside its characters and ids.
ENTRY_BYTES = 180
#: Fixed value: how the vocabulary's pre-tokenizer splits lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


class Cache(dict):
    """Results of ``make`` by string, in two generations of bounded bytes: a full
    one becomes the old one, and what is used again comes back from it."""

    def __init__(self, make):
        self.make, self.bytes, self.old = make, 0, {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        size = ENTRY_BYTES + len(key) + len(ids)
        if self.bytes + size > CACHE_BYTES:
            self.old, self.bytes = dict(self), 0
            self.clear()
        self.bytes += size
        self[key] = ids
        return ids


class WordTokenizer:
    """Token ids of white-space separated chunks, as bytes, with a cache.

    No token crosses white space, so a text's ids are its chunks' ids. Chunks of
    Latin-1 characters are split and merged here; all others, and long ones, go
    to the tokenizer library, whose ids these equal.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_alphabet()
        self.inner = [vocab.get(c) for c in letters]
        self.last = [vocab.get(c + "</w>") for c in letters]
        self.plain = len(vocab) < 1 << 16 and None not in self.inner + self.last
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 16 | vocab[b]] = rank << 16 | vocab[a + b]
        self.split = regex.compile(SPLIT)
        self.odd = regex.compile(r"[^\x21-\x7e\xc0-\xff]|<\|")
        self.words, self.others = Cache(self.merged), Cache(self.split_up)

    def word(self, word: str) -> bytes:
        return self.words[word] if len(word) <= LONG_WORD else self.merged(word)

    def merged(self, word: str) -> bytes:
        """The pair of lowest rank is merged, leftmost first; only the ranks
        beside a merge change."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        get, none = self.merges.get, 1 << 60
        ranks = [get(a << 16 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [best & 0xFFFF]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] << 16 | parts[at + 1], none)
            if at:
                ranks[at - 1] = get(parts[at - 1] << 16 | parts[at], none)
        return array("I", parts).tobytes()

    def split_up(self, chunk: str) -> bytes:
        if not self.plain or len(chunk) > LONG_WORD or not chunk.isascii() and self.odd.search(chunk) or "<|" in chunk or not chunk.isprintable():
            return np.array(self.library.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join([self.word(w) for w in self.split.findall(chunk.lower())])

    def chunk(self, chunk: str) -> bytes:
        """A word, or a word and its punctuation, comes from the words; the rest
        is cached as it stands."""
        if len(chunk) > LONG_WORD:
            return self.split_up(chunk)
        if self.plain and chunk.isascii():
            lower = chunk.lower()
            if lower.isalpha():
                return self.words[lower]
            core = lower.rstrip(".,;:!?")
            if core.isalpha():
                return self.words[core] + self.words[lower[len(core) :]]
        return self.others[chunk]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text among them)."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        found = [self.chunk(x) if x else b"" for x in coded.dictionary.to_pylist()]
        size = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
        kind = np.int32 if int(size.sum()) + 40 * len(coded) < 1 << 31 else np.int64
        first = (np.cumsum(size) - size).astype(kind)
        pool = np.frombuffer(b"".join(found), "<u4")
        at = coded.indices.to_numpy(zero_copy_only=False)
        long = size[at] if len(at) else np.zeros(0, np.int64)
        done = np.cumsum(long)
        total = int(done[-1]) if len(done) else 0
        kind = kind if total < 1 << 31 else np.int64
        ids = np.zeros(0, "<u4")
        if total:
            spot = np.repeat(first[at] - (done - long).astype(kind), long)
            spot += np.arange(total, dtype=kind)
            ids = pool[spot]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        ends = np.concatenate([[0], done])[offsets[1:]] if len(offsets) > 1 else np.zeros(0, np.int64)
        return ids, ends


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and vocabulary, kept between tasks."""
    held = sys.modules.setdefault("siftwright_worker_state", types.ModuleType("siftwright_worker_state"))
    made = held.__dict__.setdefault("tokenizers", {})
    if path not in made:
        made[path] = WordTokenizer(path)
    return made[path]


def in_batches(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BATCH_BYTES of text each."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + BATCH_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and
    the end id, cut into windows and a rest."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, pool = tokenizer(vocabulary), pa.default_memory_pool()
        for whole in batches:
            for batch in in_batches(whole, 1):
                pool.release_unused()
                texts = pc.fill_null(batch.column(1), "")
                ids, ends = tok(texts)
                raw, out, begin = memoryview(ids.tobytes()), [], 0
                for row, end in enumerate(ends.tolist()):
                    total = end - begin + 1
                    for start in range(0, total, window):
                        to = min(start + window, total)
                        crc = zlib.crc32(raw[4 * (begin + start) : 4 * min(begin + to, end)])
                        out.append((row, start, to - start, zlib.crc32(tail, crc) if to == total else crc, total))
                    begin = end
                if out:
                    row, *rest = (np.array(x, np.int64) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row)), *map(pa.array, rest)],
                        ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                    )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to ``capacity``: bit s of
    the set says that s can be reached; longer pieces are offered first."""
    reach, steps, mask = 1, [], (1 << capacity + 1) - 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left, times = left - times, times * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> total & 1:
            total -= length * times
            used[length] = used.get(length, 0) + times
    return used


def min_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times, length -> pieces) that use up ``counts``."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        seed = max(left)
        rest = dict(left)
        rest[seed] -= 1
        used = fullest({k: v for k, v in rest.items() if v}, capacity - seed)
        used[seed] = used.get(seed, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((times, used))
    return out


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset to a staged table of pieces."""
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    places: dict[int, list] = {}
    given: dict[int, int] = {}
    sequence = 0
    for times, used in min_bin_slack(counts, window):
        at = 0
        for length in sorted(used, reverse=True):
            places.setdefault(length, []).append((given.get(length, 0), sequence, used[length], at))
            given[length] = given.get(length, 0) + times * used[length]
            at += length * used[length]
        sequence += times
    lookup = {k: np.array(v, np.int64).T for k, v in places.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch.column("length").to_numpy(), batch.column("nth").to_numpy()
            seq, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            order = np.argsort(length, kind="stable")
            for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if not len(mine):
                    continue
                size = int(length[mine[0]])
                begin, first, per, at = lookup[size]
                k = np.searchsorted(begin, nth[mine], "right") - 1
                inside = nth[mine] - begin[k]
                seq[mine], offset[mine] = first[k] + inside // per[k], at[k] + inside % per[k] * size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(seq), pa.array(offset)], [*batch.schema.names[:-1], "sequence_id", "offset"]
            )

    ranked = slots(cut, ["length"], ["doc_id", "start"], "nth")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(assign, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    with small_batches(docs.sparkSession, 4_000):
        cut = staged(pieces(docs, vocabulary or default_vocabulary(), window, id_col, text), "pieces")
    return pack(cut, window)


def op3_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
