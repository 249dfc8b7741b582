"""Packing documents into windows of fixed length with a controlled mixture of sources.

Deficit round-robin: in every round, which fills one window, each source queue is credited with its
target share of the window, takes whole tokens from its queue as far as its credit goes, and carries
what is left (its deficit, less than a token) to the next round. Taken over x tokens of all queues,
the queues up to the j-th have been served floor(x * P_j) tokens, P_j being their summed shares; so
the state of any round follows from its number alone, every partition starts with the deficits that
the round before it left, and no token has to move to another task.

A source whose share of a window is less than a few tokens would lie in the windows as single tokens.
Such sources are served in a second tier: a queue of the first that is filled by deficit round-robin
itself, in rounds long enough for every source of it to have a few tokens, and so on. A small source
thus carries its deficit over several windows and is in proportion over each round of its tier.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, commonest, map_arrow, small_join

WINDOW = 1024
#: Tokens that a source has in a round of its tier, at least, and how many times as many the largest source of a tier may have.
LEAST, RANGE = 4, 16
#: Sources with queues of their own; if there are more, the smallest stand in one, in the order of their files. With targets, at most TARGETS.
MOST_SOURCES, TARGETS = 100_000, 1_000
#: Bytes of text that are encoded at once, each row counted with ROW more; a longer text alone.
CHUNK, ROW = 1 << 24, 64
NONE = "\0none"
TOKENS = "doc_id long, source string, part int, before long, doc_tokens long, ids binary"
TOKENS_ARROW = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("before", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
PIECES_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("source", pa.string())])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: How the byte-level BPE file cuts texts into words, and the printable stand-ins of its bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Up to this code point both libraries have the same letters, numbers and white space.
LATIN = "\u024f"


def _stand_ins() -> dict[str, int]:
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Tokens as bytes with their ids, if the ids of the file at path are also the order of its merges."""
    model = json.loads(Path(path).read_text())["model"]
    vocabulary, stand_in = model["vocab"], _stand_ins()
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    order = [vocabulary.get(t, -1) for t in merged]
    if model.get("ignore_merges") or any(a >= b for a, b in zip(order, order[1:])) or order and order[0] < 0:
        return None
    known = set(merged) | set(stand_in)
    ranks = {bytes(stand_in[c] for c in t): i for t, i in vocabulary.items() if t in known}
    return ranks if len(ranks) == len(known) else None


class Encoder:
    """Ids of texts as little-endian bytes, by a byte-level BPE file of the tokenizers library.

    The pattern that cuts texts into words puts a single space at the start of the word after it, so
    texts are cut there and a word is encoded once as long as it is remembered; where white space
    stands next to the space the whole text is encoded. Latin text is encoded by tiktoken from the
    same vocabulary, which gives the same ids in less time; everything else, and texts with a special
    token of the file, by tokenizers.

    All texts of a batch are cut, their words looked up and the ids put together by Arrow; the words
    that are not remembered are encoded as one text, whose ids are cut by the bytes they stand for.
    """

    #: Bytes of the words remembered; beyond them all are forgotten.
    MOST = 1 << 25

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.fast = None
        if ranks := merge_ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("from-file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, i in ranks.items():
                self.size[i] = len(token)
        self._forget()

    def _forget(self):
        # a word has no ids if it cannot be encoded apart from its text
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def exact(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def whole(self, text: str) -> bytes:
        if self.fast and (text.isascii() or max(text) <= LATIN):
            return self.fast(text).astype(self.kind).tobytes()
        return self.exact(text)

    def _encode(self, words: pa.Array) -> pa.Array:
        """Ids of words that follow a space; null for one that is empty or has white space at an end."""
        length = pc.binary_length(words)
        apart = pc.and_(pc.greater(length, 0), pc.equal(pc.binary_length(pc.utf8_trim_whitespace(words)), length))
        latin = pc.and_(apart, pc.invert(pc.match_substring_regex(words, f"[^\\x00-{LATIN}]"))) if self.fast else pa.array(np.zeros(len(words), bool))
        joint, other = words.filter(latin), words.filter(pc.and_not(apart, latin))
        parts = [pa.array([self.exact(" " + w) for w in other.to_pylist()], pa.binary())]
        if len(joint):
            ids = self.fast(" " + " ".join(joint.to_pylist()))
            ends = np.cumsum(pc.binary_length(joint).to_numpy().astype(np.int64) + 1)
            reached = np.cumsum(self.size[ids])
            to = np.searchsorted(reached, ends, "right")
            if not np.array_equal(reached[to - 1], ends):
                raise ValueError("a token lies in two words")
            at = np.concatenate([[0], to]).astype(np.int32) * array(self.kind).itemsize
            parts.append(pa.BinaryArray.from_buffers(pa.binary(), len(joint), [None, pa.py_buffer(at), pa.py_buffer(ids.astype(self.kind))]))
        place = np.full(len(words), -1)
        apart, latin = apart.to_numpy(zero_copy_only=False), latin.to_numpy(zero_copy_only=False)
        place[apart & ~latin], place[latin] = np.arange(len(other)), len(other) + np.arange(len(joint))
        return pa.concat_arrays(parts).take(pa.array(place, mask=place < 0))

    def _places(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among those remembered, to which the new ones are added."""
        if self.words.nbytes + words.nbytes > self.MOST:
            self._forget()
        found = pc.index_in(words, self.words)
        new = found.is_null()
        places = found.fill_null(0).to_numpy().astype(np.int64)
        if found.null_count:
            places[new.to_numpy(zero_copy_only=False)] = len(self.words) + np.arange(found.null_count)
            unknown = words.filter(new)
            self.words, self.ids = pa.concat_arrays([self.words, unknown]), pa.concat_arrays([self.ids, self._encode(unknown)])
        return places

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Ids of every text, with end after them; a null text is empty."""
        if not len(texts):
            return pa.array([], pa.binary())
        texts = texts.cast(pa.string()).fill_null("")
        lists = pc.split_pattern(texts, " ")
        bounds = lists.offsets.to_numpy()
        first, words = bounds[:-1], lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy()
        heads, head = np.unique(codes[first], return_inverse=True)
        codes = self._places(words.dictionary)[codes]
        head_texts = words.dictionary.take(pa.array(heads)).to_pylist()

        # texts to encode whole
        joined = self.ids.is_null().to_numpy(zero_copy_only=False)[codes]
        joined[first] = np.array([w[-1:].isspace() for w in head_texts])[head]
        joined = np.logical_or.reduceat(joined, first)
        marked = np.zeros(len(texts), bool)
        for s in self.special:
            marked |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(joined | marked)
        ids = [self.exact(t) if m else self.whole(t) for t, m in zip(texts.take(pa.array(odd)).to_pylist(), marked[odd].tolist())]

        more = [*(self.whole(w) for w in head_texts), *ids, b"", end]
        known, last = len(self.ids), len(self.ids) + len(more) - 1
        codes[first] = known + head
        if len(odd):
            codes[np.repeat(joined | marked, np.diff(bounds))] = last - 1
            codes[first[odd]] = known + len(heads) + np.arange(len(odd))
        codes = np.insert(codes, bounds[1:], last)
        out = pa.concat_arrays([self.ids, pa.array(more, pa.binary())]).take(pa.array(codes))
        at = np.frombuffer(out.buffers()[1], np.int32, len(out) + 1)[bounds + np.arange(len(bounds))]
        return pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(at), out.buffers()[2]])

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


_ENCODERS: dict[str, Encoder] = {}


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        part, stop = TaskContext.get().partitionId(), array(encoder.kind, [end]).tobytes()
        before: dict[str, int] = {}
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64) + ROW)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, "right")))
                some, at = batch.slice(at, to - at), to
                ids = encoder.encode_all(some.column("text"), stop)
                sources, lengths = some.column("source").to_pylist(), (pc.binary_length(ids).to_numpy() // len(stop)).tolist()
                starts = []
                for s, n in zip(sources, lengths):
                    starts.append(before.get(s, 0))
                    before[s] = starts[-1] + n
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(sources, pa.string()), pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), ids], schema=TOKENS_ARROW)

    return run


@dataclass
class Phase:
    """A stretch in which the same queues are served: start in the output, length, and amounts taken."""

    start: int
    amounts: list[int]
    ends: list[int] = field(init=False)

    def __post_init__(self):
        self.ends = np.cumsum(self.amounts).tolist()

    @property
    def length(self) -> int:
        return self.ends[-1]

    def served(self, j: int, x: np.ndarray) -> np.ndarray:
        """Tokens that queues 0..j have given when x tokens of the phase are out."""
        if j < 0:
            return np.zeros(len(x), np.int64)
        if j == len(self.ends) - 1:
            return x
        return np.where(x == self.length, self.ends[j], np.floor(x * (self.ends[j] / self.length)).astype(np.int64))


def schedule(totals: list[int], shares: list[float]) -> list[Phase]:
    """Phases until all queues are empty; each ends when a queue runs out, and the rest share its part."""
    left, phases, start = list(totals), [], 0
    while any(left):
        active = [j for j, n in enumerate(left) if n]
        last = min(active, key=lambda j: left[j] / shares[j])
        time = left[last] / shares[last]
        amounts = [0] * len(left)
        for j in active:
            amounts[j] = left[j] if left[j] - shares[j] * time < 1 else int(shares[j] * time)
            left[j] -= amounts[j]
        phases.append(Phase(start, amounts))
        start += phases[-1].length
    return phases


def cut(phases: list[Phase], queue: int, first: int, length: int, window: int) -> Iterator[tuple[int, int, int]]:
    """(start in the document, length, place in the output) of the pieces of tokens first.. of a queue."""
    taken = 0
    for phase in phases:
        amount = phase.amounts[queue]
        lo, hi = max(first, taken) - taken, min(first + length, taken + amount) - taken
        if lo < hi:
            own = lambda x: phase.served(queue, x) - phase.served(queue - 1, x)  # noqa: B023, E731
            ideal = phase.length / amount
            r0 = max(0, int((phase.start + (lo - 2) * ideal) // window) - 1)
            r1 = int((phase.start + (hi + 2) * ideal) // window) + 2
            x = np.clip(np.arange(r0, r1 + 1, dtype=np.int64) * window - phase.start, 0, phase.length)
            x = np.unique(x)
            at, ahead = own(x), phase.served(queue - 1, x)
            k = np.flatnonzero((at[1:] > lo) & (at[:-1] < hi) & (at[1:] > at[:-1]))
            a, b = np.maximum(at[k], lo), np.minimum(at[k + 1], hi)
            place = phase.start + x[k] + (ahead[k + 1] - ahead[k]) + (a - at[k])
            yield from zip((a + taken - first).tolist(), (b - a).tolist(), place.tolist())
        taken += amount


@dataclass
class Tier:
    """Queues served in rounds of window tokens; rest is the queue that the next tier fills."""

    phases: list[Phase]
    window: int
    rest: int


class Plan:
    """Tiers, and for every named source its tier and queue; all other sources stand in the last tier's rest."""

    def __init__(self, totals: dict[str, int], shares: dict[str, float], tail: int, window: int):
        self.tiers: list[Tier] = []
        self.queues: dict[str, tuple[int, int]] = {}
        left = sorted((s for s, n in totals.items() if n), key=lambda s: (-shares[s], s))
        # the tail is served by its tokens, as far as its share goes with the others'
        scale = sum(totals[s] for s in left) / (sum(shares[s] for s in left) or 1)
        tail_share = tail / scale if left else float(tail)
        while left or tail or not self.tiers:
            all_shares = sum(shares[s] for s in left) + tail_share
            if self.tiers:
                least = min((shares[s] for s in left if shares[s] * RANGE >= shares[left[0]]), default=all_shares)
                window = 1 << max(10, int(np.ceil(np.log2(LEAST * all_shares / least))))
            least = LEAST * all_shares / window
            own = [s for s in left if shares[s] >= least]
            if self.tiers and not own:
                own = left[:1]
            below = left[len(own) :]
            while below and len(own) > 1 and sum(shares[s] for s in below) + tail_share < least:
                below.insert(0, own.pop())
            last = not below
            amounts, weights = [totals[s] for s in own], [shares[s] for s in own]
            rest = sum(totals[s] for s in below) + tail
            if rest:
                amounts.append(rest)
                weights.append(sum(shares[s] for s in below) + tail_share)
            for j, s in enumerate(own):
                self.queues[s] = (len(self.tiers), j)
            self.tiers.append(Tier(schedule(amounts, weights), window, len(own)))
            left = below
            if last:
                break

    def cut(self, source: str, first: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(start, length, place in the output) of the pieces of tokens first.. of a source."""
        tier, queue = self.queues.get(source, (len(self.tiers) - 1, self.tiers[-1].rest))
        return self._cut(tier, queue, first, length)

    def _cut(self, tier: int, queue: int, first: int, length: int) -> Iterator[tuple[int, int, int]]:
        own = self.tiers[tier]
        if not length:
            return
        for start, n, place in cut(own.phases, queue, first, length, own.window):
            if not tier:
                yield start, n, place
            else:
                for inner, m, at in self._cut(tier - 1, self.tiers[tier - 1].rest, place, n):
                    yield start + inner, m, at


def _pieces(plan, wide: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PIECES_ARROW)], schema=PIECES_ARROW)

        for batch in batches:
            for doc_id, source, first, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "source", "first", "doc_tokens", "ids"))):
                data = memoryview(np.frombuffer(ids, wide).astype("<u4").tobytes())
                name = None if source == NONE else source
                for start, length, place in plan.value.cut(source, first, n):
                    # a piece that ends one round of its tier and one that begins the next may lie in two windows
                    while length:
                        own = min(length, window - place % window)
                        rows.append((doc_id, start, own, zlib.crc32(data[4 * start : 4 * (start + own)]), n, place // window, place % window, name))
                        start, length, place = start + own, length - own, place + own
                if len(rows) >= 20_000:
                    yield flush()
                    rows.clear()
        if rows:
            yield flush()

    return run


def pack(docs: DataFrame, targets: dict[str, float] | None = None, window: int = WINDOW, tokenizer: str | None = None, end: int = 0) -> DataFrame:
    """Pieces of all documents (doc_id, text, source), packed into windows of the target mixture.

    targets: share of each source; without it the sources' own shares of all tokens, so that every
    window but the last has them to within a token and all queues end together. Sources with less
    than LEAST tokens a window keep their proportions over the longer rounds of a further tier. With
    targets, TARGETS of them at most and one for every source, the others share the part of a source
    that runs out, those of its own tier first.

    A null or empty text gives the end id alone; a null source is a source of its own; repeated rows
    are packed each. An empty table gives no pieces. Only the last window is padded. Texts are read
    whole, and other columns are not read; sources that tie are served in the order of their names.
    """
    import public_tokenizers  # noqa: F401

    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source"), F.lit(NONE)).alias("source"))
    tokens = scratch.keep(map_arrow(rows, _tokenise(path, end), TOKENS), "tokens")
    by_source = scratch.keep(tokens.groupBy("part", "source").agg(F.sum("doc_tokens").alias("n")), "parts")
    total = by_source.agg(F.sum("n")).first()[0] or 0
    sums = scratch.keep(by_source.groupBy("source").agg(F.sum("n").alias("n")), "sources")
    # at most MOST_SOURCES names
    known = {r["source"]: r["n"] for r in commonest(sums, MOST_SOURCES).collect()}
    if targets is None:
        shares = {s: float(n) for s, n in known.items()}
    else:
        known = {s: n for s, n in known.items() if s in targets}
        if len(targets) > TARGETS or sum(known.values()) != total or min(targets.values()) <= 0:
            raise ValueError(f"targets need every source, {TARGETS} at most, each with a share above 0")
        shares = {s: float(targets[s]) for s in known}
    plan = Plan(known, shares, total - sum(known.values()), window)

    # where each part's documents of a source begin in the source's queue, or in that of all sources without one
    named = F.broadcast(sums.filter(F.col("n") >= min(known.values(), default=0)).select("source", F.lit(True).alias("named")))
    if len(known) == sums.count():
        queued = by_source.withColumn("queue", F.col("source"))
    else:
        queued = by_source.join(named, "source", "left").withColumn("queue", F.when(F.col("named"), F.col("source")).otherwise(F.lit(NONE + "rest"))).drop("named")
    by_part = queued.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    parts_at = by_part.select("queue", "part", F.coalesce(F.sum("n").over(before("queue", "part")), F.lit(0)).alias("part_at"))
    inside = queued.withColumn("inner_at", F.coalesce(F.sum("n").over(before("queue", "part", "source")), F.lit(0)))
    starts = inside.join(parts_at, ["queue", "part"]).select("part", "source", (F.col("part_at") + F.col("inner_at")).alias("queue_at"))
    found = small_join(tokens, starts, ["part", "source"], "left", by_source.count())
    located = found.select("doc_id", "source", (F.col("queue_at") + F.col("before")).alias("first"), "doc_tokens", "ids")
    from tokenizers import Tokenizer

    wide = "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"
    return map_arrow(located, _pieces(spark.sparkContext.broadcast(plan), wide, window), PIECES)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
