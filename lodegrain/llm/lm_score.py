"""Language-model scores of documents by a log-bilinear neural model of two levels.

The words of the vocabulary stand in classes: the commonest words have one each, and the others share
classes by how they end. The first level predicts the class of a token from the classes of the two
tokens before it: each has a vector, a matrix for its place maps it, and the sum is multiplied with
every class's output vector. The second level predicts the word within its class from the class
before: each of the commonest words (the head) has a vector and a bias of its own. Both are trained in numpy
with noise-contrastive estimation. As a score is a sum of one term for each place, batched matrix
products give all terms and, for every pair of classes, the normalisers. Words of a class beyond the
head have their smoothed share of the class's training tokens, and one type of each class stands for
all unknown words; so the probabilities of all tokens sum to one.

Training documents are dealt by a hash to shards of about SHARD tokens, and the shards to rounds. In a
round every shard starts from the same weights, passes over its documents in the order of their
hashes, and the results are averaged by tokens in the order of the shards. So the model depends on the
documents alone, not on how they are partitioned.

Counts of the head are sent to the tasks, in a table of bounded size; those of all other words are
joined by word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, commonest, free_memory, map_arrow

END = ""
#: Words with vectors of their own, at most, and the bytes of the longest.
HEAD, HEAD_BYTES = 60_000, 256
SINGLE, ENDINGS, WIDTH, INNER_WIDTH = 384, 128, 16, 8
CLASSES = 1 + SINGLE + ENDINGS
NOISE, INNER_NOISE, BATCH, RATE, FIRST = 40, 5, 4096, 0.1, 1e-6
SHARD, ROUNDS = 2_000_000, 4
REMEMBERED = 300_000
FOLDS, HELD_OUT = 5, 1
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

COUNTS = "word string, n long"
COUNTS_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64())])
IDS = "row long, doc_id long, held_out boolean, shard long, hash long"
CODED = f"{IDS}, codes binary, words array<string>, times array<int>"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, known double, neural double"
SCORED_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("known", pa.float64()), ("neural", pa.float64())])
WEIGHTS = "shard long, tokens long, weights binary"
WEIGHTS_ARROW = pa.schema([("shard", pa.int64()), ("tokens", pa.int64()), ("weights", pa.binary())])
CLASS_SUMS = "class int, n long, types long"

def tokens(text: str) -> list[bytes]:
    """The words of a text and its end, in UTF-8.

    For bytes, lower() changes A-Z alone, and split() cuts at ASCII white space: other white space is
    part of words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(b"")
    return words


def ending_class(word: bytes | str) -> int:
    """The class of a word that has none of its own: a hash of its last two letters and what stands after them."""
    word = word.decode("utf-8", "surrogatepass") if isinstance(word, bytes) else word
    core = word.rstrip(".,;:!?|\"')]}%$&*#")
    return 1 + SINGLE + zlib.crc32(f"{core[-2:]}\0{word[len(core) :][:1]}".encode("utf-8", "surrogatepass")) % ENDINGS


def _counts(most: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            for at in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + 100_000], pa.string()), pa.array(n[at : at + 100_000], pa.int64())], schema=COUNTS_ARROW)
            held.clear()

        for batch in batches:
            for text in batch.column("text"):
                held.update(tokens(text.as_py()))
                if len(held) > most:
                    yield from flush()
        if held:
            yield from flush()

    return run


@dataclass
class Weights:
    """r: input vectors; c: a matrix for each place before; q: output vectors; b: biases, log probabilities at first.

    Within classes, inner_r: input vectors of the class before; inner_q and inner_b: vectors and biases of head words.
    """

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray
    inner_r: np.ndarray
    inner_q: np.ndarray
    inner_b: np.ndarray

    @staticmethod
    def shapes(head: int) -> tuple:
        return (CLASSES, WIDTH), (2, WIDTH, WIDTH), (CLASSES, WIDTH), (CLASSES,), (CLASSES, INNER_WIDTH), (head, INNER_WIDTH), (head,)

    @classmethod
    def start(cls, unigram: np.ndarray, inner: np.ndarray | None = None, seed: int = 7) -> "Weights":
        """inner: log probabilities of the head words within their classes."""
        rng = np.random.default_rng(seed)
        inner = np.zeros(0) if inner is None else inner
        make = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        eye = np.stack([np.eye(WIDTH, dtype=np.float32)] * 2)
        return cls(make(CLASSES, WIDTH), eye, make(CLASSES, WIDTH), np.log(unigram).astype(np.float32), make(CLASSES, INNER_WIDTH), make(len(inner), INNER_WIDTH), inner.astype(np.float32))

    def all(self) -> tuple:
        return self.r, self.c, self.q, self.b, self.inner_r, self.inner_q, self.inner_b

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms [class before, class] of the two places, biases included in the first, and log normalisers [before, before that]."""
        first = (self.r @ self.c[0]) @ self.q.T + self.b
        second = (self.r @ self.c[1]) @ self.q.T
        z = np.empty((CLASSES, CLASSES), np.float32)
        for k in range(CLASSES):
            s = second + first[k]
            top = s.max(1)
            z[k] = np.log(np.exp(s - top[:, None]).sum(1)) + top
        return first, second, z

    def inner_table(self, classes: np.ndarray) -> np.ndarray:
        """Log normalisers [class, class before] of the head words of each class; classes: that of each head word."""
        z = np.zeros((CLASSES, CLASSES), np.float32)
        for k in np.unique(classes).tolist():
            own = np.flatnonzero(classes == k)
            s = self.inner_r @ self.inner_q[own].T + self.inner_b[own]
            top = s.max(1)
            z[k] = np.log(np.exp(s - top[:, None]).sum(1)) + top
        return z


class State:
    """Weights and the sums of squared gradients, as one array that can be averaged."""

    def __init__(self, weights: Weights, sums: list[np.ndarray] | None = None):
        self.weights = weights
        # a sum for each row of word vectors, one for each number elsewhere
        self.sums = sums or [np.full(x.shape[:1] if k == 5 else x.shape, FIRST, np.float32) for k, x in enumerate(weights.all())]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.weights.all(), *self.sums)])

    @classmethod
    def shaped(cls, flat: np.ndarray, head: int) -> "State":
        shapes = Weights.shapes(head)
        shapes = (*shapes, *(s[:1] if k == 5 else s for k, s in enumerate(shapes)))
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        parts = [x.reshape(s).astype(np.float32) for x, s in zip(np.split(flat, cuts), shapes)]
        return cls(Weights(*parts[:7]), parts[7:])


class Trainer:
    """Noise-contrastive estimation with AdaGrad steps over batches of tokens."""

    def __init__(self, state: State, unigram: np.ndarray, classes: np.ndarray, shares: np.ndarray, seed: int):
        """classes and shares: class of each head word, and its probability within it."""
        self.w, self.sums, self.noise_p = state.weights, state.sums, unigram
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.cumulative = np.cumsum(unigram)
        self.order = np.argsort(classes, kind="stable")
        self.inner_sums = np.concatenate(([0.0], np.cumsum(shares[self.order])))
        self.firsts = np.searchsorted(classes[self.order], np.arange(CLASSES + 1))
        self.log_inner = np.log(INNER_NOISE * np.maximum(shares, 1e-12)).astype(np.float32)

    def _step(self, k: int, x: np.ndarray, gradient: np.ndarray) -> None:
        self.sums[k] += gradient * gradient
        x += RATE * gradient / np.sqrt(self.sums[k])

    @staticmethod
    def _sparse(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # numpy sorts 16-bit numbers by their digits
        order = np.argsort(at.astype(np.uint16) if HEAD < 1 << 16 else at, kind="stable")
        own = at[order]
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        return own[starts], np.add.reduceat(rows[order], starts)

    @classmethod
    def _add(cls, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, *rows.shape[1:]), np.float32)
        own, sums = cls._sparse(at, rows)
        out[own] = sums
        return out

    def batch(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        w = self.w
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), CLASSES - 1)
        r1, r2, q, nq = w.r[one], w.r[two], w.q[target], w.q[noise]
        h = r1 @ w.c[0] + r2 @ w.c[1]
        up, down = _errors(np.einsum("ij,ij->i", h, q) + (w.b - self.log_noise)[target], h @ nq.T + (w.b[noise] - self.log_noise[noise]), len(target))
        gh = up[:, None] * q + down @ nq
        gq = self._add(target, up[:, None] * h, CLASSES)
        gb = np.bincount(target, up, CLASSES).astype(np.float32)
        own, at = np.unique(noise, return_inverse=True)
        for k, rows in ((gq, down.T @ h), (gb, down.sum(0))):
            sums = np.zeros((len(own), *rows.shape[1:]), np.float32)
            np.add.at(sums, at, rows)
            k[own] += sums
        gr = self._add(np.concatenate((one, two)), np.concatenate((gh @ w.c[0].T, gh @ w.c[1].T)), CLASSES)
        gc = np.stack([r1.T @ gh, r2.T @ gh])
        for k, (x, g) in enumerate(((w.r, gr), (w.c, gc), (w.q, gq), (w.b, gb))):
            self._step(k, x, g)

    def inner_batch(self, word: np.ndarray, own: np.ndarray, one: np.ndarray) -> None:
        """word: head words of classes that have several; own: their classes, sorted; one: the classes before."""
        if not len(word):
            return
        w = self.w
        new = np.append(True, own[1:] != own[:-1])
        starts, at = np.flatnonzero(new), np.cumsum(new) - 1
        present = own[starts]
        lo, hi = self.inner_sums[self.firsts[present]], self.inner_sums[self.firsts[present + 1]]
        drawn = lo[:, None] + self.rng.random((len(present), INNER_NOISE)) * (hi - lo)[:, None]
        place = np.searchsorted(self.inner_sums, drawn, "right") - 1
        noise = self.order[np.clip(place, self.firsts[present][:, None], self.firsts[present + 1][:, None] - 1)]
        v, q, nq = w.inner_r[one], w.inner_q[word], w.inner_q[noise][at]
        false = np.einsum("mkd,md->mk", nq, v) + (w.inner_b[noise] - self.log_inner[noise])[at]
        up, down = _errors(np.einsum("ij,ij->i", v, q) + (w.inner_b[word] - self.log_inner[word]), false, len(word))
        gv = up[:, None] * q + np.einsum("mk,mkd->md", down, nq)
        # the last column is the gradient of the bias
        v1 = np.concatenate((v, np.ones((len(v), 1), np.float32)), 1)
        gn = np.add.reduceat(down[:, :, None] * v1[:, None, :], starts).reshape(-1, INNER_WIDTH + 1)
        touched, sums = self._sparse(np.concatenate((word, noise.ravel())), np.concatenate((up[:, None] * v1, gn)))
        g, gb = sums[:, :-1], sums[:, -1]
        self.sums[5][touched] += np.einsum("ij,ij->i", g, g) / INNER_WIDTH
        w.inner_q[touched] += RATE * g / np.sqrt(self.sums[5][touched])[:, None]
        self.sums[6][touched] += gb * gb
        w.inner_b[touched] += RATE * gb / np.sqrt(self.sums[6][touched])
        self._step(4, w.inner_r, self._add(one, gv, CLASSES))


def _errors(sure: np.ndarray, false: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """What the probabilities of true and of noise words lack, over n, from the log odds of being true."""
    with np.errstate(over="ignore"):
        scale = np.float32(1 / n)
        return scale / (1 + np.exp(sure)), -scale / (1 + np.exp(-false))


class Vocabulary:
    """Codes of words, in UTF-8: the number of a head word, or the head's size and the class of another word's ending."""

    def __init__(self, head: list[tuple[str, int]]):
        """head: words with their training counts, the commonest first."""
        self.code = {w.encode(): k for k, (w, _) in enumerate(head)}
        self.count = np.array([n for _, n in head], np.float64)
        single = {w: 1 + k for k, w in enumerate([w for w in self.code if w][:SINGLE])}
        single[b""] = 0
        own = [single[w] if w in single else ending_class(w) for w in self.code]
        #: The class of every code, and whether it is a head word whose class holds others too.
        self.classes = np.array([*own, *range(CLASSES)], np.int64)
        self.shared = np.zeros(len(self.classes), bool)
        self.shared[: len(head)] = np.array(own, np.int64) > SINGLE
        self.endings: dict[bytes, int] = {}

    def __getstate__(self):
        return {**self.__dict__, "endings": {}}

    def __len__(self) -> int:
        return len(self.count)

    def _ending(self, word: bytes) -> int:
        if len(self.endings) > REMEMBERED:
            self.endings.clear()
        code = self.endings[word] = len(self.count) + ending_class(word)
        return code

    def codes(self, words: list[bytes]) -> list[int]:
        get, endings, ending = self.code.get, self.endings.get, self._ending
        return [k if (k := get(w)) is not None else e if (e := endings(w)) is not None else ending(w) for w in words]


def _class_sums(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, types = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        v = vocabulary.value
        for batch in batches:
            at = v.classes[v.codes(batch.column("word").cast(pa.binary()).to_pylist())]
            np.add.at(n, at, batch.column("n").to_numpy(zero_copy_only=False))
            np.add.at(types, at, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES, dtype=np.int32)), pa.array(n), pa.array(types)], names=["class", "n", "types"])

    return run


def _contexts(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, and of the one and the two before; before a document stands its end."""
    target = np.concatenate(ids)
    firsts = np.cumsum([len(x) for x in ids]) - [len(x) for x in ids]
    one = np.concatenate(([0], target[:-1]))
    one[firsts] = 0
    two = np.concatenate(([0], one[:-1]))
    two[firsts] = 0
    return target, one, two


def _encode(vocabulary):
    """Rows of IDS and text to codes of their tokens, and the words beyond the head with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        n = len(v)
        names = [f.split()[0] for f in CODED.split(", ")]
        for batch in (b for whole in batches for b in W.slices(whole)):
            codes, words, times = [], [], []
            for text in batch.column("text").to_pylist():
                own = tokens(text)
                code = np.array(v.codes(own), np.int32)
                some = Counter([own[i] for i in np.flatnonzero(code >= n).tolist()])
                codes.append(code.tobytes())
                words.append(list(some))
                times.append(list(some.values()))
            columns = [*(batch.column(c) for c in names[:5]), pa.array(codes, pa.binary()), pa.array(words, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _train(vocabulary, start, unigram: np.ndarray, shares: np.ndarray):
    """Rows of CODED, sorted by (shard, hash), to one row of trained state for each shard; start: the broadcast state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        n = len(v)
        shard, trainer, state, seen, held, size = None, None, None, 0, [], 0

        def learn() -> None:
            nonlocal seen
            code, (target, one, two) = np.concatenate(held), _contexts([v.classes[x] for x in held])
            order = trainer.rng.permutation(len(target))
            for at in range(0, len(order), BATCH):
                k = order[at : at + BATCH]
                trainer.batch(target[k], one[k], two[k])
                k = k[v.shared[code[k]]]
                k = k[np.argsort(target[k], kind="stable")]
                trainer.inner_batch(code[k], target[k], one[k])
            seen += len(target)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([seen]), pa.array([state.flat().astype(np.float32).tobytes()], pa.binary())], schema=WEIGHTS_ARROW)

        for batch in batches:
            for own, codes in zip(batch.column("shard").to_pylist(), batch.column("codes")):
                if own != shard:
                    if shard is not None:
                        if held:
                            learn()
                        yield done()
                    shard, seen, held, size = own, 0, [], 0
                    state = State.shaped(start.value, n)
                    trainer = Trainer(state, unigram, v.classes[:n], shares, 11 + own)
                held.append(np.frombuffer(codes.as_py(), np.int32))
                size += len(held[-1])
                if size >= 1 << 18:
                    learn()
                    held, size = [], 0
        if shard is not None:
            if held:
                learn()
            yield done()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of WEIGHTS with their group, sorted by (group, shard), to one row a group: states averaged by tokens."""
    group, n, total = None, 0, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([group]), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], schema=WEIGHTS_ARROW)
    for batch in batches:
        for own, k, data in zip(batch.column("group").to_pylist(), batch.column("tokens").to_pylist(), batch.column("weights")):
            if own != group:
                if group is not None:
                    yield done()
                group, n, total = own, 0, None
            x = np.frombuffer(data.as_py(), np.float32).astype(np.float64) * k
            n, total = n + k, x if total is None else total + x
    if group is not None:
        yield done()


def average(rows: DataFrame, scratch: Scratch, name: str, fan: int = 32) -> np.ndarray | None:
    """States averaged by tokens, in rounds of fan neighbouring shards to a row, so in the same order however rows are dealt."""
    rows, level = scratch.keep(rows, f"{name}-0", "none"), 0
    n = rows.count()
    while n > 1:
        level += 1
        grouped = rows.withColumn("group", F.floor(F.col("shard") / fan).cast("long"))
        dealt = grouped.repartition(max(1, -(-n // fan)), "group").sortWithinPartitions("group", "shard").select("group", "tokens", "weights")
        rows = scratch.keep(map_arrow(dealt, _average, WEIGHTS), f"{name}-{level}", "none")
        n = rows.count()
    row = rows.first()
    out = np.frombuffer(bytes(row["weights"]), np.float32) if row else None
    for k in range(level + 1):
        scratch.drop(f"{name}-{k}")
    return out


def _score(vocabulary, tables):
    """Rows of CODED to scores without the words beyond the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        n = len(v)
        first, second, z, inner_r, inner_q, inner_b, inner_z, base, inner = tables.value
        for batch in (b for whole in batches for b in W.slices(whole)):
            coded = [np.frombuffer(c.as_py(), np.int32) for c in batch.column("codes")]
            code, (target, one, two) = np.concatenate(coded), _contexts([v.classes[x] for x in coded])
            lp = (first[one, target] + second[two, target] - z[one, two]).astype(np.float64)
            k = np.flatnonzero(v.shared[code])
            lp[k] += np.einsum("ij,ij->i", inner_q[code[k]], inner_r[one[k]]) + inner_b[code[k]] - inner_z[target[k], one[k]]
            lp = lp / np.log(10)
            known = code < n
            lp[known] += inner[code[known]]
            based = np.zeros(len(code))
            based[known] = base[code[known]]
            sizes = np.array([len(c) for c in coded])
            sums = [np.add.reduceat(x, np.cumsum(sizes) - sizes) for x in (known.astype(np.int64), based, lp)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "held_out")), *(pa.array(x) for x in (sizes, *sums))], schema=SCORED_ARROW)

    return run


def _rare_classes(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            at = v.classes[v.codes(batch.column("word").cast(pa.binary()).to_pylist())].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(at)], names=["word", "n", "class"])

    return run


def score_documents(docs: DataFrame, head_words: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    held_out: crc32 of doc_id as text leaves 1 modulo 5; a null doc_id counts as empty text. All other
    documents are trained on. A null text counts as empty and has one token, its end. n_known counts
    the tokens that occur in training. base_score is the add-half unigram log10 probability, with one
    type for unknown words; score the model's. Repeated rows are scored, and trained on, each. Without
    any training document the model is the same for all classes. Texts are read whole, of any length;
    other columns are not read; an empty table gives an empty result. head_words: words that have
    vectors of their own, which the score depends on; of words that tie at that limit none has.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    scratch = Scratch(spark, "lm")
    doc_id = F.col("doc_id").cast("long")
    held_out = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT
    base = docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    training = base.filter("not held_out").select("text")

    counts = scratch.keep(map_arrow(training, _counts(), COUNTS).groupBy("word").agg(F.sum("n").alias("n")), "counts")
    n, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # at most head_words words of HEAD_BYTES bytes; the end is always among them
    top = commonest(counts.filter(F.octet_length("word") <= HEAD_BYTES), head_words)
    head = [(r["word"], r["n"]) for r in top.collect()]
    if n and END not in dict(head):
        head.append((END, counts.filter(F.col("word") == END).first()["n"]))
    head.sort(key=lambda x: (-x[1], x[0]))
    vocabulary = Vocabulary(head)
    shared = sc.broadcast(vocabulary)
    sums = map_arrow(counts, _class_sums(shared), CLASS_SUMS).groupBy("class").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()
    class_n, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        class_n[r["class"]], class_types[r["class"]] = r["n"], r["types"]
    unigram = (class_n + 0.5) / (class_n + 0.5).sum()
    # a class of one word has no type for unknown words; the others share all words that have no class of their own
    own = np.arange(CLASSES) <= SINGLE
    inner_total = np.where(own, 1.0, class_n + 0.5 * (class_types + 1))
    classes = vocabulary.classes[: len(vocabulary)]
    in_head = np.bincount(classes, vocabulary.count + 0.5, CLASSES)
    shares = (vocabulary.count + 0.5) / in_head[classes]

    shards = max(1, round(int(n) / SHARD))
    rounds = min(ROUNDS, shards)
    state = State(Weights.start(unigram, np.log(shares))).flat()
    identity = F.xxhash64(F.coalesce("doc_id", F.lit(-(1 << 63))), "text")
    numbered = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", F.pmod(identity, F.lit(shards)).alias("shard"), F.xxhash64(F.lit(1), "doc_id", "text").alias("hash"), "text")
    # written once, so that row numbers hold whatever is computed again
    coded = scratch.keep(map_arrow(numbered, _encode(shared), CODED), "codes")
    for k in range(rounds if n else 0):
        some = coded.filter(~F.col("held_out") & (F.col("shard") % rounds == k)).select("shard", "hash", "codes").repartition(max(1, -(-shards // rounds)), "shard").sortWithinPartitions("shard", "hash")
        start = sc.broadcast(state)
        trained = average(map_arrow(some, _train(shared, start, unigram, shares), WEIGHTS), scratch, f"round-{k}")
        state = state if trained is None else trained
    weights = State.shaped(state, len(vocabulary)).weights
    first, second, z = weights.tables()

    whole = np.log10(n + 0.5 * (types + 1))
    # of a class that several words share, the head's part is the second level's
    log_share = np.log10(in_head / inner_total, out=np.zeros(CLASSES), where=in_head > 0)
    log_inner = np.where(vocabulary.shared[: len(vocabulary)], log_share[classes], 0.0)
    log_base = np.log10(vocabulary.count + 0.5) - whole
    inner_z = weights.inner_table(classes)
    tables = sc.broadcast((first, second, z, weights.inner_r, weights.inner_q, weights.inner_b, inner_z, log_base, log_inner))
    del weights, first, second, z, inner_z
    free_memory()
    scored = map_arrow(coded.select("row", "doc_id", "held_out", "codes"), _score(shared, tables), SCORED)
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    tail = map_arrow(counts, _rare_classes(shared), "word string, n long, class int").select("word", "n", "class")
    joined = rare.join(tail, "word", "left")
    # an unknown word needs its class too; classes of known words come with their counts
    ends = _ending_column()
    cls = F.coalesce(F.col("class"), ends)
    per_class = F.from_json(F.lit(str([float(x) for x in inner_total])), "array<double>")
    c = F.coalesce("n", F.lit(0)) + 0.5
    parts = joined.select(
        "row", "times", F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("seen"),
        (F.col("times") * (F.log10(c) - F.lit(float(whole)))).alias("base"),
        (F.col("times") * F.log10(c / F.element_at(per_class, cls + 1))).alias("inner"),
    )
    extra = parts.groupBy("row").agg(F.sum("seen").alias("seen"), F.sum("base").alias("base"), F.sum("inner").alias("inner"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    return scored.join(extra, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("seen")).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("known") + zero("base")).cast("double").alias("base_score"), (F.col("neural") + zero("inner")).cast("double").alias("score"),
    )


def _ending_column():
    """ending_class of the column word, for Spark."""
    core = F.regexp_replace("word", "[.,;:!?|\"')\\]}%$&*#]+$", "")
    after = F.substr(F.col("word"), F.length(core) + 1, F.lit(1))
    key = F.concat(F.when(F.length(core) > 0, F.substring(core, -2, 2)).otherwise(F.lit("")), F.lit("\0"), after)
    return (F.lit(1 + SINGLE) + F.crc32(key.cast("binary")) % ENDINGS).cast("int")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
