"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model's symbols are characters: tables of character n-grams stay small in any language, and
shouting, markup and word lists are unlikely in them. Counts of all trusted documents are summed in a
table sharded by n-gram, and discounts, context totals and probabilities are joins and sums of such
tables. To score documents, each document's n-grams are looked up in a bounded cache of the
commonest; all others are counted by document, joined with the sharded tables, backing off where an
n-gram or its context is unknown, and summed up again. So every perplexity is exact. A document is
kept if its perplexity is at most a quantile of those of trusted documents of its language that were
held out of training, and if no word of it is toxic. The mean over a text hides a few words, so words
are judged one by one: two more models, of the words of trusted and of toxic documents, give every
word the ratio of its probabilities, and a word is toxic if its ratio is beyond the worst words of
nearly all trusted documents that were held out. These two are fitted on a bounded sample of the
labelled documents, so they are small arrays that every task holds.

Symbols are code points; those beyond PLAIN are two symbols, of which the first names a block of 1024
code points, so that no two code points share a symbol.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Scratch, commonest, free_memory, map_arrow, small_join

ORDER, BITS = 5, 12
SYMBOLS = 1 << BITS
#: Symbols: 1 starts a text (ORDER - 1 times) and 2 ends it; code points up to PLAIN are symbols of their own.
START, END, PLAIN = 1, 2, 2047
WIDE = 10
CACHE = 1 << 18
QUANTILE, FOLDS, LEAST_HELD_OUT = 0.99, 5, 20
WORST_QUANTILE = 0.998
BROADCAST_IDS = 2_000_000
#: Documents of each kind, toxic and trusted, that the models of words are fitted on, at most.
LABELLED = 50_000
WORD = re.compile(r"[^\W_]+")
REMEMBERED = 200_000
COUNTS = "key long, n long"
COUNTS_ARROW = pa.schema([("key", pa.int64()), ("n", pa.int64())])
WORD_GRAMS = "kind int, key long, n long"
WORD_GRAMS_ARROW = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
SCORES = "row long, own long, known double, symbols long, keys array<long>, times array<int>, worst double"
SCORES_ARROW = pa.schema([("row", pa.int64()), ("own", pa.int64()), ("known", pa.float64()), ("symbols", pa.int64()), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("worst", pa.float64())])


def symbols(text: str) -> np.ndarray:
    """The padded symbols of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    wide = codes > PLAIN
    if wide.any():
        at = np.cumsum(1 + wide) - 1
        out = np.empty(int(at[-1]) + 1, np.int64)
        block = np.where(wide, PLAIN + 1 + (codes >> WIDE) % (1 << WIDE), 0)
        out[at[wide] - 1] = block[wide]
        out[at] = np.where(wide, PLAIN + 1 + (1 << WIDE) + codes % (1 << WIDE), np.maximum(codes, 3))
        codes = out
    else:
        codes = np.maximum(codes, 3)
    return np.concatenate((np.full(ORDER - 1, START), codes, [END]))


def grams(text: str) -> np.ndarray:
    """Every n-gram of the highest order of a text, packed in 60 bits; as many as symbols and one."""
    s = symbols(text)
    out = np.zeros(len(s) - ORDER + 1, np.int64)
    for k in range(ORDER):
        out = out << BITS | s[k : len(s) - ORDER + 1 + k]
    return out


def _count(most: int = 1 << 21):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], schema=COUNTS_ARROW)

        for batch in batches:
            for text in batch.column("text"):
                held.append(grams(text.as_py()))
                size += len(held[-1])
                if size >= most:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _word_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, text) to the n-grams of the distinct words of each text, counted."""
    for whole in batches:
        for batch in words.slices(whole, 1000):
            found: dict[int, Counter] = {}
            for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text")):
                found.setdefault(kind, Counter()).update(set(WORD.findall(text.as_py().lower())))
            for kind, counted in found.items():
                if not counted:
                    continue
                own, sizes = spelt(list(counted))
                keys, at = np.unique(own, return_inverse=True)
                n = np.bincount(at, np.repeat(list(counted.values()), sizes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.int32()), pa.array(keys), pa.array(n)], schema=WORD_GRAMS_ARROW)


class SmallModel:
    """The model of Model, from counted n-grams (key, n) in memory."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        tables = {ORDER: (keys[order], n[order])}
        for k in range(ORDER - 1, 0, -1):
            tables[k] = np.unique(tables[k + 1][0] & ((1 << BITS * k) - 1), return_counts=True)
        self.levels: list[tuple[np.ndarray, ...]] = []
        below, p = None, None
        for k in range(1, ORDER + 1):
            keys, n = tables[k]
            d = discounts(*(int((n == j).sum()) for j in (1, 2, 3, 4)))
            taken = np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))
            contexts, at = np.unique(keys >> BITS, return_inverse=True)
            total = np.bincount(at, n)
            weight = np.bincount(at, taken) / total
            lower = 1.0 / SYMBOLS if below is None else p[np.searchsorted(below, keys & ((1 << BITS * (k - 1)) - 1))]
            below, p = keys, (n - taken) / total[at] + weight[at] * lower
            self.levels.append((keys, p, contexts, weight))

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram of the highest order."""
        out, w, left, own = np.full(len(keys), np.nan), np.ones(len(keys)), np.arange(len(keys)), keys
        for k in range(ORDER, 0, -1):
            known, p, contexts, weight = self.levels[k - 1]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            out[left[hit]] = w[hit] * p[at[hit]]
            left, w, own = left[~hit], w[~hit], own[~hit]
            at = np.minimum(np.searchsorted(contexts, own >> BITS), len(contexts) - 1)
            w = np.where(contexts[at] == own >> BITS, w * weight[at], w)
            own = own & ((1 << BITS * (k - 1)) - 1)
        out[left] = w / SYMBOLS
        return np.log10(out)


class Cache:
    """An open-addressing table of long keys and float values, of fixed size."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.zeros(1 << self.bits)
        left = np.arange(len(keys))
        slot = self.slots(keys)
        self.probes = 0
        while len(left):
            free = self.keys[slot] == -1
            take = np.zeros(len(left), bool)
            _, first = np.unique(slot, return_index=True)
            take[first] = True
            take &= free
            self.keys[slot[take]], self.values[slot[take]] = keys[left[take]], values[left[take]]
            left, slot = left[~take], (slot[~take] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value or 0."""
        slot = self.slots(keys)
        found = self.keys[slot] == keys
        values = np.where(found, self.values[slot], 0.0)
        left = np.flatnonzero(~found & (self.keys[slot] != -1))
        for _ in range(self.probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slot[left]]
            hit = there == keys[left]
            found[left[hit]], values[left[hit]] = True, self.values[slot[left[hit]]]
            left = left[~hit & (there != -1)]
        return found, values


def spelt(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of many words, one after the other, and how many each has; without a loop over them."""
    codes = np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(w) for w in found], np.int64)
    wide = codes > PLAIN
    if wide.any():
        split = symbols("".join(found))[ORDER - 1 : -1]
        ends = np.cumsum(1 + wide)[np.cumsum(sizes) - 1]
        codes, sizes = split, np.diff(ends, prepend=0)
    else:
        codes = np.maximum(codes, 3)
    starts = np.cumsum(sizes + ORDER) - sizes - ORDER
    s = np.full(int(sizes.sum()) + ORDER * len(sizes), START, np.int64)
    s[np.repeat(starts + ORDER - 1, sizes) + words.inside(sizes)] = codes
    s[starts + ORDER - 1 + sizes] = END
    at = np.repeat(starts, sizes + 1) + words.inside(sizes + 1)
    out = np.zeros(len(at), np.int64)
    for k in range(ORDER):
        out = out << BITS | s[at + k]
    return out, sizes + 1


class Words:
    """log10 of the probability of words as toxic ones against that as trusted ones."""

    def __init__(self, trusted: SmallModel, toxic: SmallModel):
        self.trusted, self.toxic = trusted, toxic
        known = np.union1d(trusted.levels[-1][0], toxic.levels[-1][0])
        self.gains = Cache(known, self._gain(known))
        self.ratios: dict[str, float] = {}

    def _gain(self, keys: np.ndarray) -> np.ndarray:
        return self.toxic.log_probability(keys) - self.trusted.log_probability(keys)

    def __getstate__(self):
        return self.trusted, self.toxic, self.gains

    def __setstate__(self, state):
        self.trusted, self.toxic, self.gains = state
        self.ratios = {}

    def learn(self, pieces: list[str]) -> None:
        """Remember the greatest ratio of the words of each piece, a run of characters that are not white space."""
        self.ratios.update(dict.fromkeys(pieces, -np.inf))
        own, found = [], []
        for p in pieces:
            if p.isalnum():
                own.append(p)
                found.append(p)
            else:
                for w in WORD.findall(p):
                    own.append(p)
                    found.append(w)
        if not found:
            return
        keys, sizes = spelt(found)
        known, gain = self.gains.look_up(keys)
        if not known.all():
            gain[~known] = self._gain(keys[~known])
        for p, r in zip(own, np.add.reduceat(gain, np.cumsum(sizes) - sizes).tolist()):
            if r > self.ratios[p]:
                self.ratios[p] = r

    def worst(self, texts: list[str]) -> list[float | None]:
        """The greatest ratio of the words, runs of letters and digits in lower case, of each text; None without one."""
        held = [set(t.lower().split()) for t in texts]
        pieces = set().union(*held)
        if len(self.ratios) > REMEMBERED:
            self.ratios.clear()
        if new := [p for p in pieces if p not in self.ratios]:
            self.learn(new)
        found = [max(map(self.ratios.__getitem__, h), default=-np.inf) for h in held]
        return [None if r == -np.inf else r for r in found]


def _score(cache, spelling=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words = None if spelling is None else spelling.value
        for batch in (b for whole in batches for b in words.slices(whole)):
            rows, texts = [], batch.column("text").to_pylist()
            worst = own_words.worst(texts) if own_words else [None] * len(texts)
            for row, own, text, w in zip(batch.column("row").to_pylist(), batch.column("own").to_pylist(), texts, worst):
                g = grams(text)
                found, values = cache.value.look_up(g)
                keys, times = np.unique(g[~found], return_counts=True)
                rows.append((row, own, float(values.sum()), len(g), keys, times.astype(np.int32), w))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCORES_ARROW)], schema=SCORES_ARROW)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more from the numbers of n-grams with counts 1 to 4."""
    if not n1 or not n2 or not n3:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


def _prefix(key: Column, order: int) -> Column:
    return F.shiftright(key, BITS)


def _suffix(key: Column, order: int) -> Column:
    return key.bitwiseAND((1 << BITS * (order - 1)) - 1)


class Model:
    """Tables of each order, all sharded by n-gram: probability (key, p) and backoff weight (context, weight)."""

    def __init__(self, trusted: DataFrame, scratch: Scratch, counted: bool = False):
        """trusted: one column, text, without nulls; or, if counted, n-grams of the highest order (key, n), in any number of rows each."""
        counted = trusted if counted else map_arrow(trusted, _count(), COUNTS)
        counts = scratch.keep(counted.groupBy("key").agg(F.sum("n").alias("n")), "counts-5")
        self.counts = counts
        tables = {ORDER: counts}
        for k in range(ORDER - 1, 0, -1):
            # continuation counts: how many n-grams of the next order end in this one
            tables[k] = scratch.keep(tables[k + 1].groupBy(_suffix(F.col("key"), k + 1).alias("key")).agg(F.count("*").alias("n")), f"counts-{k}")
        self.p: dict[int, DataFrame] = {}
        self.weight: dict[int, DataFrame] = {}
        self.base = 1.0 / SYMBOLS
        below = None
        for k in range(1, ORDER + 1):
            n = tables[k].agg(*(F.count(F.when(F.col("n") == j, 1)).alias(f"n{j}") for j in (1, 2, 3, 4))).first()
            d = discounts(*n)
            taken = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            contexts = tables[k].groupBy(_prefix(F.col("key"), k).alias("context")).agg(F.sum("n").alias("total"), F.sum(taken).alias("held"))
            contexts = scratch.keep(contexts.select("context", "total", (F.col("held") / F.col("total")).alias("weight")), f"contexts-{k}")
            rows = tables[k].withColumn("context", _prefix(F.col("key"), k)).join(contexts, "context")
            own = (F.col("n") - taken) / F.col("total")
            if below is None:
                p = rows.select("key", (own + F.col("weight") * self.base).alias("p"))
            else:
                lower = below.select(F.col("key").alias("suffix"), F.col("p").alias("lower"))
                p = rows.withColumn("suffix", _suffix(F.col("key"), k)).join(lower, "suffix").select("key", (own + F.col("weight") * F.col("lower")).alias("p"))
            below = self.p[k] = scratch.keep(p, f"p-{k}")
            self.weight[k] = contexts.select("context", "weight")

    def log_probability(self, keys: DataFrame) -> DataFrame:
        """(key, lp): log10 of the probability of each distinct n-gram of the highest order."""
        out = keys.select("key", F.lit(1.0).alias("w"), F.lit(None).cast("double").alias("p"), F.col("key").alias("own"))
        for k in range(ORDER, 0, -1):
            p = self.p[k].select(F.col("key").alias("own"), F.col("p").alias("found"))
            weight = self.weight[k].select(F.col("context").alias("c"), F.col("weight").alias("back"))
            out = out.join(p, "own", "left").withColumn("p", F.coalesce("p", F.col("w") * F.col("found"))).drop("found")
            out = out.withColumn("c", _prefix(F.col("own"), k)).join(weight, "c", "left")
            out = out.select("key", F.when(F.col("p").isNull(), F.col("w") * F.coalesce("back", F.lit(1.0))).otherwise(F.col("w")).alias("w"), "p", _suffix(F.col("own"), k).alias("own"))
        return out.select("key", F.log10(F.coalesce("p", F.col("w") * self.base)).alias("lp"))


def perplexities(rows: DataFrame, model: Model, scratch: Scratch, cache_size: int = CACHE, spelling=None) -> DataFrame:
    """(row, symbols, perplexity, worst) of each of rows (row, text), text without nulls; row may repeat.

    spelling: broadcast Words, for the column worst.
    """
    spark = rows.sparkSession
    top = commonest(model.counts, cache_size).join(model.p[ORDER], "key").select("key", F.log10("p").alias("lp"))
    # at most cache_size entries of 16 bytes
    held = top.toArrow()
    cache = spark.sparkContext.broadcast(Cache(held["key"].to_numpy(), held["lp"].to_numpy()))
    del held
    free_memory()
    # own tells repeated rows apart; it is written with the scores, so it stays the same whatever is computed again
    numbered = rows.withColumn("own", F.monotonically_increasing_id())
    scored = scratch.keep(map_arrow(numbered, _score(cache, spelling), SCORES), "scored")
    misses = scored.select("own", F.explode(F.arrays_zip("keys", "times")).alias("m")).select("own", F.col("m.keys").alias("key"), F.col("m.times").alias("times"))
    resolved = scratch.keep(model.log_probability(misses.select("key").distinct()), "resolved")
    summed = misses.join(resolved, "key").groupBy("own").agg(F.sum(F.col("times") * F.col("lp")).alias("rest"))
    found = scored.select("row", "own", "known", "symbols", "worst").join(summed, "own", "left")
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    return found.select("row", "symbols", "worst", F.pow(F.lit(10.0), -total / F.col("symbols")).alias("perplexity"))


def _limits(held: DataFrame, value: str, quantile: float) -> tuple[DataFrame, float | None]:
    """(l, own): the quantile of value of each language, "" for null, with LEAST_HELD_OUT rows (lang, value); and that of all."""
    level = F.percentile_approx(value, quantile, 10_000)
    by_lang = held.groupBy(F.coalesce("lang", F.lit("")).alias("l")).agg(level.alias("own"), F.count("*").alias("n")).filter(F.col("n") >= LEAST_HELD_OUT).drop("n")
    return by_lang, held.agg(level).first()[0]


def _by_lang(rows: DataFrame, limits: tuple[DataFrame, float | None], name: str) -> DataFrame:
    by_lang, overall = limits
    joined = rows.join(by_lang, F.coalesce("lang", F.lit("")) == F.col("l"), "left")
    return joined.withColumn(name, F.coalesce("own", F.lit(overall).cast("double"))).drop("l", "own")


def _sampled(ids: DataFrame, n: int) -> DataFrame:
    """Of n distinct ids (doc_id), about LABELLED by a hash, or all if they are no more."""
    return ids if n <= LABELLED else ids.filter(F.pmod(F.xxhash64(F.lit("labelled"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * LABELLED / n))


def fit_words(base: DataFrame, good: DataFrame, labels: DataFrame, scratch: Scratch) -> Words | None:
    """Models of the words of toxic and of trusted documents of base (doc_id, text); None without labels to learn from.

    good: trusted documents (doc_id, held_out). Both models see LABELLED documents of their kind at most.
    """
    bad = labels.filter("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    kinds = (good.filter("not held_out").select("doc_id"), bad.filter(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) != 0))
    ids = None
    for kind, own in enumerate(kinds):
        some = _sampled(own, own.count()).select("doc_id", F.lit(kind).alias("kind"))
        ids = some if ids is None else ids.unionByName(some)
    ids = scratch.keep(ids, "labelled")
    # 12 bytes a labelled document, of a bounded number
    texts = base.join(F.broadcast(ids), "doc_id").select("kind", "text")
    counted = map_arrow(texts, _word_grams, WORD_GRAMS).groupBy("kind", "key").agg(F.sum("n").alias("n")).toArrow()
    kinds, keys, n = (counted[c].to_numpy() for c in ("kind", "key", "n"))
    if len(np.unique(kinds)) < 2:
        return None
    return Words(*(SmallModel(keys[kinds == k], n[kinds == k]) for k in (0, 1)))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, cache_size: int = CACHE) -> DataFrame:
    """doc_id, lang, trusted, perplexity, threshold, toxic and keep of every row of docs (doc_id, text, lang), and row.

    Trusted are the documents with a label of quality 1 and not toxic; a part of 1/FOLDS of them, by a
    hash of doc_id, is held out of training, and the quantile of its perplexities is the threshold of
    its language. A language, null included, with fewer than LEAST_HELD_OUT of them has the threshold
    of all languages together; without any trusted document everything is kept. Null and empty texts
    have one symbol, their end, and are scored like others. Repeated rows have equal results, a
    doc_id with several labels is trusted if all of them are good. row tells rows of different doc_id
    or text apart. worst: how much likelier, in powers of ten, the worst word of the text is in
    documents labelled toxic than in trusted ones; null without a word, or without toxic labels. toxic:
    worst is beyond the WORST_QUANTILE of that of trusted documents held out, of the row's language
    where there are enough; such rows are not kept. Texts are read whole. An empty table gives an empty
    result, and a perplexity equal to its threshold is kept. Other columns of docs and labels are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    doc_id, body = F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("good")).filter("good")
    good = good.select("doc_id", F.lit(True).alias("trusted"), (F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0).alias("held_out"))
    base = docs.select(doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), body.alias("text"), F.xxhash64(F.coalesce(doc_id, F.lit(-(1 << 63))), body).alias("row"))
    # 8 bytes a trusted document: up to BROADCAST_IDS of them go to the texts, beyond that the texts are shuffled
    ids = scratch.keep(good.filter("not held_out").select("doc_id"), "trusted")
    model = Model(small_join(base, ids, ["doc_id"], "left_semi", ids.count(), BROADCAST_IDS).select("text"), scratch)
    fitted = fit_words(base, good, labels, scratch)
    spelling = docs.sparkSession.sparkContext.broadcast(fitted) if fitted else None
    del fitted
    free_memory()
    found = perplexities(base.select("row", "text"), model, scratch, cache_size, spelling).dropDuplicates(["row"])
    named = base.select("doc_id", "lang", "row").join(good, "doc_id", "left").join(found, "row")
    named = scratch.keep(named.withColumn("trusted", F.coalesce("trusted", F.lit(False))), "named")
    held = named.filter("held_out")
    joined = _by_lang(named, _limits(held, "perplexity", quantile), "threshold")
    joined = _by_lang(joined, _limits(held, "worst", WORST_QUANTILE), "limit")
    joined = joined.withColumn("toxic", F.coalesce(F.col("worst") > F.col("limit"), F.lit(False)))
    keep = (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold"))) & ~F.col("toxic")
    return joined.select("doc_id", "lang", "trusted", "perplexity", "threshold", "worst", "toxic", keep.alias("keep"), "row")


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """docs without the rows that the classifier rejects."""
    bad = classify(docs, labels, **settings).filter("not keep").select(F.col("row").alias("_row")).distinct()
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce(F.col("text"), F.lit("")))
    return docs.join(bad, row == bad["_row"], "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row")
