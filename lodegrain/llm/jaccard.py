"""N-gram Jaccard self-join by MinHash banding.

Equal texts are one text from the start. Every distinct text gets bands of MinHash values over its
five-word shingles; the number of bands is the least for which a pair at the threshold shares two of
them with the target recall. Texts that share a band are compared with pivots of their bucket, not with each other:
in each round a bucket's pivot is the text, of those not yet linked in it, that shares most bands with
others; buckets that still hold several classes after the rounds are compared in blocks. Every link is checked on the full sets
of shingles, and classes are the connected components of the links.

These links suffice for the classes, but are not all links. As linked texts are of one class, the others
are found within classes: every two texts of a class are compared on their full sets, in blocks, and
each text's links are counted where they are found, so that no row is made for a pair.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Scratch, free_name, map_arrow

THRESHOLD, ROWS, RECALL = 0.8, 4, 0.9999
ROUNDS, BLOCK, COMMON = 2, 512, 2
#: Bytes of text in a block of a class, about, and shingles in a step of a matrix product.
BLOCK_BYTES, WIDTH = 1 << 23, 1 << 12
BANDS = "tid long, bands array<long>"
BANDS_ARROW = pa.schema([("tid", pa.int64()), ("bands", pa.list_(pa.int64()))])
LINKS = "a long, b long, similarity double"
LINKS_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])
COUNTS = "tid long, n long"
COUNTS_ARROW = pa.schema([("tid", pa.int64()), ("n", pa.int64())])
ALONE = 2


def band_count(threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL, common: int = 1) -> int:
    """Bands needed for a pair of the threshold's similarity to share common of them with the recall asked for."""
    p, n = threshold**rows, common
    while sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(common)) > 1 - recall:
        n += 1
    return n


def shingle_sets(texts: list[str]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for s in words.chunks(texts):
        h, runs = words.shingles(*words.hash_words([t.lower().split() for t in texts[s]]))
        for part in np.split(h, np.cumsum(runs)[:-1]):
            yield np.unique(part)


def _sign(bands: int, rows: int):
    rng = np.random.default_rng(20240229)
    factors = rng.integers(1 << 62, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in words.slices(whole)):
            ids, texts = batch.column("tid").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for s in words.chunks(texts):
                h, runs = words.shingles(*words.hash_words([t.lower().split() for t in texts[s]]))
                own = ids[s][runs > 0]
                if not len(own):
                    continue
                starts = (np.cumsum(runs) - runs)[runs > 0]
                keys = np.zeros((len(own), bands), np.uint64)
                for k, f in enumerate(factors):
                    low = np.minimum.reduceat(words.mix(h * f) if k % rows == 0 else (h * f) ^ ((h * f) >> np.uint64(29)), starts)
                    b = k // rows
                    keys[:, b] = words.mix(keys[:, b] * np.uint64(31) + low + np.uint64(b + 1))
                flat = pa.array(keys.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([pa.array(own), lists], schema=BANDS_ARROW)

    return run


def _similar(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _verify(threshold: float):
    """Rows (a, b, text_a, text_b) to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("text_a"), batch.column("text_b")
            out = []
            for at in range(0, len(a), 200):
                sets = list(shingle_sets([x.as_py() for x in ta.slice(at, 200)]))
                for i, x in zip(range(at, at + 200), sets):
                    if b[i] != last:
                        last, last_set = b[i], next(shingle_sets([tb[i].as_py()]))
                    if (j := _similar(x, last_set)) >= threshold:
                        out.append((a[i], b[i], j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LINKS_ARROW)], schema=LINKS_ARROW)

    return run


def _blocks(threshold: float):
    """Rows (task, band, side, tid, label, bands, text), sorted by task, to links between the sides of a task.

    A task holds BLOCK texts on each side, so memory is bounded; side 0 alone is compared with itself.
    Pairs that links already connect are skipped, so a task gives fewer links than it has texts. A pair
    is compared in the first bucket that it shares, if it shares COMMON of them.
    """

    def pairs(band: int, left: list, right: list):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        sets: dict[int, np.ndarray] = {}

        def own(row: tuple) -> np.ndarray:
            if row[0] not in sets:
                sets[row[0]] = next(shingle_sets([row[3]]))
            return sets[row[0]]

        other = right or left
        if not left:
            return
        theirs = np.stack([r[2] for r in other])
        for i, a in enumerate(left):
            same = theirs == a[2]
            near = (same.sum(1) >= COMMON) & same[:, band] & ~same[:, :band].any(1)
            if not right:
                near[: i + 1] = False
            for k in np.flatnonzero(near):
                b = other[k]
                if find(a[1]) != find(b[1]) and (j := _similar(own(a), own(b))) >= threshold:
                    root[find(a[1])] = find(b[1])
                    yield a[0], b[0], j

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])
        for batch in batches:
            out = []
            for t, band, side, tid, label, bands, text in zip(*(batch.column(c).to_pylist() for c in ("task", "band", "side", "tid", "label", "bands", "text"))):
                if (t, band) != task:
                    out += pairs(task[1], *sides) if task else ()
                    task, sides = (t, band), ([], [])
                sides[side].append((tid, label, np.array(bands, np.int64), text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LINKS_ARROW)], schema=LINKS_ARROW)
        if out := list(pairs(task[1], *sides)) if task else []:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), LINKS_ARROW)], schema=LINKS_ARROW)

    return run


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of left has in common with each of right."""
    sets = left if right is left else left + right
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        a, b = np.searchsorted(column, (low, low + WIDTH))
        has = np.zeros((len(sets), int(column[b - 1]) + 1 - low), np.float32)
        has[owner[a:b], column[a:b] - low] = 1
        out += has[: len(left)] @ has[len(sets) - len(right) :].T
    if right is left:
        np.fill_diagonal(out, [len(x) for x in sets])  # with those that no other set has
    return out


def _count(threshold: float):
    """Rows (task, side, tid, text), sorted by task, to (tid, n): the texts of the other side that a text is linked to.

    A task holds a block on each of sides 0 and 1, or one block, side ALONE, that is compared with itself.
    """

    def counts(sides: tuple) -> Iterator[pa.RecordBatch]:
        alone = bool(sides[ALONE])
        left, right = (sides[ALONE], sides[ALONE]) if alone else sides[:2]
        if not left or not right:
            return
        (a, x), (b, y) = zip(*left), zip(*right)
        x = list(x)
        y = x if alone else list(y)
        both = in_common(x, y)
        near = both / (np.array([[len(s)] for s in x]) + np.array([len(s) for s in y]) - both) >= threshold
        if alone:
            np.fill_diagonal(near, False)
        for tids, n in ((a, near.sum(1)),) if alone else ((a, near.sum(1)), (b, near.sum(0))):
            yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(n, pa.int64())], schema=COUNTS_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [], [])
        for batch in (b for whole in batches for b in words.slices(whole)):
            tasks, places, tids = (batch.column(c).to_pylist() for c in ("task", "side", "tid"))
            for t, side, tid, own in zip(tasks, places, tids, shingle_sets(batch.column("text").to_pylist())):
                if t != task:
                    yield from counts(sides)
                    task, sides = t, ([], [], [])
                sides[side].append((tid, own))
        yield from counts(sides)

    return run


def components(links: DataFrame, scratch: Scratch, name: str = "labels") -> DataFrame:
    """(tid, label) for every end of links (a, b); label is the least tid of its component.

    Large-star and small-star steps in turn until every edge points to the least of its component. Each
    step is written, so that plans stay small and a join with a hub of very many edges can be split.
    """
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), f"{name}-edges")
    last = ["edges"]
    for k in itertools.count():
        least = scratch.keep(both(edges).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least-{k}")
        large = both(edges).join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        lower = scratch.keep(large.distinct(), f"{name}-lower-{k}")
        small = scratch.keep(lower.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small-{k}")
        moved = lower.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(moved.unionByName(small.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), f"{name}-after-{k}")
        # a star forest: no lower end is an upper end of another edge, and every upper end has one edge
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        for old in (*last, f"least-{k}", f"lower-{k}", f"small-{k}"):
            scratch.drop(f"{name}-{old}")
        last = [f"after-{k}"]
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("low").alias("low")).filter("up > 1 or up = 1 and low = 1").isEmpty():
            break
    return edges.select(F.col("u").alias("tid"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("tid"), F.col("v").alias("label")).distinct())


def find_links(texts: DataFrame, scratch: Scratch, bands: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between distinct texts that share a band, as many as connect the classes; and (tid, text) of each text that may have links.

    texts: (tid, text), with copies; bands: (tid, bands), one row for each distinct text.
    """
    rows = bands.select("tid", F.posexplode("bands").alias("band", "bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.keep(rows.join(sizes, "bucket"), "members")
    weights = members.groupBy("tid").agg(F.sum("size").alias("weight"))
    reps = texts.join(weights.select("tid"), "tid", "left_semi").groupBy("tid").agg(F.first("text").alias("text"))
    reps = scratch.keep(reps, "reps")
    left = scratch.keep(members.select("bucket", "tid").join(weights, "tid"), "left-0")
    verified: DataFrame | None = None
    for k in range(ROUNDS):
        pivots = left.groupBy("bucket").agg(F.max(F.struct("weight", "tid")).alias("p"), F.count("*").alias("n")).filter("n > 1").select("bucket", F.col("p.tid").alias("pivot"))
        # written, so that the join below is of plain exchanges, and a bucket of very many texts can be split
        pivots = scratch.keep(pivots, f"pivots-{k}")
        against = scratch.keep(left.join(pivots, "bucket").filter("tid != pivot"), f"against-{k}")
        pairs = against.select(F.col("tid").alias("a"), F.col("pivot").alias("b")).distinct()
        found = scratch.keep(_texts(pairs, reps).transform(lambda d: map_arrow(d, _verify(threshold), LINKS)), f"links-{k}")
        verified = found if verified is None else verified.unionByName(found)
        linked = found.select(F.col("a").alias("tid"), F.col("b").alias("pivot"))
        left = scratch.keep(against.join(linked, ["tid", "pivot"], "left_anti").select("bucket", "tid", "weight"), f"left-{k + 1}")
        scratch.drop(f"left-{k}")
        scratch.drop(f"against-{k}")
        scratch.drop(f"pivots-{k}")
    # what the pivots left unconnected: the texts of buckets with several classes, in blocks. Pairs of
    # blocks are dealt by the blocks' numbers and never gathered
    labels = components(verified, scratch, "first")
    placed = members.select("bucket", "band", "tid", "size").join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    mixed = placed.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = placed.join(mixed, "bucket", "left_semi").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = dealt.select("bucket", "band", "tid", "label", "block", other).select(
        F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "band", (F.col("block") > F.col("other")).cast("int").alias("side"), "tid", "label"
    )
    work = tasks.join(reps, "tid").join(bands, "tid").select("task", "band", "side", "tid", "label", "bands", "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = map_arrow(work.repartition(parts, "task").sortWithinPartitions("task", "band"), _blocks(threshold), LINKS)
    return verified.unionByName(scratch.keep(more, "links-rest")), reps


def count_links(found: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(tid, n_links) of the texts of classes of several: how many other texts each is linked to.

    found: rows of classes; reps: (tid, text). The texts of a class are dealt to blocks by hash, and every two blocks of it are a task.
    """
    blocks = F.ceil(F.greatest(F.col("n_texts") / BLOCK, F.col("n_bytes") / BLOCK_BYTES)).cast("int")
    dealt = found.filter("n_texts > 1").select("tid", "label", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    side = F.when(F.col("block") == F.col("other"), ALONE).otherwise((F.col("block") > F.col("other")).cast("int"))
    tasks = dealt.join(reps, "tid").select("label", "tid", "block", "text", other)
    tasks = tasks.select(F.xxhash64("label", F.least("block", "other"), F.greatest("block", "other")).alias("task"), side.alias("side"), "tid", "text")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = map_arrow(tasks.repartition(parts, "task").sortWithinPartitions("task"), _count(threshold), COUNTS)
    return counts.groupBy("tid").agg(F.sum("n").alias("n_links"))


def _texts(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    with_b = pairs.join(reps.select(F.col("tid").alias("b"), F.col("text").alias("text_b")), "b")
    return with_b.join(reps.select(F.col("tid").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")


def _keyed(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("tid"))


def classes(docs: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(tid, label, class_id, n_copies, n_texts, n_bytes) of every distinct text, and (tid, text) of each that may have links; tid is xxhash64 of the text."""
    base = _keyed(docs)
    texts = base.select("tid", "text")
    signed = map_arrow(texts, _sign(band_count(threshold, rows, recall, COMMON), rows), BANDS)
    bands = scratch.keep(signed.groupBy("tid").agg(F.first("bands").alias("bands")), "bands")
    links, reps = find_links(texts, scratch, bands, threshold)
    scratch.drop("bands")
    labels = components(links, scratch).withColumn("linked", F.lit(True))
    ids = base.groupBy("tid").agg(F.min("doc_id").alias("low"), F.count("*").alias("n_copies"), F.max(F.octet_length("text")).alias("bytes"))
    known = ids.join(labels, "tid", "left").withColumn("label", F.coalesce("label", "tid"))
    tops = known.filter("linked").groupBy("label").agg(F.min("low").alias("class_low"), F.count("*").alias("n_texts"), F.sum("bytes").alias("n_bytes"))
    found = known.join(tops, "label", "left").select(
        "tid", "label", F.coalesce("class_low", "low").alias("class_id"), "n_copies", F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"), F.coalesce("n_bytes", "bytes").cast("long").alias("n_bytes")
    )
    return scratch.keep(found, "classes"), reps


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_copies and n_texts of every row of docs (doc_id, text).

    class_id is the least doc_id of the row's class: texts that are equal, or linked, over any number
    of steps, by a Jaccard similarity of five-word shingles of at least threshold. n_links counts the
    other texts of that similarity to the row's (equal texts are one, so copies are not expanded),
    n_copies the rows with the same text, n_texts the distinct texts of the class. A text of one to four words is one shingle; texts without words, null ones among them, are
    linked to nothing but their copies. Null doc_ids take no part in choosing class_id; a class of
    them alone has null. Repeated rows are copies. Distinct texts are told apart by a 64-bit hash. Texts
    are read whole, other columns are not read, and an empty table gives an empty result. A pair at the
    threshold comes into one class with a probability of recall or more; within a class all pairs are
    compared, on full sets.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    found, reps = classes(docs, scratch, threshold, rows, recall)
    counts = scratch.keep(count_links(found, reps, threshold), "counts")
    known = found.join(counts, "tid", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    return _keyed(docs).select("doc_id", "tid").join(known, "tid").select("doc_id", "class_id", "n_links", "n_copies", "n_texts")


def keep_one(docs: DataFrame, **settings) -> DataFrame:
    """docs with one row of each class of near duplicates, that of the least doc_id."""
    tid, label, least = (free_name(docs, n) for n in ("_tid", "_label", "_class"))
    found = classes(docs, Scratch(docs.sparkSession, "jaccard"), **settings)[0].select(F.col("tid").alias(tid), F.col("label").alias(label), F.col("class_id").alias(least))
    own = lambda d: d.join(found, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(tid)).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(least)))
    kept = own(docs)
    # rows that share the least doc_id of a class: told from narrow columns, as texts rarely need a second shuffle
    if not own(docs.select("doc_id", "text")).groupBy(label).count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([label])
    return kept.select(*(f"`{c}`" for c in docs.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
