"""Document fingerprints: a homomorphic multiset hash of paragraphs; DataFrame functions only.

Every paragraph (line) of a text is hashed to a wide vector, and a fingerprint is the sum of the
vectors, each lane modulo a power of two. The order of paragraphs plays no part, and inserting or
deleting a paragraph adds or subtracts its vector (``combine``). A vector has two parts:

* EQUAL lanes, 32 bits each, uniform hashes of the whole paragraph: these decide equality;
* COUNT lanes, 20 bits each, packed three to a word: how many runs of up to four words of the
  paragraph have a given hash bit set. With the number of runs they give, for two texts, the cosine
  of the sums of +-1 vectors, whose mean is the share of runs in common.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import literal_rows, rank_of

EQUAL, SHIFTS, SEEDS = 8, 20, 2
MASK = (1 << 0) | (1 << 20) | (1 << 40)
LANES = 3 * SHIFTS * SEEDS
RUN = r"(?:[^\s]+[^\S\n]*){1,4}"
LOWEST = -(1 << 63)
BUCKET_BYTES = 32 << 20
#: A fingerprint in hexadecimal: EQUAL words of 8 digits, then the packed counts of 15 digits, then the runs, 10 digits.
WORDS = SHIFTS * SEEDS


def _sums(paragraph: str, run: str, first: str) -> list[Column]:
    """Aggregates over the rows (paragraph, run of words); first: true on one row of each paragraph."""
    out = []
    for k in range(EQUAL // 2):
        h = F.xxhash64(F.lit(1000 + k), F.col(paragraph))
        low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32)
        for j, part in enumerate((low, high)):
            out.append(F.sum(F.when(F.col(first), part).otherwise(F.lit(0))).alias(f"e{2 * k + j}"))
    for seed in range(SEEDS):
        for s in range(SHIFTS):
            out.append(F.sum(F.shiftrightunsigned(F.col(f"h{seed}"), s).bitwiseAND(MASK)).alias(f"c{seed * SHIFTS + s}"))
    return [*out, F.sum(F.when(F.col(run).isNotNull(), 1).otherwise(0)).alias("runs")]


def _text_form() -> Column:
    """The summed lanes as hexadecimal digits; sums are taken modulo 2**32 and 2**60."""
    equal = [F.lpad(F.hex(F.col(f"e{k}").bitwiseAND(0xFFFFFFFF)), 8, "0") for k in range(EQUAL)]
    counts = [F.lpad(F.hex(F.col(f"c{k}").bitwiseAND((1 << 60) - 1)), 15, "0") for k in range(WORDS)]
    return F.lower(F.concat(*equal, *counts, F.lpad(F.hex(F.col("runs")), 10, "0")))


def _lane(packed: str, word: int, lane: int) -> str:
    return f"(shiftrightunsigned({packed}.c{word}, {20 * lane}) & 1048575)"


def _measured(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint, and packed: the counts, their sum and the square of the +-1 sums' length."""
    lanes = [(k, j) for k in range(WORDS) for j in range(3)]
    rows = rows.withColumn("own", F.struct(*(F.col(f"c{k}") for k in range(WORDS))))
    rows = rows.withColumn("total", F.expr(" + ".join(_lane("own", k, j) for k, j in lanes)))
    rows = rows.withColumn("square", F.expr(" + ".join(f"{_lane('own', k, j)} * {_lane('own', k, j)}" for k, j in lanes)))
    length = 4.0 * F.col("square") - 4.0 * F.col("runs") * F.col("total") + float(LANES) * F.col("runs") * F.col("runs")
    return rows.select(*keys, "fingerprint", F.struct(*(F.col(f"c{k}") for k in range(WORDS)), "runs", "total", length.alias("length")).alias("packed"))


def likeness(a: str, b: str, same: Column) -> Column:
    """Share of runs that two fingerprints have in common, 0 to 1, from their packed columns a and b.

    same: whether the fingerprints are equal, which gives 1. A text without runs is like no other.
    """
    dot = F.expr(" + ".join(f"{_lane(a, k, j)} * {_lane(b, k, j)}" for k in range(WORDS) for j in range(3)))
    n, m = F.col(f"{a}.runs"), F.col(f"{b}.runs")
    product = 4.0 * dot - 2.0 * m * F.col(f"{a}.total") - 2.0 * n * F.col(f"{b}.total") + float(LANES) * n * m
    norm = F.sqrt(F.col(f"{a}.length") * F.col(f"{b}.length"))
    return F.when(same, F.lit(1.0)).when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), product / norm))).otherwise(F.lit(0.0))


def combine(a: str, b: str, sign: int = 1) -> str:
    """Fingerprint of a text with the paragraphs of another added (sign 1) or taken away (sign -1)."""
    out, at = [], 0
    for digits, bits, n in ((8, 32, EQUAL), (15, 60, WORDS), (10, 40, 1)):
        for _ in range(n):
            x, y = int(a[at : at + digits], 16), int(b[at : at + digits], 16)
            out.append(f"{(x + sign * y) % (1 << bits):0{digits}x}")
            at += digits
    return "".join(out)


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row for each distinct keys with columns fingerprint and packed; keys must tell the rows apart.

    Rows of one key must already lie in one partition for this to need no shuffle. A null text counts
    as empty, which is one empty paragraph. Lanes count exactly up to 2**20 runs of a text; beyond
    that a carry blurs likeness a little, and equality still holds.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    paragraphs = rows.select(*keys, F.explode(F.split(body, "\n")).alias("paragraph"))
    runs = paragraphs.select(*keys, "paragraph", F.posexplode_outer(F.regexp_extract_all("paragraph", F.lit(RUN), F.lit(0))).alias("pos", "run"))
    hashed = runs.select(*keys, "paragraph", "run", F.coalesce(F.col("pos") == 0, F.lit(True)).alias("first"), *(F.when(F.col("run").isNull(), F.lit(0)).otherwise(F.xxhash64(F.lit(seed), F.rtrim("run"))).alias(f"h{seed}") for seed in range(SEEDS)))
    return _measured(hashed.groupBy(*keys).agg(*_sums("paragraph", "run", "first")).withColumn("fingerprint", _text_form()), keys)


def neighbours(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, next_text, and bucket and number, which tell the rows apart.

    The next document is the one before in doc_id, after the lowest comes the highest. Documents are
    dealt to ranges of doc_id by quantiles; each range also gets, as a guest, the first document of
    the range that follows, so that no row of a range needs another range. Equal doc_ids stand in
    order of their texts, null ones after all others; a null text counts as empty.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(LOWEST))
    total, n = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, min(n // 4, max(4 * parts, math.ceil(total / bucket_bytes))))
    cuts = base.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets))).first()[0] if buckets > 1 else []
    cuts = sorted(set(cuts or []))
    placed = base.withColumn("bucket", (F.lit(len(cuts)) - rank_of(key, cuts)).cast("int"))
    # the highest doc_id of every bucket: one row a bucket, and their number is bounded by the bytes of a bucket
    heads = sorted((r["bucket"], r["top"]) for r in placed.groupBy("bucket").agg(F.max(key).alias("top")).collect())
    if not heads:
        return base.select("doc_id", "text", F.col("text").alias("next_text"), F.lit(0).alias("bucket"), F.lit(0).alias("number"), F.lit(False).alias("guest"))
    goes = literal_rows(spark, [(top, heads[i - 1][0]) for i, (_, top) in enumerate(heads)], "top long, host int")
    tied = Window.partitionBy("host").orderBy(F.xxhash64("text"), "text")
    guests = base.withColumn("top", key).join(F.broadcast(goes), "top").withColumn("k", F.row_number().over(tied)).filter("k = 1").select("doc_id", "text", F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    rows = placed.withColumn("guest", F.lit(False)).select("doc_id", "text", "bucket", "guest").unionByName(guests)
    order = Window.partitionBy("bucket").orderBy("guest", key.desc(), F.xxhash64("text"), "text")
    return rows.select("doc_id", "text", "bucket", "guest", F.row_number().over(order).alias("number"), F.lead("text").over(order).alias("next_text"))


def edited(text: Column, other: Column) -> Column:
    """The last third of a text's code points replaced by as many (or all) first ones of other."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - third), F.substr(other, F.lit(1), third))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Repeated rows are kept. An empty table gives no rows. Texts without runs of words are like only
    texts with the same fingerprint.
    """
    rows = neighbours(docs).withColumn("edited", edited(F.col("text"), F.coalesce("next_text", F.lit(""))))
    keys = ["bucket", "number", "guest", "doc_id", "n_chars", "edited_sha256", "version"]
    both = rows.select(
        "bucket", "number", "guest", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))).alias("v"),
    ).select(*keys[:-1], "v.version", "v.body")
    found = fingerprints(both, keys, "body")
    order = Window.partitionBy("bucket").orderBy("number", "version")
    own = found.withColumn("own", F.struct("fingerprint", "packed"))
    paired = own.select(*keys, "fingerprint", "packed", F.lead("own", 1).over(order).alias("e"), F.lead("own", 2).over(order).alias("n")).filter("version = 0 and not guest")
    return paired.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("e.fingerprint").alias("edited_fingerprint"),
        likeness("packed", "e.packed", F.col("fingerprint") == F.col("e.fingerprint")).alias("near_edited"),
        likeness("packed", "n.packed", F.col("fingerprint") == F.col("n.fingerprint")).alias("near_next"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
