"""Sharding by sampled splitters; DataFrame functions only.

Records are ordered by (key, tie, third), where third is a hash that tells rows of equal key and tie
apart. Size-weighted samples of that order give quantile boundaries, a key that spans several
boundaries gets ranges of its own that are cut along tie and third, and the exact bytes of every range then place each group of equal keys in the shard that holds its middle
byte. Only narrow rows are shuffled, and no range is larger than a small part of a shard.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, cumulative, literal_rows, rank_of

SCHEMA = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
LOWEST = -(1 << 63)


def choose_splitters(samples: list[tuple[int, int, int]], ranges: int) -> tuple[list[int], dict[int, list[tuple[int, int]]]]:
    """Key boundaries, and for a key with several boundaries the values of tie and third that cut it.

    samples: (key, tie, copies), a tie once for each key. A boundary b starts the range of keys >= b.
    Rows of equal key and tie are spread evenly over third, so several boundaries among them cut it evenly.
    """
    samples = sorted(samples)
    total = sum(s[2] for s in samples)
    hits: dict[int, list[tuple[int, int]]] = {}
    seen, at = 0, 1
    for key, tie, copies in samples:
        seen += copies
        own = 0
        while at < ranges and seen * ranges >= at * total:
            own += 1
            at += 1
        if own:
            hits.setdefault(key, []).extend((tie, LOWEST + (k << 64) // own) for k in range(own))
    keys: set[int] = set()
    hot: dict[int, list[tuple[int, int]]] = {}
    for key, cuts in hits.items():
        keys.add(key)
        if len(cuts) > 1:
            hot[key] = sorted(set(cuts))
            if key < (1 << 63) - 1:
                keys.add(key + 1)
    return sorted(keys), hot


def range_column(key: Column, tie: Column, third: Column, splitters: list[int], hot: dict[int, list[tuple[int, int]]]) -> Column:
    """Number of the range of a record; the ranges are numbered in the order of (key, tie, third)."""
    cuts = [hot.get(k, []) for k in splitters]
    first = [1 + n for n in cumulative([1 + len(c) for c in cuts])]
    r = rank_of(key, splitters)
    if not splitters:
        return F.lit(0)
    start = F.try_element_at(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), r)
    written = json.dumps([[{"t": t, "u": u} for t, u in c] for c in cuts])
    inner = F.try_element_at(F.from_json(F.lit(written), "array<array<struct<t:bigint,u:bigint>>>"), r)
    return F.when(r == 0, F.lit(0)).otherwise((start + F.size(F.filter(inner, lambda x: (x["t"] < tie) | (x["t"] == tie) & (x["u"] <= third)))).cast("int"))


def assign_shards(rows: DataFrame, shards: int = 8, ranges_per_shard: int = 128, rows_per_range: int = 1_000_000, samples_per_range: int = 16) -> DataFrame:
    """Add shard (sizes near equal) and slot (gapless from 0 in its shard) to rows.

    rows: key long, tie long, size long >= 0 and any other narrow columns. Equal keys stay together
    unless they fill more than about one range, which is 1/ranges_per_shard of a shard; then they are
    cut along tie, and rows that are equal in it too anywhere. Null keys and ties count as the lowest.
    Rows equal in key and tie get slots in any order. An empty input gives an empty result. A column
    called rng, shard, slot, before or third in the input raises ValueError. The driver holds about
    samples_per_range samples a range.
    """
    clash = {"rng", "shard", "slot", "before", "third"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns already there: {sorted(clash)}")
    spark = rows.sparkSession
    scratch = Scratch(spark, "sharding")
    key, tie = F.coalesce("key", F.lit(LOWEST)), F.coalesce("tie", F.lit(LOWEST))
    # written with the rows, so that it stays the same whatever is computed again
    base = scratch.keep(rows.withColumn("third", F.xxhash64(F.monotonically_increasing_id())), "rows")
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    if not n:
        return base.drop("third").withColumn("shard", F.lit(None).cast("int")).withColumn("slot", F.lit(None).cast("long"))
    total = max(1, total)
    ranges = max(shards * ranges_per_shard, -(-n // rows_per_range))
    # records of equal key and tie, of size z together, are drawn z * samples / total times on average; the draw depends on them alone
    share = F.col("size") * F.lit(ranges * samples_per_range / total)
    chance = F.pmod(F.xxhash64(F.lit("draw"), key, tie), F.lit(1 << 30)) / F.lit(float(1 << 30))
    grouped = base.groupBy(key.alias("key"), tie.alias("tie")).agg(F.sum("size").alias("size"))
    drawn = grouped.select("key", "tie", F.floor(share + chance).cast("long").alias("copies")).filter("copies > 0")
    splitters, hot = choose_splitters([tuple(r) for r in drawn.collect()], ranges)

    dealt = base.withColumn("rng", range_column(key, tie, F.col("third"), splitters, hot))
    found = {r["rng"]: r["bytes"] for r in dealt.groupBy("rng").agg(F.sum("size").alias("bytes")).collect()}
    last = max(found)
    offsets = cumulative([found.get(r, 0) for r in range(last + 1)])
    offset = F.element_at(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col("rng") + 1)
    in_order = Window.partitionBy("rng").orderBy(key, tie, "third")
    group = Window.partitionBy("rng", key)
    before = F.coalesce(F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = offset + F.min("before").over(group) + F.sum("size").over(group) / 2
    placed = dealt.withColumn("before", before).withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / total)).cast("int"))
    placed = scratch.keep(placed.drop("before"), "placed")
    scratch.drop("rows")
    counts = sorted((r["shard"], r["rng"], r["n"]) for r in placed.groupBy("rng", "shard").agg(F.count("*").alias("n")).collect())
    firsts, at = [], {}
    for shard, rng, c in counts:
        firsts.append((rng, shard, at.get(shard, 0)))
        at[shard] = at.get(shard, 0) + c
    # one row for each range and shard that it touches: at most ranges + shards, so broadcast is bounded
    starts = F.broadcast(literal_rows(spark, firsts, "rng int, shard int, first long"))
    number = F.row_number().over(Window.partitionBy("rng", "shard").orderBy(key, tie, "third")) - 1
    return placed.withColumn("slot", number.cast("long")).join(starts, ["rng", "shard"]).withColumn("slot", F.col("slot") + F.col("first")).drop("rng", "first", "third")


def write_shards(records: DataFrame, path: str) -> None:
    """Write records that carry shard and slot as one folder a shard, each sorted by slot across its files."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Documents dealt to shards of near-equal bytes (law `bytes`); equal texts lie next to each other.

    A null text has no bytes and size 1. Null doc_ids and repeated rows are kept, each with its slot.
    Texts are read whole, but only their length and hashes go on; other columns are not read. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("tie"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("key"),
    )
    return assign_shards(rows, shards).select(
        F.col("tie").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
