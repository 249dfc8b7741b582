"""Sharding and fingerprints."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegrain.llm import fingerprint, sharding
from lodegrain.llm.common import literal_rows, rank_of

from .conftest import prose


def check_shards(rows, expected, shards=8):
    assert len(rows) == expected
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    assert set(by) <= set(range(shards))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_messy_shards(spark, messy, nothing):
    rows = sharding.shard_documents(messy).collect()
    check_shards(rows, messy.count())
    texts = {r["doc_id"]: r["text"] for r in messy.collect()}
    one = next(r for r in rows if r["doc_id"] == 1)
    assert one["size"] == len(texts[1].encode()) + 1 and one["text_crc32"] == zlib.crc32(texts[1].encode())
    assert next(r for r in rows if r["doc_id"] == 5)["size"] == 1
    assert sharding.shard_documents(nothing).count() == 0


def test_hot_text_is_cut_and_sizes_are_equal(spark):
    hot = prose(5, 60)
    rows = [(k, hot if k % 3 == 0 else prose(k, 20 + k % 50)) for k in range(2000)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    sizes = check_shards(out, 2000)
    assert max(sizes.values()) < 1.04 * min(sizes.values())
    groups = {}
    for r in out:
        groups.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in groups.values()) == 1
    again = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_equal_rows_are_spread(spark):
    rows = [(None, None)] * 900 + [(k, "some text"[: k % 9]) for k in range(100)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    sizes = check_shards(out, 1000)
    assert len(sizes) == 8 and max(sizes.values()) <= 1.05 * min(sizes.values()) + 9
    many = [(None, None)] * 9000 + [(k, "x") for k in range(100)]
    sizes = check_shards(sharding.shard_documents(spark.createDataFrame(many, "doc_id long, text string").repartition(4)).collect(), 9100)
    assert max(sizes.values()) <= 1.02 * min(sizes.values())


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(k, prose(k, 10)) for k in range(50)], "doc_id long, text string")
    placed = docs.join(sharding.shard_documents(docs, 4), "doc_id")
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).select("shard").distinct().count() == 4


@given(st.lists(st.integers(-50, 50), max_size=40), st.integers(1, 60))
def test_splitters_cover_samples(keys, ranges):
    samples = [(k, i, 1 + abs(k) % 3) for i, k in enumerate(keys)]
    splitters, hot = sharding.choose_splitters(samples, ranges)
    assert splitters == sorted(set(splitters)) and set(hot) <= set(splitters)


def test_rank_and_range_columns(spark):
    r = random.Random(1)
    cuts = sorted(r.sample(range(1000), 37))
    hot = {cuts[5]: [(10, 0), (20, 0), (20, 50)], cuts[20]: [(5, -3)]}
    cuts = sorted({*cuts, *(k + 1 for k in hot)})  # a hot key has a range of its own
    rows = [(k, t) for k in range(0, 1000, 7) for t in (0, 10, 15, 25)] + [(c, t) for c in cuts for t in (0, 10, 25)]
    got = spark.createDataFrame(rows, "key long, tie long").select("key", "tie", rank_of(F.col("key"), cuts).alias("r"), F.col("tie").alias("third"), sharding.range_column(F.col("key"), F.col("tie"), F.col("tie"), cuts, hot).alias("g")).collect()
    assert all(x["r"] == sum(c <= x["key"] for c in cuts) for x in got)
    ordered = sorted(got, key=lambda x: (x["key"], x["tie"]))
    assert [x["g"] for x in ordered] == sorted(x["g"] for x in ordered)
    assert literal_rows(spark, [(1, 2)], "a long, b int").first().asDict() == {"a": 1, "b": 2}


def test_fingerprints_of_neighbours(spark, messy):
    docs = messy.dropDuplicates(["doc_id"]).filter("doc_id is not null")
    found = {r["doc_id"]: r for r in fingerprint.compare_edited(docs).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    assert len(found) == len(rows)
    for k, (doc, text) in enumerate(rows):
        other, third = rows[(k + 1) % len(rows)][1], len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        r = found[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert found[1]["near_edited"] > 0.4 > found[1]["near_next"]


def test_messy_fingerprints(spark, messy, nothing):
    rows = fingerprint.compare_edited(messy).collect()
    assert len(rows) == messy.count()
    by = {}
    for r, t in ((r, t["text"]) for r in rows for t in messy.collect() if t["doc_id"] == r["doc_id"] == 3):
        by.setdefault(t, set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values())
    assert fingerprint.compare_edited(nothing).count() == 0


def test_many_ranges(spark):
    docs = spark.createDataFrame([(k * 3, prose(k, 12)) for k in range(300)], "doc_id long, text string").repartition(7)
    rows = {r["doc_id"]: r for r in fingerprint.neighbours(docs, 100).filter("not guest").collect()}
    texts = {k * 3: prose(k, 12) for k in range(300)}
    assert len(rows) == 300 and len({r["bucket"] for r in rows.values()}) > 8
    assert all(rows[d]["next_text"] == texts[(d - 3) % 900] for d in texts)


def test_homomorphism(spark):
    a, b, c = prose(1, 30), prose(2, 30), prose(3, 30)
    texts = [f"{a}\n{b}", f"{b}\n{a}", a, b, f"{a}\n{c}", c, f"{a}\n{a}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    fp = {r["k"]: r["fingerprint"] for r in fingerprint.fingerprints(rows, ["k"], "text").collect()}
    assert fp[0] == fp[1] == fingerprint.combine(fp[2], fp[3])
    assert fp[4] == fingerprint.combine(fingerprint.combine(fp[0], fp[3], -1), fp[5])
    assert fp[6] != fp[2] and len(set(fp.values())) == 6


@settings(max_examples=30)
@given(st.integers(0, (1 << 32) - 1), st.integers(0, (1 << 32) - 1))
def test_combine_inverts(x, y):
    width = 8 * fingerprint.EQUAL + 15 * fingerprint.WORDS + 10
    a, b = (f"{n:08x}" * (width // 8 + 1) for n in (x, y))
    a, b = a[:width], b[:width]
    assert fingerprint.combine(fingerprint.combine(a, b), b, -1) == a


def test_plans_have_no_python(spark, messy):
    for frame in (sharding.shard_documents(messy), fingerprint.compare_edited(messy)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("clash", ["rng", "slot"])
def test_clashing_names(spark, clash):
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.createDataFrame([(1, 1, 1, 1)], f"key long, tie long, size long, {clash} int"))
