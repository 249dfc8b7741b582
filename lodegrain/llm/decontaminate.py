"""Benchmark decontamination by template windows.

Texts are canonicalised to templates: numbers, capitalised words (names) and units after a number
become typed placeholders. Windows of five template words are hashed and joined with those of the
benchmark. A document that holds at least a given share of an item's windows is a candidate, and its
slots, the words behind the placeholders, are then checked: every value of the item must stand for
one value in the document. So a question with other numbers and names is found as well as a copy.
An item may stand in a document several times; the matches along one diagonal, or a few neighbouring
ones, are one place of it, and the best place decides.

Windows of nearly nothing but placeholders fit too much text. They count only in items that have no
other windows, and then with their words as they are, so that of such items copies alone are found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import Scratch, map_arrow, small_join

WIDTH, LEAST_SHARE, LEAST_LITERAL, MOST_CONFLICTS = 5, 0.8, 3, 0.2
#: Bits of the table of the benchmark's windows: as many for each window, up to a table of 32 MB.
BITS_A_WINDOW, MOST_BITS = 64, 28
#: Words that may come or go within one place of an item, at least, and as a share of the item's windows.
SLACK, SLACK_SHARE = 4, 0.1
#: Unit words that become a placeholder after a number.
UNITS = "% $ € £ kg g mg lb lbs oz km m cm mm mi mile miles ft feet foot in inch inches yd yards l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents pound pounds km/h mph percent degrees °c °f w kw kwh v hz mb gb tb meter meters metre metres kilometer kilometers gram grams kilogram kilograms".split()
NUMBER, NAME, UNIT = (np.uint64(k) for k in (0xA11CE00000000001, 0xA11CE00000000002, 0xA11CE00000000003))
#: Which code points, up to the end of the supplementary multilingual plane, are capital letters, and which are digits.
CAPITAL = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x20000)])
DIGIT = np.array([chr(c).isdigit() for c in range(0x20000)])
_UNIT_HASHES = np.sort(words.hash_words([UNITS])[0])

HITS = "window long, row long, at int, words array<string>, slots long, rich boolean"
HITS_ARROW = pa.schema([("window", pa.int64()), ("row", pa.int64()), ("at", pa.int32()), ("words", pa.list_(pa.string())), ("slots", pa.int64()), ("rich", pa.bool_())])
FOUND = "row long, item long, windows long, kind string, conflicts double"
FOUND_ARROW = pa.schema([("row", pa.int64()), ("item", pa.int64()), ("windows", pa.int64()), ("kind", pa.string()), ("conflicts", pa.float64())])


def _first_points(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The code point at each start of UTF-8 bytes."""
    a, b, c, d = (data[np.minimum(starts + k, len(data) - 1)].astype(np.int64) for k in range(4))
    two, three = (a & 31) << 6 | b & 63, (a & 15) << 12 | (b & 63) << 6 | c & 63
    four = (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63
    return np.where(a < 0x80, a, np.where(a < 0xE0, two, np.where(a < 0xF0, three, four)))


def templates(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text, hashes of all template words and of the words themselves, slots (0 literal, 1 number, 2 name, 3 unit), counts.

    A word with a digit of any script is a number, one that begins with a capital letter of any script a name.
    """
    split = [t.split() for t in texts]
    lower = [t.lower().split() for t in texts]
    h, counts = words.hash_words(lower)
    data, starts, ends, _ = words.spans(split)
    if not len(h):
        return split, h, h, np.zeros(0, np.int64), counts
    total = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    points = np.minimum(_first_points(data, starts), len(CAPITAL) - 1)
    number = (total[ends] > total[starts]) | DIGIT[points]
    name = CAPITAL[points]
    opens = np.zeros(len(h), bool)
    firsts = np.cumsum(counts) - counts
    opens[firsts[counts > 0]] = True
    unit = np.isin(h, _UNIT_HASHES) & np.roll(number, 1) & ~opens
    slots = np.where(number, 1, np.where(unit, 3, np.where(name, 2, 0)))
    return split, np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h))), h, slots, counts


def windows(h: np.ndarray, own: np.ndarray, slots: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and place in the text of every window, and whether it has LEAST_LITERAL literal words.

    The hash is of template words h where there are enough, else of the words themselves, own. A text
    with fewer words than width has one window, all its words.
    """
    hashes, runs = words.shingles(h, counts, width)
    exact, _ = words.shingles(own, counts, width)
    place = words.inside(runs)
    text = np.repeat(np.arange(len(counts)), runs)
    first = np.repeat(np.cumsum(counts) - counts, runs) + place
    literal = np.concatenate(([0], np.cumsum(slots == 0)))
    size = np.minimum(counts[text], width)
    rich = literal[np.minimum(first + size, len(slots))] - literal[first] >= np.minimum(LEAST_LITERAL, size)
    return np.where(rich, hashes, words.mix(exact + np.uint64(1))), text, place, rich


def _rows(width: int, keep=None, bits: int = 0):
    """Rows (row, text) to windows; keep: a broadcast table of 2**bits bits of window hashes, others are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in words.slices(whole)):
            ids, texts = batch.column("row").to_numpy(zero_copy_only=False), batch.column("text").to_pylist()
            for s in words.chunks(texts):
                split, h, own, slots, counts = templates(texts[s])
                hashes, text, place, rich = windows(h, own, slots, counts, width)
                if keep is not None:
                    # the places are set for all windows of the text; only those that may match go on
                    top = (hashes >> np.uint64(64 - bits)).astype(np.int64)
                    hit = np.flatnonzero(keep.value[top >> 3] >> (top & 7).astype(np.uint8) & 1)
                    hashes, text, place, rich = hashes[hit], text[hit], place[hit], rich[hit]
                if not len(hashes):
                    continue
                starts = np.cumsum(counts) - counts
                code = [int(sum(int(x) << 2 * k for k, x in enumerate(slots[starts[t] + p : starts[t] + min(p + width, counts[t])]))) for t, p in zip(text.tolist(), place.tolist())]
                own = [split[t][p : p + width] for t, p in zip(text.tolist(), place.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids[s][text]), pa.array(place, pa.int32()), pa.array(own, pa.list_(pa.string())), pa.array(code, pa.int64()), pa.array(rich)], schema=HITS_ARROW)

    return run


def _consistent(matches: list[tuple[int, int, list[str], list[str], int]]) -> tuple[str, float]:
    """Kind and share of conflicting slots of matched windows (place in item, in document, words, words, slots).

    The place of each item slot in the document is the one on the commonest diagonal among its windows.
    """
    diagonal = Counter(d - i for i, d, *_ in matches)
    pairs: dict[int, tuple[int, str, str]] = {}
    for i, d, theirs, ours, code in sorted(matches, key=lambda m: diagonal[m[1] - m[0]]):
        for k in range(len(theirs)):
            if (kind := code >> 2 * k & 3) and k < len(ours):
                pairs[i + k] = (kind, theirs[k].strip(".,;:!?()\"'").lower(), ours[k].strip(".,;:!?()\"'").lower())
    if all(a == b for _, a, b in pairs.values()):
        return "copy", 0.0
    maps: dict[tuple[int, str], Counter] = defaultdict(Counter)
    for kind, a, b in pairs.values():
        maps[kind, a][b] += 1
    wrong = sum(sum(c.values()) - max(c.values()) for c in maps.values())
    return "other values", wrong / len(pairs)


def _places(matches: list[tuple], n: int, least: float) -> Iterator[list[tuple]]:
    """Matches of each place of the item in the document that holds least of its n windows; all matches if no place does.

    A place is what lies on a range of neighbouring diagonals, document less item, each taken once.
    """
    slack = max(SLACK, int(SLACK_SHARE * n))
    own = sorted(matches, key=lambda m: m[1] - m[0])
    diagonals = [m[1] - m[0] for m in own]
    held: Counter = Counter()
    end, last, found = 0, None, False
    for start, d in enumerate(diagonals):
        if d != last:
            while end < len(own) and diagonals[end] <= d + slack:
                held[own[end][0]] += 1
                end += 1
            if len(held) >= least:
                found = True
                yield own[start:end]
            last = d
        held[own[start][0]] -= 1
        if not held[own[start][0]]:
            del held[own[start][0]]
    if not found:
        yield matches


def _judge(most_conflicts: float, least_share: float):
    """Matched windows, sorted by row and item, to one row for each pair with consistent slots in its best place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, matches = None, []

        def close() -> Iterator[tuple]:
            if key is None:
                return
            best = None
            for place in _places(matches, key[2], least_share * key[2]):
                kind, conflicts = _consistent(place)
                if best is None or (conflicts, kind != "copy") < (best[1], best[0] != "copy"):
                    best = kind, conflicts
                if kind == "copy":
                    break
            if best[1] <= most_conflicts:
                yield key[0], key[1], len({m[0] for m in matches}), *best

        for batch in batches:
            out = []
            for row, item, n, i, d, theirs, ours, code in zip(*(batch.column(c).to_pylist() for c in ("row", "item", "n", "item_at", "at", "item_words", "words", "slots"))):
                if (row, item, n) != key:
                    out += close()
                    key, matches = (row, item, n), []
                matches.append((i, d, theirs, ours, code))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND_ARROW)], schema=FOUND_ARROW)
        if out := list(close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND_ARROW)], schema=FOUND_ARROW)

    return run


def _bit_table(theirs: DataFrame, count: int):
    """A broadcast bit table of the windows, and its bits: room for BITS_A_WINDOW bits a window, in a bounded table."""
    bits = min(MOST_BITS, max(16, (BITS_A_WINDOW * max(1, count)).bit_length()))
    cells = theirs.select(F.shiftrightunsigned("window", 64 - bits).alias("cell")).distinct()
    held = cells.groupBy(F.shiftright("cell", 3).alias("byte")).agg(F.sum(F.expr("shiftleft(1, cast(cell & 7 as int))")).cast("int").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 3), np.uint8)
    table[held["byte"].to_numpy()] = held["bits"].to_numpy()
    return theirs.sparkSession.sparkContext.broadcast(table), bits


def find_leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, least_share: float = LEAST_SHARE, most_conflicts: float = MOST_CONFLICTS) -> DataFrame:
    """Contaminated documents: doc_id, item_id, share, kind and conflicts, and row, a hash of doc_id and text.

    share: the part of the item's distinct windows, least_share or more, that the document holds; kind:
    `copy` where all slots are equal, else `other values`; conflicts: the share of slots whose value
    differs from what the same value of the item stands for elsewhere, in the place of the document where it
    is least. Null texts count as empty, and items without words leak into nothing. Repeated rows of
    documents give one result, equal items one each. Of a window that an item holds several times its
    first place counts. Items without a window of LEAST_LITERAL literal words are found as copies only.
    Texts of any length are read whole; other columns are not read; empty tables give an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "leaks")
    body = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), body.alias("text"), F.xxhash64(F.coalesce(doc_id, F.lit(-(1 << 63))), body).alias("row"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    # equal items share their windows
    texts = items.groupBy(F.xxhash64("text").alias("row")).agg(F.first("text").alias("text"))
    theirs = map_arrow(texts, _rows(width, None), HITS).select("window", F.col("row").alias("item"), F.col("at").alias("item_at"), F.col("words").alias("item_words"), "rich")
    # the first place of each window; poor windows only where an item has no others
    theirs = theirs.groupBy("window", "item").agg(F.min_by(F.struct("item_at", "item_words", "rich"), "item_at").alias("w")).select("window", "item", "w.*")
    all_windows = scratch.keep(theirs, "all-windows")
    have_rich = all_windows.groupBy("item").agg(F.max("rich").alias("has_rich"))
    theirs = scratch.keep(all_windows.join(have_rich, "item").filter("rich or not has_rich").drop("rich", "has_rich"), "windows")
    scratch.drop("all-windows")
    sizes = theirs.groupBy("item").agg(F.count("*").alias("n"))
    count = theirs.count()
    table, bits = _bit_table(theirs, count)
    hits = map_arrow(rows.select("row", "text"), _rows(width, table, bits), HITS).drop("rich")
    # a repeated row of documents gives each of its windows again
    matched = small_join(hits, theirs, ["window"], "inner", count, 50_000).dropDuplicates(["row", "item", "window", "at"])
    matched = scratch.keep(matched.drop("window"), "matched")
    held = matched.groupBy("row", "item").agg(F.count_distinct("item_at").alias("held"))
    enough = held.join(sizes, "item").filter(F.col("held") >= least_share * F.col("n"))
    enough = scratch.keep(enough.select("row", "item", "n", (F.col("held") / F.col("n")).alias("share")), "enough")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = matched.join(enough.select("row", "item", "n"), ["row", "item"]).repartition(parts, "row", "item").sortWithinPartitions("row", "item")
    found = map_arrow(candidates, _judge(most_conflicts, least_share), FOUND).join(enough, ["row", "item"])
    found = scratch.keep(found.select("row", "item", "share", "kind", "conflicts"), "found")
    named = found.join(items.select(F.xxhash64("text").alias("item"), "item_id"), "item")
    ids = rows.select("row", "doc_id").join(found.select("row").distinct(), "row", "left_semi").distinct()
    return named.join(ids, "row").select("doc_id", "item_id", "share", "kind", "conflicts", "row")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows into which an item leaks."""
    rows = find_leaks(docs, benchmark).select(F.col("row").alias("_row")).distinct()
    row = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.coalesce(F.col("text"), F.lit("")))
    return docs.join(rows, row == rows["_row"], "left_anti")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")
