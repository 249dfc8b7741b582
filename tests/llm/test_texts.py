"""Operators on texts against brute force."""

from __future__ import annotations

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegrain.llm import decontaminate, jaccard, lm_score, packing, quality, substring, words

from .conftest import SYLLABLES, prose


def altered(text: str, share: float, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(3)) if r.random() < share else w for w in text.split())


def shingle_set(text: str, k: int = 5) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


# ---------------------------------------------------------------- words


@given(st.lists(st.text(max_size=30), max_size=6))
def test_word_hashes(texts):
    split = [t.lower().split() for t in texts]
    h, counts = words.hash_words(split)
    assert counts.tolist() == [len(s) for s in split] and len(h) == counts.sum()
    by = {}
    for w, x in zip(itertools.chain(*split), h.tolist()):
        assert by.setdefault(w, x) == x
    assert len(set(by.values())) == len(by)
    s, runs = words.shingles(h, counts)
    assert runs.tolist() == [max(len(x) - 4, min(len(x), 1)) for x in split] and len(s) == runs.sum()


def test_shingles_are_sets_of_words():
    a, b = prose(1, 50), prose(1, 50) + " end"
    x, y = jaccard.shingle_sets([a, b])
    assert len(x) == len(shingle_set(a)) and len(np.intersect1d(x, y)) == len(shingle_set(a) & shingle_set(b))


# ---------------------------------------------------------------- near duplicates


def brute_classes(rows):
    texts = [t or "" for _, t in rows]
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = texts[i] == texts[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        if same and label[i] != label[j]:
            old, new = max(label[i], label[j]), min(label[i], label[j])
            label = [new if x == old else x for x in label]
    out = []
    for i in range(len(rows)):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        out.append(min(ids) if ids else None)
    return out


def test_near_duplicates(spark):
    base = [prose(s, 150) for s in range(6)]
    rows = [(k, altered(base[k % 6], (0.0, 0.01, 0.02, 0.04, 0.1)[k % 5], k)) for k in range(90)]
    rows += [(100 + k, prose(1000 + k, 30)) for k in range(20)]
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[d]["class_id"] for d, _ in rows] == brute_classes(rows)
    assert all((got[d]["n_links"] > 0 or got[d]["n_copies"] > 1) for d, _ in rows if got[d]["class_id"] != d)


def test_messy_near_duplicates(spark, messy, nothing):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    got = jaccard.near_duplicates(messy).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == Counter(zip((d for d, _ in rows), brute_classes(rows)))
    kept = jaccard.keep_one(messy)
    assert kept.columns == messy.columns and Counter(r["doc_id"] for r in kept.collect())[3] == 0 and kept.filter("doc_id = 1").count() == 1
    assert jaccard.near_duplicates(nothing).count() == 0 and jaccard.keep_one(nothing).count() == 0
    twice = messy.filter("doc_id = 3")
    assert jaccard.keep_one(twice).count() == 1


def test_band_count():
    n = jaccard.band_count(0.8, 4, 0.999)
    assert 1 - (1 - 0.8**4) ** n >= 0.999 > 1 - (1 - 0.8**4) ** (n - 1)
    p, n = 0.8**4, jaccard.band_count(0.8, 4, 0.999, 2)
    least = lambda n: 1 - (1 - p) ** n - n * p * (1 - p) ** (n - 1)
    assert least(n) >= 0.999 > least(n - 1)


def test_blocks_take_over_from_pivots(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    base = prose(7, 200)
    rows = [(k, altered(altered(base, 0.06, k // 4), 0.005 * (k % 4), k)) for k in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[d] for d, _ in rows] == brute_classes(rows)


@pytest.mark.parametrize("block, size", [(512, 1 << 23), (3, 1 << 23), (512, 3000)])
def test_all_links_are_counted(spark, monkeypatch, block, size):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", size)
    base = [prose(s, 120) for s in (7, 8)]
    rows = [(k, altered(base[k % 2], 0.01 * (k % 3), k // 2)) for k in range(44)] + [(100, base[0].upper()), (101, "three plain words"), (102, "Three plain  words"), (103, None)]
    texts = {t for _, t in rows if t}
    sets = {t: shingle_set(t) for t in texts}
    links = {t: sum(u != t and len(x & sets[u]) >= 0.8 * len(x | sets[u]) for u in texts) for t, x in sets.items()}
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [got[d]["n_links"] for d, _ in rows] == [links.get(t, 0) for _, t in rows]
    # texts of one class that are not linked themselves, so that a count of the class would not do
    assert any(got[d]["n_links"] < got[d]["n_texts"] - 1 for d, _ in rows)


def test_common_shingles(monkeypatch):
    monkeypatch.setattr(jaccard, "WIDTH", 7)
    r = random.Random(5)
    sets = [np.array(sorted(r.sample(range(60), r.randint(1, 40))), np.uint64) for _ in range(9)]
    brute = lambda x, y: [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert jaccard.in_common(sets, sets).tolist() == brute(sets, sets)
    assert jaccard.in_common(sets[:4], sets[4:]).tolist() == brute(sets[:4], sets[4:])
    assert jaccard.in_common([sets[0]], [np.array([99], np.uint64)]).tolist() == [[0]]


def test_components(spark):
    from lodegrain.llm.common import Scratch

    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(12)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x["tid"]: x["label"] for x in jaccard.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got.get(x, x) == y for x, y in label.items())


# ---------------------------------------------------------------- passages


def brute_align(x, y):
    n, m = len(x), len(y)
    d = np.zeros((n + 1, m + 1), int)
    d[:, 0], d[0, :] = range(n + 1), range(m + 1)
    for i in range(n):
        for j in range(m):
            d[i + 1, j + 1] = min(d[i, j] + (x[i] != y[j]), d[i, j + 1] + 1, d[i + 1, j] + 1)
    return d[n, m]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
def test_alignment_is_optimal(x, y):
    pairs = substring.align(x, y)
    assert all(x[i] == y[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
    cost, (pi, pj) = 0, (-1, -1)
    for i, j in [*pairs, (len(x), len(y))]:
        cost += max(i - pi - 1, j - pj - 1)
        pi, pj = i, j
    assert cost == brute_align(x, y)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), min_size=2, max_size=25, unique=True))
def test_best_chain(points):
    points.sort()
    x, y = np.array(points).T
    chains = substring.chain(x, y, most_gap=1000)
    for c in chains:
        assert (np.diff(x[c]) > 0).all() and ((np.diff(y[c]) > 0).all() or len(set(y[c] - x[c])) == 1)
    best = np.ones(len(x))
    for j in range(len(x)):
        for i in range(j):
            if x[i] < x[j] and y[i] < y[j]:
                best[j] = max(best[j], best[i] + 1 - substring.GAP_COST * (x[j] - x[i] + y[j] - y[i]))
    score = lambda c: len(c) - substring.GAP_COST * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]])
    if best.max() > 1 + 1e-9:
        assert max(map(score, chains)) == pytest.approx(best.max())


def test_fenwick():
    tree, held, r = substring.Fenwick(30), [-np.inf] * 30, random.Random(1)
    for k in range(200):
        i, v = r.randrange(30), r.random()
        tree.raise_to(i, (v, k))
        held[i] = max(held[i], v)
        q = r.randrange(31)
        assert tree.below(q)[0] == max(held[:q], default=-np.inf)


def brute_stretches(pairs, least_words, identity):
    alike = []
    for i, (x0, y0) in enumerate(pairs):
        for j in range(i, len(pairs)):
            if (j + 1 - i) / (max(pairs[j][0] - x0, pairs[j][1] - y0) + 1) >= identity:
                alike.append((i, j))
    most = [(i, j) for i, j in alike if not any((a, b) != (i, j) and a <= i and j <= b for a, b in alike)]
    return [(pairs[i][0], pairs[j][0] + 1) for i, j in most if pairs[j][0] + 1 - pairs[i][0] >= least_words]


def test_stretches_against_brute_force():
    r = random.Random(9)
    for k in range(120):
        x = y = 0
        pairs = []
        for _ in range(r.randint(1, 12)):
            x, y = x + r.choice((0, 0, 1, 1, 2, 6)), y + r.choice((0, 0, 1, 1, 2, 6))
            for _ in range(r.randint(1, 9)):
                pairs.append((x, y))
                x, y = x + 1, y + 1
        for identity in (0.5, 0.8, 0.9):
            assert [s[:2] for s in substring.stretches(pairs, 8, identity)] == brute_stretches(pairs, 8, identity)


def test_long_seeds_make_a_row_each(spark, monkeypatch):
    """What long seeds add to the matches is one row each, so it grows in proportion to a group of texts that share a passage."""
    before, seen = substring.map_arrow, []

    def recorded(df, function, schema):
        out = before(df, function, schema)
        if schema == substring.CHAINS:
            seen.append((df.count(), out.filter("kind = 1 and from_place = 1").count()))
        return out

    monkeypatch.setattr(substring, "map_arrow", recorded)
    passage = prose(70, 45)
    counts = []
    for n in (20, 40):
        seen.clear()
        rows = [(k, f"{prose(1000 + k, 30)} {passage} {prose(2000 + k, 30)}") for k in range(n)]
        substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).count()
        (_, asked), (made, _) = seen
        assert 0 < made <= asked
        counts.append(made)
    assert counts[1] <= 2.3 * counts[0]


def test_stretches_of_one_chain(spark):
    long, line, first, second = prose(301, 100), prose(302, 14), prose(303, 60), prose(304, 60)
    rows = [
        (1, f"{prose(311, 30)} {long} {prose(312, 45)} {line} {prose(313, 30)}"), (2, f"{prose(314, 30)} {long} {prose(315, 45)} {line} {prose(316, 30)}"),
        (3, f"{prose(321, 30)} {first} {prose(322, 40)} {second} {prose(323, 30)}"), (4, f"{prose(324, 30)} {first} {prose(325, 40)} {second} {prose(326, 30)}"),
    ]
    texts = dict(rows)
    got = [(r["doc_id"], texts[r["doc_id"]][r["start_char"] : r["end_char"]]) for r in substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert {d for d, _ in got} == {2, 4}
    for d, passage in ((2, long), (4, first), (4, second)):
        inner = " ".join(passage.split()[1:-1])
        assert any(x == d and inner in piece for x, piece in got)


def test_planted_passages(spark):
    shared, fuzzy = prose(50, 70), prose(51, 100)
    rows = [(k, prose(k, 150)) for k in range(30)]
    place = lambda k, t: (k, f"{prose(100 + k, 40)}\n{t}\n{prose(200 + k, 40)}")
    rows += [place(40 + k, shared) for k in range(4)] + [place(60, fuzzy), place(61, altered(fuzzy, 0.08, 5)), place(70, prose(80, 45)), place(71, prose(80, 45))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring.find_passages(docs).collect()
    texts = dict(rows)
    assert {r["doc_id"] for r in got} == {41, 42, 43, 61} and all(r["from_doc_id"] in (40, 60) for r in got)
    for r in got:
        piece = texts[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert len(piece.split()) == r["n_words"]
        if r["doc_id"] < 50:
            assert shared.split()[3:-3] == piece.split()[piece.split().index(shared.split()[3]) :][: len(shared.split()) - 6]
    left = {r["doc_id"]: r["text"] for r in substring.remove_passages(docs).collect()}
    assert len(left) == len(rows) and left[40] == texts[40] and shared[30:200] not in left[41] and left[41].startswith(prose(141, 40)[:100])
    assert left[71] == texts[71]


def _passages(spark, rows):
    return {(r["doc_id"], r["from_doc_id"]): r["n_words"] for r in substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


@pytest.mark.parametrize("copies", [1, 12])
def test_passages_whose_parts_stand_earlier(spark, copies):
    """The first places of a passage's seeds lie in documents that hold parts of it; a later one holds all."""
    p = prose(1, 80).split()
    around = lambda k, t: (k, f"{prose(1000 + k, 60)} {t} {prose(5000 + k, 60)}")
    rows = [around(k * copies + j, " ".join(p[8 * k : 8 * k + 16])) for k in range(9) for j in range(copies)]
    assert _passages(spark, [*rows, around(500, " ".join(p)), around(600, " ".join(p))]) == {(600, 500): 80}


def test_passages_of_one_word(spark):
    got = _passages(spark, [(1, "word " * 40_000), (2, "word " * 39_999), (3, prose(1, 100))])
    assert got[2, 1] == 39_999 and {d for d, _ in got} == {1, 2}


def test_hot_seeds_are_linked(spark, monkeypatch):
    monkeypatch.setattr(substring, "_hot_seeds", lambda rows, seed, parts: (hot, 3))
    shared = prose(50, 70)
    rows = [(k, f"{prose(100 + k, 30)} {shared} {prose(300 + k, 30)}") for k in range(30)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([0] * 30), pa.array([t for _, t in rows])], names=["doc_id", "tie", "text"])
    h = Counter(x for b in substring._seed(50, 0.8)(iter([batch])) for x in b.column("h").to_pylist())
    hot = [x for x, n in h.items() if n == 30]
    assert len(hot) > 10
    assert {d for d, _ in _passages(spark, rows)} == set(range(1, 30))


@pytest.mark.parametrize(("words_", "share"), [(50, 0.18), (60, 0.2), (80, 0.2)])
def test_recall_of_changed_passages(spark, words_, share):
    r, rows = random.Random(words_), []
    for k in range(60):
        p = prose(10_000 * words_ + k, words_ + 2).split()
        changed = list(p)
        for i in r.sample(range(1, words_ + 1), round(share * words_)):
            changed[i] = f"zz{i}"
        rows += [(k, f"{prose(20_000 + k, 60)} {' '.join(p)} {prose(30_000 + k, 60)}"), (1000 + k, f"{prose(40_000 + k, 60)} {' '.join(changed)} {prose(50_000 + k, 60)}")]
    got = {d for d, _ in _passages(spark, rows)}
    assert got <= set(range(1000, 1060)) and len(got) >= 0.9 * 60


def test_verbatim_passages_against_brute_force(spark):
    """Runs of 50 words that stand in an earlier document lie in passages: nearly all as a whole, and the
    rest, where a passage goes on by a few words in another document, by half at least."""
    r = random.Random(8)
    pool = [prose(600 + k, r.choice((8, 15, 30, 55, 90))) for k in range(14)]
    rows = [(k, " ".join(x for _ in range(4) for x in (prose(9000 + 10 * k + _, r.randint(3, 25)), r.choice(pool), r.choice(pool)))) for k in range(60)]
    texts = dict(rows)
    held: dict[int, list[tuple[int, int]]] = {}
    for x in substring.find_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect():
        held.setdefault(x["doc_id"], []).append((x["start_char"], x["end_char"]))
    seen: set[tuple] = set()
    total = missed = 0
    least = 50
    for d, text in sorted(texts.items()):
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        own = text.lower().split()
        runs = [tuple(own[i : i + 50]) for i in range(len(own) - 49)]
        for i, run in enumerate(runs):
            if run in seen:
                total += 1
                a, b = spans[i][0], spans[i + 49][1]
                missed += not any(p <= a and b <= q for p, q in held.get(d, []))
                least = min(least, sum(any(p <= x and y <= q for p, q in held.get(d, [])) for x, y in spans[i : i + 50]))
        seen.update(runs)
    assert total > 200 and missed <= 0.03 * total and least >= 25


def test_messy_passages(spark, messy, nothing):
    got = substring.find_passages(messy).collect()
    assert {r["doc_id"] for r in got} == {3}
    out = substring.remove_passages(messy)
    assert out.columns == messy.columns
    left = Counter(r["doc_id"] for r in out.collect())
    assert left == Counter({k: v for k, v in Counter(r["doc_id"] for r in messy.collect()).items() if k != 3})
    assert substring.find_passages(nothing).count() == 0 and substring.remove_passages(nothing).count() == 0


# ---------------------------------------------------------------- decontamination

ITEM = "Bob has 3 apples and gives 2 apples to Ann so how many apples does Bob have left now please tell."


def test_templates(spark):
    docs = [
        (1, "intro words here. " + ITEM + " end"),
        (2, "intro words. Tom has 12 apples and gives 5 apples to Mary so how many apples does Tom have left now please tell. end"),
        (3, "intro words. Tom has 12 apples and gives 5 apples to Mary so how many apples does Sue have left now please tell. end"),
        (4, "Tom has 12 apples and gives 5 oranges to nobody at all"), (5, None), (6, ""), (7, prose(1, 300)), (8, ITEM.upper()),
    ]
    items = [(7, ITEM), (8, None), (9, ""), (10, ITEM), (11, "short one")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["kind"], r["conflicts"]) for r in found}
    assert set(got) >= {(1, 7), (1, 10), (2, 7), (2, 10)} and not {d for d, _ in got} & {4, 5, 6, 7}
    assert got[1, 7] == ("copy", 0.0) and got[2, 7] == ("other values", 0.0)
    assert (3, 7) not in got or got[3, 7][1] > 0


def _leaks(spark, docs, items):
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.find_leaks(*frames).collect()}


def test_items_of_placeholders_and_other_scripts(spark):
    items = [
        (1, "Bob paid $5 and Ann paid $7, Tom paid $9, Sue paid $11."), (2, "Ann 3 kg Bob 4 kg Tom 5 kg Sue 6 kg"),
        (3, "Сколько яблок осталось у мальчика Иван если он купил 12 яблок и отдал 5 яблок своей сестре Мария вчера вечером"),
    ]
    docs = [(k, f"{prose(700 + k, 40)} {t} {prose(800 + k, 40)}") for k, t in items]
    docs += [
        (10, f"{prose(70, 40)} {items[2][1].replace('Иван', 'Пётр').replace('Мария', 'Ольга').replace('12', '30')} {prose(71, 40)}"),
        (11, f"{prose(72, 40)} Max 7 kg Eva 8 kg Kim 9 kg Joe 2 kg {prose(73, 40)}"),
    ]
    assert _leaks(spark, docs, items) == {(1, 1): "copy", (2, 2): "copy", (3, 3): "copy", (10, 3): "other values"}


def test_the_best_place_of_an_item_decides(spark):
    item = "Bob has three red apples and gives them to his friend, then Bob buys five green pears for his mother, so Bob asks how many fruits does Bob hold at home today"
    part = " ".join(item.replace("Bob", "Tom").split()[:18])
    docs = [(1, f"{prose(1, 50)} {part} {prose(2, 30)} {item} {prose(3, 20)}"), (2, f"{item} {prose(4, 30)} {part}"), (3, f"{part} {prose(5, 60)}"), (4, f"{item.replace('Bob', 'Max')} {prose(6, 30)} {item}")]
    assert _leaks(spark, docs, [(9, item)]) == {(1, 9): "copy", (2, 9): "copy", (4, 9): "copy"}


def test_first_code_points():
    found = ["a", "Ä", "Ж", "Ế", "中", "𐐀", "😀", "9"]
    data, starts, _, _ = words.spans([found])
    assert decontaminate._first_points(data, starts).tolist() == [ord(c) for c in found]


def test_leaks_against_brute_force(spark):
    items = [(k, prose(500 + k, 40)) for k in range(12)]
    docs = [(k, " ".join([prose(k, 60), items[k % 12][1] if k % 3 == 0 else " ".join(items[k % 12][1].split()[5:12]), prose(900 + k, 60)])) for k in range(60)]
    want = {(d, i) for d, t in docs for i, x in items if len(shingle_set(x) & shingle_set(t)) >= 0.8 * len(shingle_set(x))}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) == 20


def test_messy_leaks(spark, messy, nothing):
    bench = spark.createDataFrame([(1, " ".join(prose(2, 120).split()[20:60])), (None, None)], "item_id long, text string")
    found = decontaminate.find_leaks(messy, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 1), (3, 1)]
    out = decontaminate.clean(messy, bench)
    assert out.columns == messy.columns and out.count() == messy.count() - 3
    assert decontaminate.find_leaks(nothing, bench).count() == 0 and decontaminate.clean(messy, bench.filter("item_id > 9")).count() == messy.count()


# ---------------------------------------------------------------- packing


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


ODD = ["", " ", "a  b", " x", "x ", "a\n b", "a \nb", "a b\nc d.\n\ne f", "中文 b", "x　y", "<|endoftext|> a b", "a b  c", "x.. y!!\nZ's' 1.5% 3²,", "a\r\nb c", "it's we'll 'quoted' x'", "ªº ǅ ẞ", "\x1c a\x85b"]


def test_encoder_gives_the_librarys_ids(tokenizer):
    encoder = packing.Encoder(packing.default_tokenizer())
    for text in [*ODD, prose(1, 500), prose(1, 500).replace(". ", ".\n")] * 2:
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é.,'\n\t 1!ß中  s", max_size=40))
def test_encoder_on_any_text(text):
    encoder = packing._ENCODERS.setdefault("test", packing.Encoder(packing.default_tokenizer()))
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_encodes_all_new_words_at_once(tokenizer):
    encoder, calls = packing.Encoder(packing.default_tokenizer()), []
    fast = encoder.fast
    encoder.fast = lambda text: calls.append(text) or fast(text)
    text = prose(3, 600)
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) <= 2, len(calls)


@pytest.mark.parametrize("most", [1 << 25, 100])
def test_encoder_on_batches(tokenizer, most):
    encoder = packing.Encoder(packing.default_tokenizer())
    encoder.MOST = most
    texts = [None, *ODD, prose(1, 100), None, *ODD[::-1], prose(2, 100), ""] * 2
    for step in (1, 7, len(texts)):
        for at in range(0, len(texts), step):
            some = pa.array(["other", *texts], pa.string()).slice(1 + at, step)
            got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_all(some, b"\0\0").to_pylist()]
            assert got == [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for t in some.to_pylist()]
    assert len(encoder.encode_all(pa.array([], pa.string()))) == 0


def test_packing_cuts_batches_by_bytes(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 300)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 3})())}))
    texts = [prose(k, 1 + 37 * k % 120) if k % 5 else None for k in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(40), pa.int64()), "text": pa.array(texts, pa.string()), "source": ["a", "b"] * 20})
    rows = [r for out in packing._tokenise(packing.default_tokenizer(), 0)(iter([batch, batch.slice(0, 0), batch])) for r in out.to_pylist()]
    before = Counter()
    assert [r["doc_id"] for r in rows] == [*range(40)] * 2
    for r in rows:
        ids = [*tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 0]
        assert np.frombuffer(r["ids"], "<u2").tolist() == ids and (r["doc_tokens"], r["before"], r["part"]) == (len(ids), before[r["source"]], 3)
        before[r["source"]] += len(ids)


def check_pieces(rows, docs, tokenizer, window=1024):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert zlib.crc32(ids[r["start"] : at].tobytes()) == r["ids_crc32"]
        assert at == len(ids)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    spots = [s * window + o for s, o, _ in places]
    assert spots[0] == 0 and all(a + n == b for a, (_, _, n), b in zip(spots, places, spots[1:]))
    assert all(o + n <= window for _, o, n in places)


def test_packing_keeps_every_id_and_the_mixture(spark, tokenizer):
    docs = [(k, prose(k, 40 + 17 * k % 300), "big" if k % 3 else f"s{k % 4}") for k in range(120)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)).collect()
    check_pieces(rows, [(d, t) for d, t, _ in docs], tokenizer)
    total = Counter()
    for r in rows:
        total[r["source"]] += r["length"]
    n = sum(total.values())
    held = Counter()
    for r in rows:
        held[r["sequence_id"], r["source"]] += r["length"]
    for s in range(max(r["sequence_id"] for r in rows)):
        for source, t in total.items():
            assert abs(held[s, source] - 1024 * t / n) <= 2


def test_many_small_sources_keep_their_proportions():
    for totals in ({f"s{k}": 400 for k in range(600)}, {"hot": 10**5} | {f"s{k}": 2 * (1 + k) for k in range(400)}, {f"s{k}": 4 ** (k % 9) for k in range(30)}):
        for tail in (0, 70):
            plan = packing.Plan(totals, {s: float(n) for s, n in totals.items()}, tail, 1024)
            pieces = {s: list(plan.cut(s, 0, t)) for s, t in [*totals.items(), ("none of them", tail)]}
            got = sorted((place, n) for own in pieces.values() for _, n, place in own)
            whole = sum(totals.values()) + tail
            assert sum(n for _, n in got) == whole
            assert got[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))
            # in every quarter of the output a source has its share, to within what it has in a round of its tier at either end
            for s, t in totals.items():
                tier = plan.tiers[plan.queues[s][0]]
                own = t * tier.window / sum(p.length for p in tier.phases)
                for part in range(4):
                    lo, hi = part * whole // 4, (part + 1) * whole // 4
                    held = sum(max(0, min(place + n, hi) - max(place, lo)) for _, n, place in pieces[s])
                    assert abs(held - t / 4) <= 2 * min(own, 2 * packing.LEAST * packing.RANGE if plan.queues[s][0] else own) + 4
    shares = {f"s{k}": 1.0 + k % 7 for k in range(300)}
    plan = packing.Plan({s: 1000 for s in shares}, shares, 0, 1024)
    got = sorted((place, n) for s in shares for _, n, place in plan.cut(s, 0, 1000))
    assert sum(n for _, n in got) == 300_000 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:]))


def test_two_hundred_sources_within_a_token(spark, tokenizer):
    docs = [(k, prose(k, 60), f"s{k % 200}") for k in range(1000)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)).collect()
    check_pieces(rows, [(d, t) for d, t, _ in docs], tokenizer)
    total, held = Counter(), Counter()
    for r in rows:
        total[r["source"]] += r["length"]
        held[r["sequence_id"], r["source"]] += r["length"]
    n = sum(total.values())
    for s in range(max(r["sequence_id"] for r in rows)):
        assert all(abs(held[s, source] - 1024 * t / n) <= 2 for source, t in total.items() if 1024 * t / n >= 4)


def test_packing_with_sources_beyond_the_named(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "MOST_SOURCES", 3)
    docs = [(k, prose(k, 20 + 5 * (k % 9)), f"s{k % 9}") for k in range(90)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)).collect()
    check_pieces(rows, [(d, t) for d, t, _ in docs], tokenizer)


def test_packing_to_targets(spark, tokenizer):
    docs = [(k, prose(k, 200), "ab"[k % 2]) for k in range(40)]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), {"a": 3.0, "b": 1.0}, window=256).collect()
    check_pieces(rows, [(d, t) for d, t, _ in docs], tokenizer, 256)
    first = Counter()
    for r in rows:
        if r["sequence_id"] == 3:
            first[r["source"]] += r["length"]
    assert abs(first["a"] - 192) <= 2
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame(docs, "doc_id long, text string, source string"), {"a": 1.0})


def test_messy_packing(spark, messy, nothing, tokenizer):
    rows = packing.pack(messy).collect()
    assert sum(r["length"] for r in rows) == sum(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in messy.collect())
    assert {r["source"] for r in rows} == {"a", "b", "c", None}
    places = sorted((r["sequence_id"] * 1024 + r["offset"], r["length"]) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
    assert packing.pack(nothing).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(40, 5000), min_size=1, max_size=6), st.integers(8, 64))
def test_schedule_serves_all(totals, window):
    shares = [float(t) for t in totals] if min(totals) * window > 4 * sum(totals) else [1.0] * len(totals)
    if min(shares) * window < 4 * sum(shares):
        return
    phases = packing.schedule(totals, shares)
    taken = sorted((place, n) for j, t in enumerate(totals) for _, n, place in packing.cut(phases, j, 0, t, window))
    assert sum(n for _, n in taken) == sum(totals)
    assert taken[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(taken, taken[1:]))


# ---------------------------------------------------------------- quality


def brute_kneser_ney(trusted, order=quality.ORDER):
    """Probability function of an interpolated modified Kneser-Ney model over symbols, from dictionaries."""
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in trusted:
        s = quality.symbols(t).tolist()
        counts[order].update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = []
    for k in range(1, order + 1):
        of = Counter(counts[k].values())
        d = quality.discounts(of[1], of[2], of[3], of[4])
        total, held = Counter(), Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        tables.append((counts[k], d, total, held))

    def p(g):
        if not g:
            return 1 / quality.SYMBOLS
        c, d, total, held = tables[len(g) - 1]
        h, lower = g[:-1], p(g[1:])
        if h not in total:
            return lower
        n = c.get(g, 0)
        return (n - (d[min(n, 3) - 1] if n else 0)) / total[h] + held[h] / total[h] * lower

    return p


def test_perplexity_against_brute_force(spark):
    trusted = [prose(k, 25) for k in range(12)]
    others = [prose(99, 20), "ZZZ!! 中文", "", trusted[0]]
    from lodegrain.llm.common import Scratch

    scratch = Scratch(spark, "test")
    model = quality.Model(spark.createDataFrame([(t,) for t in trusted], "text string").repartition(3), scratch)
    rows = spark.createDataFrame([*enumerate(others), (1, others[1])], "row long, text string")
    p = brute_kneser_ney(trusted)
    for cache in (0, 50, 100_000):
        got = {r["row"]: r for r in quality.perplexities(rows, model, Scratch(spark, "test"), cache).collect()}
        for k, text in enumerate(others):
            s = quality.symbols(text).tolist()
            lp = sum(math.log10(p(tuple(s[i : i + quality.ORDER]))) for i in range(len(s) - quality.ORDER + 1))
            n = len(s) - quality.ORDER + 1
            assert n == len(text) + 1 + sum(ord(c) > quality.PLAIN for c in text)
            assert got[k]["symbols"] == n and got[k]["perplexity"] == pytest.approx(10 ** (-lp / n), rel=1e-9)


def test_code_points_share_no_symbols():
    codes = [*range(3, 0xD800), *range(0xE000, 0xF0000, 7)]
    assert len({tuple(quality.symbols(chr(c)).tolist()) for c in codes}) == len(codes)


def test_small_model_is_the_model():
    trusted = [prose(k, 25) for k in range(12)]
    keys, n = np.unique(np.concatenate([quality.grams(t) for t in trusted]), return_counts=True)
    model, p = quality.SmallModel(keys, n), brute_kneser_ney(trusted)
    for text in (prose(99, 20), "ZZZ!! 中文", "", trusted[0]):
        s = quality.symbols(text).tolist()
        want = [math.log10(p(tuple(s[i : i + quality.ORDER]))) for i in range(len(s) - quality.ORDER + 1)]
        assert model.log_probability(quality.grams(text)) == pytest.approx(want, rel=1e-9)


def test_spelt_words():
    some = ["a", "中文x", "", "Ärger", "😀", prose(3, 4)]
    keys, sizes = quality.spelt(some)
    assert np.concatenate([quality.grams(w) for w in some]).tolist() == keys.tolist() and sizes.tolist() == [len(quality.grams(w)) for w in some]


def test_ratios_of_words():
    models = [quality.SmallModel(*np.unique(quality.spelt(t.split())[0], return_counts=True)) for t in (prose(1, 300), prose(2, 300))]
    own = quality.Words(*models)
    texts = [prose(5, 30), "", "!! ?", prose(6, 20) + " a-b_c 中文"]
    want = []
    for t in texts:
        found = [quality.grams(w) for w in quality.WORD.findall(t.lower())]
        want.append(max((models[1].log_probability(g) - models[0].log_probability(g)).sum() for g in found) if found else None)
    assert [r is None for r in own.worst(texts)] == [w is None for w in want]
    assert own.worst(texts)[0] == pytest.approx(want[0]) and own.worst(texts)[3] == pytest.approx(want[3])


def test_commonest(spark):
    from lodegrain.llm.common import commonest

    counts = spark.createDataFrame([(k, 1 + k // 3) for k in range(300)], "key long, n long")
    assert {r["key"] for r in commonest(counts, 10).collect()} == set(range(291, 300))
    assert commonest(counts, 0).count() == 0 and commonest(counts, 1000).count() == 300


def test_model_is_normalised():
    p = brute_kneser_ney([prose(1, 30)])
    g = tuple(quality.symbols(prose(1, 30)).tolist()[10:14])
    assert sum(p((*g, c)) for c in range(quality.SYMBOLS)) == pytest.approx(1)


def test_cache_of_the_model():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 3000)
    cache = quality.Cache(keys, np.arange(3000.0))
    found, values = cache.look_up(np.concatenate([keys, keys + 1]))
    assert found[:3000].all() and (values[:3000] == np.arange(3000)).all() and not found[3000:].any()
    assert not quality.Cache(np.zeros(0, np.int64), np.zeros(0)).look_up(keys)[0].any()


def test_classifier_rejects_junk(spark, messy, nothing):
    docs = [(k, prose(k, 80), "en") for k in range(300)] + [(1000 + k, prose(k, 40).upper() + "!!", "en") for k in range(20)] + [(2000 + k, prose(3000 + k, 80), "en") for k in range(50)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)] + [(1000, 0, 0), (1, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = quality.classify(rows, labels).collect()
    assert len(got) == len(docs)
    assert not any(r["keep"] for r in got if 1000 <= r["doc_id"] < 2000)
    assert sum(r["keep"] for r in got if r["doc_id"] >= 2000) >= 46
    assert quality.classify(messy, labels).count() == messy.count()
    kept = quality.keep_good(messy, labels)
    assert kept.columns == messy.columns and kept.count() <= messy.count()
    assert quality.classify(nothing, labels).count() == 0
    assert quality.keep_good(messy, labels.filter("doc_id < -1")).count() == messy.count()


def test_classifier_rejects_toxic_words(spark):
    insults = ["worthless", "scumbag", "idiot"]

    def with_insults(seed):
        t = prose(seed, 300).split()
        return " ".join([*t[:100], insults[seed % 3], *t[100:200], insults[(seed + 1) % 3].upper() + "!", *t[200:]])

    docs = [(k, prose(k, 300), "en" if k % 2 else "fr") for k in range(300)] + [(1000 + k, with_insults(5000 + k), "en" if k % 3 else None) for k in range(60)] + [(2000 + k, prose(3000 + k, 300), "en") for k in range(50)]
    # only the first 30 toxic documents are labelled
    labels = spark.createDataFrame([(k, 1, 0) for k in range(300)] + [(1000 + k, 1, 1) for k in range(30)], "doc_id long, quality int, toxic int")
    got = quality.classify(spark.createDataFrame(docs, "doc_id long, text string, lang string"), labels).collect()
    assert len(got) == len(docs)
    assert all(r["toxic"] and not r["keep"] for r in got if 1000 <= r["doc_id"] < 2000)
    # a quantile of 30 documents that are held out of a language is their maximum
    assert sum(r["keep"] for r in got if r["doc_id"] >= 2000) >= 42 and sum(r["toxic"] for r in got if r["doc_id"] < 1000) <= 3


# ---------------------------------------------------------------- language model


def brute_base(docs):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [""]
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in docs}
    counts = Counter(w for d, t in docs if not held[d] for w in cut(t or ""))
    n, v = sum(counts.values()), len(counts)
    for d, t in docs:
        w = cut(t or "")
        yield d, held[d], len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)


@pytest.mark.parametrize("head", [50, 100_000])
def test_base_scores(spark, messy, head):
    docs = [(r["doc_id"], r["text"]) for r in messy.collect()] + [(20 + k, prose(k, 30)) for k in range(40)]
    got = lm_score.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), head).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(brute_base(docs), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD", 1500)
    docs = [(k, prose(k % 37, 40)) for k in range(200)]
    runs = []
    for parts in (1, 4, 16):
        rows = spark.createDataFrame(random.Random(parts).sample(docs, len(docs)), "doc_id long, text string").repartition(parts)
        runs.append({r["doc_id"]: r["score"] for r in lm_score.score_documents(rows).collect()})
    assert all(runs[0][k] == pytest.approx(r[k], rel=1e-6) for r in runs[1:] for k in runs[0])


def test_scores_are_those_of_the_weights():
    """All words of a small vocabulary, unknown ones included, have probabilities that sum to one."""
    r = random.Random(2)
    words_ = sorted({"".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(900)})
    v = lm_score.Vocabulary([("", 50), *((w, 40 - k // 30) for k, w in enumerate(words_))])
    n, classes = len(v), v.classes[: len(v)]
    in_head = np.bincount(classes, v.count + 0.5, lm_score.CLASSES)
    shares = (v.count + 0.5) / in_head[classes]
    unigram = (in_head + 0.5) / (in_head + 0.5).sum()
    state = lm_score.State(lm_score.Weights.start(unigram, np.log(shares)))
    again = lm_score.State.shaped(state.flat(), n)
    assert all((a == b).all() for a, b in zip(state.weights.all(), again.weights.all()))
    trainer = lm_score.Trainer(state, unigram, classes, shares, 3)
    code = np.array([r.randrange(n) for _ in range(4096)])
    target, one, two = lm_score._contexts([v.classes[code]])
    for _ in range(5):
        trainer.batch(target, one, two)
        k = np.flatnonzero(v.shared[code])
        k = k[np.argsort(target[k], kind="stable")]
        trainer.inner_batch(code[k], target[k], one[k])
    w = state.weights
    z = w.inner_table(classes)
    for c in (1 + lm_score.SINGLE + 3, 7):
        for k in np.unique(classes[v.shared[:n]])[:20]:
            own = np.flatnonzero(classes == k)
            lp = w.inner_q[own] @ w.inner_r[c] + w.inner_b[own] - z[k, c]
            assert np.exp(lp.astype(np.float64)).sum() == pytest.approx(1, rel=1e-4)


def test_words_within_a_class_are_learnt():
    """Two words of one class that follow different words are told apart by the second level."""
    pairs = [(f"x{k}", f"{'bcdfghkl'[k % 8]}{k}anto") for k in range(60)]
    v = lm_score.Vocabulary([("", 500), *((f"filler{k}", 400) for k in range(lm_score.SINGLE - 60)), *((a, 300) for a, _ in pairs), *((b, 60) for _, b in pairs)])
    n, classes = len(v), v.classes[: len(v)]
    shares = (v.count + 0.5) / np.bincount(classes, v.count + 0.5, lm_score.CLASSES)[classes]
    unigram = np.full(lm_score.CLASSES, 1 / lm_score.CLASSES)
    state = lm_score.State(lm_score.Weights.start(unigram, np.log(shares)))
    trainer = lm_score.Trainer(state, unigram, classes, shares, 3)
    r = random.Random(1)
    some = [r.choice(pairs) for _ in range(30_000)]
    word, own, before = (np.array(x) for x in zip(*((v.code[b.encode()], classes[v.code[b.encode()]], classes[v.code[a.encode()]]) for a, b in some)))
    assert len(np.unique(own)) == 1
    for at in range(0, len(word), 500):
        trainer.inner_batch(word[at : at + 500], own[at : at + 500], before[at : at + 500])
    w, z = state.weights, state.weights.inner_table(classes)
    lp = (w.inner_q[word] * w.inner_r[before]).sum(1) + w.inner_b[word] - z[own, before]
    assert lp.mean() > np.log(shares[word]).mean() + 1


def test_model_beats_the_unigram_on_held_out_text(spark):
    r = random.Random(4)
    one, two = ["".join(r.choice(SYLLABLES) for _ in range(2)) for _ in range(60)], ["".join(r.choice(SYLLABLES) for _ in range(3)) for _ in range(60)]
    docs = [(k, " ".join(r.choice(one if k % 2 else two) for _ in range(120))) for k in range(600)]
    got = lm_score.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).filter("held_out").collect()
    assert sum(x["score"] for x in got) > 0.95 * sum(x["base_score"] for x in got)
    assert sum(x["score"] > x["base_score"] for x in got) > 0.9 * len(got)


def test_empty_corpora(spark, nothing):
    assert lm_score.score_documents(nothing).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1)
    row = lm_score.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and math.isfinite(row["score"])


def test_class_probabilities_sum_to_one():
    w = lm_score.Weights.start(np.full(lm_score.CLASSES, 1 / lm_score.CLASSES), np.zeros(3))
    first, second, z = w.tables()
    p = np.exp(first[3] + second[7] - z[3, 7])
    assert p.sum() == pytest.approx(1, rel=1e-4)


def test_ending_classes_agree(spark):

    texts = ["a", "", ".,", "word", "word.", "été!!", "中文", "x y", "a%b$", "😀"]
    rows = spark.createDataFrame([(t,) for t in texts], "word string").select("word", lm_score._ending_column().alias("c")).collect()
    assert all(r["c"] == lm_score.ending_class(r["word"]) for r in rows)


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(k, prose(k, 120), "en", "ab"[k % 2]) for k in range(120)]
    item, shared = prose(7000, 40), prose(8000, 80)
    docs = good + [
        (500, good[3][1], "en", "a"), (501, altered(good[4][1], 0.01, 1), "en", "a"), (502, prose(1, 60).upper() + "!!", "en", "a"),
        (503, f"{prose(600, 60)} {item} {prose(601, 60)}", "en", "b"), (504, f"{prose(602, 60)} {shared} {prose(603, 60)}", "en", "b"), (505, f"{prose(604, 60)} {shared} {prose(605, 60)}", "en", "b"),
    ]
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in rows}
    assert not kept & {500, 501, 502, 503} and {504, 505} <= kept and len(kept & set(range(120))) >= 110
    tokens = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert tokens[505] < 0.8 * tokens[504]
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality_classifier" and corpus_pipeline.ORACLE_SQL is None
