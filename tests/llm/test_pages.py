"""HTML extraction and WARC."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodegrain.llm import html_extract as H
from lodegrain.llm import warc

from .conftest import prose

GOOD = "The quick brown fox is at the house of the king and they were in it for all that it was."
CASES = [
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title &amp; more</h1><p>First.<p><b>Second\n line<br>goes &lt;on&gt;</b></article><footer>&copy; x</footer>", "Title & more\nFirst.\nSecond line goes <on>"),
    ("<script>var t='</p>';</script><style>p{}</style><!-- no --><p>" + GOOD, GOOD),
    (f"<header><h1>Site</h1></header><div id='cookie-banner'>{GOOD}</div><div class=content><h2>Hello</h2><p>{GOOD}<p>Short.<ul><li>one<li>two</ul></div><aside>{GOOD}</aside><div class='user-comments'><p>{GOOD}</div>", f"Hello\n{GOOD}\nShort.\none\ntwo"),
    (f"<main><header><h1>Head</h1></header><p>{GOOD}</p><form><p>Send</p></form><div class='ad'>Buy</div><section class=comments><article class=comment><p>{GOOD}</article></section></main>", f"Head\n{GOOD}"),
    ("<article><p>a<br><br>b</p><p> </p><p>c d</p></article>", "a\nb\nc d"),
    ("<article><p>&#233;&nbsp;x &unknown; &eacute;</p><p>1 < 2 & 3</p>", "é x &unknown; é\n1 < 2 & 3"),
    ("<div><a href=1>one</a> <a href=2>two</a></div><p>" + GOOD + "</p>", GOOD),
    ("plain words", "plain words"), ("", ""), (None, ""), ("<", "<"), ("<p", ""), ("<p title=\"unclosed>text", "text"),
    ("<article><table><tr><td>a</td><td>b</td></tr></table></article>", "a b"),
    ("<article><p hidden>x</p><p style='display:none'>y</p><p aria-hidden=true>w</p><p>z</p></article>", "z"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_extract(page, text):
    assert H.extract(page) == text


@given(st.text(alphabet="<>/pa \"'=!-&;b\n", max_size=60))
def test_any_markup_ends(page):
    H.extract(page)


def test_long_pages_are_linear():
    for piece in ("<p", "<a \"", "<p>a", "<!--", "&", "</p"):
        H.extract(piece * 60_000)


def test_extract_rows(spark):
    rows = [(1, "u", "<article><p>" + prose(1, 30) + "</article>", 1), (1, "u", "<article><p>" + prose(1, 30) + "</article>", 1), (None, None, None, 2), (2, None, "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = H.extract_pages(pages).collect()
    assert len(out) == 4 and all(r["n_chars"] == len(r["text"]) for r in out)
    assert H.extract_pages(pages.filter("page_id > 5")).count() == 0


PAGES = [(1, "http://a/1", prose(1, 400)), (2, "http://a/2\r\nX: y", prose(1, 400)), (5, None, prose(1, 400)), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", prose(1, 400)), (8, "ü", "é\r\n\r\nWARC/1.1" * 300), (9, "u", prose(2, 30_000)), (9, "u", prose(2, 30_000))]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, tmp_path, compress):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=2, compress=compress)
    out = warc.read_archives(spark, str(tmp_path / "w")).collect()
    want = []
    for page_id, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "").encode() == data and p is not None]
        revisit = len(data) >= 1000 and same and page_id != max(same)
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_records_keep_blocks(spark, tmp_path):
    pages = spark.createDataFrame([PAGES[0], PAGES[1]], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"), compress=False)
    found = [x for p in sorted((tmp_path / "w").glob("part-*")) for x in warc.records(p.read_bytes())]
    kinds = {h["warc-type"]: (h, b) for h, b in found}
    assert kinds["response"][1].endswith(PAGES[0][2].encode()) and kinds["revisit"][0]["warc-refers-to"] == "<urn:page:2>"
    assert "x" not in kinds["response"][0] and int(kinds["response"][0]["content-length"]) == len(kinds["response"][1])


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_archives_are_cut_by_bytes(spark, tmp_path):
    big = "y" * (3 << 20)
    rows = [(k, f"http://x/{k}", f"{k}{'z' * 40_000}") for k in range(12)] + [(100 + k, "http://b", f"{k}{big}") for k in range(3)] + [(None, "http://n", "small")] * 2
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"), compress=False, file_bytes=1 << 21)
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("part-*")]
    assert sum(s > 1 << 21 for s in sizes) == 3 and len(sizes) >= 3 + 6 + 1
    out = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"]) for r in out) == sorted((p is None, p or 0, len(h)) for p, _, h in rows)


@pytest.mark.parametrize("size", [64 << 20])
def test_a_page_of_64_mb(spark, tmp_path, size):
    rows = spark.range(2).selectExpr("id as page_id", "'http://x' as url", f"repeat('0123456789abcdef', {size // 16}) as html").coalesce(1)
    warc.write_archives(rows, str(tmp_path / "w"))
    out = {r["page_id"]: r for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert out[1]["record_type"] == "response" and out[0]["refers_to"] == 1 and out[0]["payload_bytes"] == out[1]["payload_bytes"] == size


def test_broken_archives():
    with pytest.raises(ValueError):
        list(warc.records(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.records(b"HTTP/1.1\r\n\r\n"))


def test_languages_without_known_stop_words():
    menu = "<ul><li><a href=/a>Prima</a></li><li><a href=/b>Seconda</a></li></ul>"
    story = "La pioggia cade sulla valle e il fiume sale piano, mentre i contadini guardano il cielo dalle case della collina."
    assert H.extract(f"<html><body>{menu}<div><p>{story}</p><p>Breve.</p></div><div>Tutti i diritti riservati 2024</div></body></html>") == f"{story}\nBreve."
    han = "雨落在山谷里，河水慢慢地上涨，农民们从山上的房子里看着天空，不知道明天会怎么样，但是他们都不害怕。" * 3
    assert H.extract(f"<body><div><a href=/>首页</a> <a href=/n>新闻</a></div><p>{han}</p><div>版权所有 © 2024</div></body>") == han
    other = "Zorbu klamenti vestora plinku, hastole mervinda crupal ostiren. Belmu karavent hosti plemidor vantes kurio melanta."
    assert H.extract(f"<body><div><a href=/>Hem</a></div><p>{other}</p><div>Rixtu 2024</div></body>") == other


def test_the_longer_part_is_the_main_one():
    story = "The main story of the day is that the river has risen and that the people of the town are waiting for it to fall again. " * 4
    page = f"<body><article class=card><h3>Teaser one</h3></article><article class=card><h3>Teaser two</h3></article><div id=content><p>{story}</p></div></body>"
    assert H.extract(page).split("\n")[-1] == story.strip() and "story" in H.extract(page)
    page = f"<body><article><p>{story}</p></article><div><p>Some of the readers have said that this is not what they were told by the town at all.</p></div></body>"
    assert H.extract(page) == story.strip()


def test_names_of_subjects_are_no_places():
    for name in ("share-price", "social-history"):
        text = "The price of the share has been falling for most of the week and it is not known when this will be over for the owners."
        assert H.extract(f"<body><div class='{name}'><p>{text}</p></div></body>") == text
    story = "The river has been rising for most of the week and it is not known when this will be over for the people of the town."
    assert H.extract(f"<body><p>{story}</p><div class='share-buttons'><p>Share this with all of your friends and with the people that you know from your work and from home.</p></div></body>") == story


def test_unmatched_tags_take_linear_time():
    import time

    for piece in ("<div><b>x</i>", "<b><div></b>", "<p><i>y</b></div>"):
        start = time.time()
        H.extract(piece * 20_000)
        assert time.time() - start < 5
