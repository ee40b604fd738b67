"""Statutes with nested levels, and visible text of pages."""

import time

import pytest

from ledgerloom.sources import files, statutes

DEEP = """<an:act xmlns:an="u"><an:docTitle>The  Act</an:docTitle><an:part><an:num>I</an:num><an:heading>Part <b>one</b></an:heading><an:title><an:heading>Title</an:heading>
<an:chapter><an:heading>Chapter</an:heading><an:subdivision><an:heading>Sub</an:heading><an:level><an:heading>Note</an:heading><an:level>
<an:article><an:num>Art.  12
a</an:num><an:paragraph><an:num>1</an:num><an:content><an:p>One &amp; two</an:p><an:p> </an:p></an:content></an:paragraph><an:p>three</an:p></an:article></an:level>
<an:article><an:heading>Own</an:heading><an:p>text</an:p></an:article></an:level></an:subdivision></an:chapter></an:title>
<an:article><an:num>Art. 14</an:num></an:article><an:article><an:num>Art. 15</an:num><an:p>last</an:p></an:article></an:part></an:act>"""


def test_articles_know_what_is_above_them(spark):
    rows = [("/l/SR-220.1-2024-DE.xml", DEEP.encode()), ("/l/SR_210/EN/a.xml", b"<act><article><p>only</p></article>"), ("/l/none.xml", b""), ("/l/null.xml", None), ("/l/b.xml", b"<act/>")]
    frame = spark.createDataFrame(rows, "path string, content binary")
    got = {(r["path"], r["n"]): r for r in statutes.article_rows(frame).collect()}
    first = got["/l/SR-220.1-2024-DE.xml", 0]
    assert (first["number"], first["heading"], first["chapter"], first["part"], first["paragraphs"], first["doc_title"]) == ("Art. 12 a", "Note", "Sub", "Title", ["One & two", "three"], "The  Act")
    second = got["/l/SR-220.1-2024-DE.xml", 1]
    assert (second["number"], second["heading"]) == ("Art. 2", "Own")
    assert ("/l/SR-220.1-2024-DE.xml", 2) not in got
    last = got["/l/SR-220.1-2024-DE.xml", 3]
    assert (last["heading"], last["chapter"], last["part"]) == ("", "", "Part one")
    assert got["/l/SR_210/EN/a.xml", 0]["paragraphs"] == ["only"] and got["/l/SR_210/EN/a.xml", None]["error"]
    assert not [k for k in got if k[0] == "/l/b.xml"]
    laws = spark.createDataFrame([("220.1", "de", "Gesetz", None)], "code string, lang string, title string, short string")
    passages = {r["binding_key"]: r["passage"] for r in statutes.statutes(frame, laws).collect()}
    assert passages == {
        "220.1_Art. 12 a": "passage: Gesetz (SR 220.1), Art. 12 a — Note: One & two three", "220.1_Art. 2": "passage: Gesetz (SR 220.1), Art. 2 — Own: text",
        "220.1_Art. 15": "passage: Gesetz (SR 220.1), Art. 15: last", "210_Art. 1": "passage: SR 210 (SR 210), Art. 1: only",
    }


def test_memory_does_not_grow_with_the_file():
    article = b"<article><num>Art. 1</num><p>" + b"x" * 1000 + b"</p></article>"
    deepest = 0
    walker = statutes.walk(b"<act>" + article * 20_000 + b"</act>")
    for n, _ in enumerate(walker, 1):
        deepest = max(deepest, len(walker.gi_frame.f_locals["handler"].done))
    assert n == 20_000 and deepest < 200


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>a &amp; b &#8364; &eacute; &copy</p>", "a & b € é ©"),
        ("x<script>var t = '</p>';</script>y<STYLE a=b>p{}</style >z", "x y z"),
        ("a<!-- <p>no --> b<br/>c", "a b c"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        ("a<script>open", "a"),
        ("", ""),
        (None, ""),
    ],
)
def test_visible_text(spark, html, text):
    assert files.markup_text(spark.createDataFrame([(1, html)], "page_id long, html string")).first()["text"] == text


@pytest.mark.parametrize("unit", ["<", "<script", "<script>", "<!--", "<a ", "</", "&", "<style>x", "<p>"])
def test_pages_are_read_in_linear_time(unit):
    began = time.time()
    files.visible(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 5
