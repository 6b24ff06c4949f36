"""The ratios find the article where no element or class name helps."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fieldstream.llm import page_text
from fieldstream.llm.queries import QUERIES

SENTENCES = ("The river rose in the night, and the bridge was closed.",
             "Nobody had seen it so high; the old men said so, too.",
             "By noon the boats were out: two of them, and a raft.")


def page(rng):
    """(html, article) of a page of plain ``div`` with classes that mean nothing."""
    def name():
        return "".join(rng.choice("bcdfghklmnpqrstvwz") for _ in range(5))

    paragraphs = [" ".join(rng.choices(SENTENCES, k=rng.randint(2, 6))) for _ in range(6)]
    items = [rng.choice(SENTENCES) for _ in range(3)]
    lines = ["A title of some words", *paragraphs[:3], "A heading", *items, *paragraphs[3:]]
    links = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(8))
    html = (f'<html><body><div class="{name()}"><ul>{links}</ul></div>'
            f'<div class="{name()}">Buy two, get one.</div>'
            f'<div class="{name()}"><h1>{lines[0]}</h1>'
            + "".join(f"<p>{p}</p>" for p in paragraphs[:3]) + "<h2>A heading</h2><ul>"
            + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
            + "".join(f"<p>{p}" for p in paragraphs[3:])
            + f'</div><div class="{name()}"><ul>{links}</ul></div>'
            f'<div class="{name()}">(c) by us. All rights reserved.</div></body></html>')
    return html, "\n".join(lines)


@pytest.mark.parametrize("seed", range(20))
def test_pages_without_helpful_names(seed):
    html, article = page(random.Random(seed))
    assert page_text.main_text(html)[0] == article
    # Without the ratios every path is content, and the menus come along.
    assert page_text.main_text(html, share=-1e9, least=-1e9)[0] != article


def unnamed(html):
    html = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", html)
    return html.replace('class="ad"', 'class="q7"')


def test_shipped_pages_without_their_names(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(200).collect()
    with_names = [page_text.main_text(r["html"])[0] for r in rows]
    without = [page_text.main_text(unnamed(r["html"]))[0] for r in rows]
    off = [page_text.main_text(r["html"], share=-1e9, least=-1e9)[0] for r in rows]
    assert sum(a == b for a, b in zip(with_names, without)) >= 0.8 * len(rows)
    assert not any(a == b for a, b in zip(with_names, off))


BODY = "<p>It was late, and it rained. Nobody came, of course.</p>"
TEXT = "It was late, and it rained. Nobody came, of course."


@pytest.mark.parametrize("html, text", [
    (f'<body><div class="content with-sidebar">{BODY}</div></body>', TEXT),
    (f'<body><div id=main class="no-comments">{BODY}</div></body>', TEXT),
    (f'<body><div class="post-share-story">{BODY}</div></body>', TEXT),
    (f"<body><form><article>{BODY}</article></form></body>", TEXT),
    (f"<body><h1>Title</h1>{BODY}<ul><li>One, two.</li></ul></body>", f"Title\n{TEXT}\nOne, two."),
    ("<article><p>So <math><mi>x</mi></math> is three, it says. Well.</p></article>",
     "So x is three, it says. Well."),
    ("<article><p>Seen, and read. <object>A map, drawn.</object></p></article>",
     "Seen, and read. A map, drawn."),
    (f"<article>{BODY * 3}</article><div class=comments>"
     + "<p>I think, this is wrong. Really, wrong. And so on.</p>" * 4 + "</div>",
     "\n".join([TEXT] * 3)),
    (f"<article>{BODY}<p hidden>Not shown, ever. No.</p></article>", TEXT),
])
def test_cases_that_names_alone_get_wrong(html, text):
    assert page_text.main_text(html)[0].replace("\n", " ") == text.replace("\n", " ")


def test_a_very_long_page_and_clashing_columns(spark):
    long = "<article>" + "".join(f"<p>{TEXT} {i}.</p>" for i in range(20_000)) + "</article>"
    df = spark.createDataFrame(
        [(1, "u", long, 5, "t"), (2, None, None, None, None), (2, "v", "", 1, "x")],
        "page_id long, url string, html string, n_paths int, text string")
    got = {(r["page_id"], r["url"]): r for r in page_text.extract(df).collect()}
    assert got[1, "u"]["text"].count("\n") == 19_999
    assert got[2, None]["text"] == got[2, "v"]["text"] == ""
    assert page_text.extract(df.where(F.lit(False))).count() == 0


def test_query_covers_all_pages(spark):
    sf = "/root/testdata/sf0.001"
    assert QUERIES["op1_page_text"](spark, sf).count() == spark.read.parquet(
        f"{sf}/pages.parquet").count()
