"""Main text: parts of articles that look like furniture, hostile pages in linear time, and what the cut decides where names are missing."""

import re
import time

import pytest
from conftest import SF

from passages.llm import html_main_text as hmt

TEXT = "This is a paragraph, long enough to be text, that says something about the matter at hand."


def page(inside, around="<body>{}</body>"):
    return around.format(f"<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><article><h1>Title of it</h1><p>{TEXT}</p>{inside}<p>{TEXT}</p></article><footer>Copyright us</footer>")


@pytest.mark.parametrize("inside,more", [
    (f"<section class='discussion'><h2>Discussion</h2><p>{TEXT}</p></section>", f" Discussion {TEXT}"), (f"<section id='related-work'><h2>Related work</h2><p>{TEXT}</p></section>", f" Related work {TEXT}"),
    (f"<dialog open><p>{TEXT}</p></dialog>", f" {TEXT}"), (f"<dialog><p>{TEXT}</p></dialog>", ""), (f"<div class='comments'><p>{TEXT}</p></div>", ""),
    ("<p>The formula is <math><mi>x</mi><mo>=</mo><mn>2</mn></math>, as shown before, and that is all.</p>", " The formula is x=2, as shown before, and that is all."),
    (f"<object data='x.pdf'><p>{TEXT}</p></object>", f" {TEXT}"), ("<script>let a = '<p>no</p>';</script><style>p > a {}</style>", ""),
])
def test_parts_of_articles(inside, more):
    assert hmt.main_text(page(inside)) == f"Title of it {TEXT}{more} {TEXT}"


def test_article_in_an_open_dialog():
    assert hmt.main_text(page("", "<body><dialog open>{}</dialog></body>")) == f"Title of it {TEXT} {TEXT}"


@pytest.mark.parametrize("html", ["<p>x<select>" * 20_000, "<div>" * 5_000 + "</section>" * 20_000, "<div>" * 40_000 + "x", "<span class=ad>" * 20_000, "<form>" * 20_000, "<ul><li>" * 20_000, "<button>" * 30_000, "<script>" * 30_000])
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    hmt.main_text(html)
    assert time.process_time() - began < 2


def test_the_cut_decides_where_names_are_missing(spark):
    """Without classes, ids and roles, neighbours turn blocks that their own evidence gets wrong."""
    turned = blocks = 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        found, elements = hmt.blocks_of(re.sub(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", r.html or ""))
        longest = max((b.text.count(" ") + 1 for b in found if 2 * b.linked < len(b.text) and b.hint >= 0), default=0)
        turned += sum((hmt.evidence(b, longest) > 0) != kept for b, kept in zip(found, hmt.label(found, elements), strict=True))
        blocks += len(found)
    assert 0 < turned < 0.1 * blocks
