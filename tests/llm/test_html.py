"""Main text: layout wrappers, edges that decide, and deep nesting."""

import time

import pytest

from veilframe.llm import html_extract

LONG = "This sentence of the article is long enough to be read as one by anybody at all. " * 3
OTHER = "Something else that somebody wrote below it and that isn't part of the article. " * 2


@pytest.mark.parametrize("body", [
    '<div class="content-sidebar-wrap"><main><p>{0}</p></main><div class="sidebar"><p>{1}</p></div></div>',
    '<main class="content has-sidebar"><p>{0}</p></main><p class="ad">{1}</p>',
    '<article class="post comment-open"><p>{0}</p></article><section id="comments"><article class="comment"><p>{1}</p></article></section>',
    '<div id="layout-sidebar"><h1>{0}</h1></div><div class="comments"><p>{1}</p></div>',
])
def test_wrappers(body):
    assert html_extract.main_text("<nav><a href=x>Home</a></nav>" + body.format(LONG, OTHER)) == LONG.strip()


def test_long_comments_stay_out():
    assert html_extract.main_text(f"<main><p>{LONG}</p></main><div class='comments'>{f'<p>{OTHER}</p>' * 20}</div>") == LONG.strip()


def test_formulas_stay():
    assert html_extract.main_text(f"<article><p>{LONG}</p><p>so <math><mi>E</mi></math> holds</p></article>").endswith("so E holds")


def test_edges_decide():
    """A linked paragraph between paragraphs is content, the same one among links is not; its own costs say boilerplate."""
    link = "<p><a href=x>See the full report</a></p>"
    found = html_extract.blocks(f"<div><p>{LONG}</p>{link}<p>{LONG}</p></div><div>{link * 4}</div>")
    costs = [html_extract.costs(b) for b in found]
    alone = html_extract.minimum_cut([g for _, g in costs], [b for b, _ in costs], [])
    assert alone == [True, False, True, False, False, False, False]
    assert html_extract.label(found) == [True, True, True, False, False, False, False]


@pytest.mark.parametrize("piece", ["<div>x", "<span>x", "<b><p>x", "x</i>"])
def test_deep(piece):
    began = time.perf_counter()
    text = html_extract.main_text(piece * 20_000)
    assert text.count("x") == 20_000 and time.perf_counter() - began < 20
