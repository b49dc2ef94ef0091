"""Broken and hostile markup."""

import time

import pytest

from salesops.llm import html_text

TEXT = "Words of the article go on for a while here and end now."


@pytest.mark.parametrize(("page", "want"), [
    (f"<p title=it's>{TEXT}</p><p>It is all there.</p>", f"{TEXT} It is all there."),
    (f"<div class=\"a\"\">{TEXT}</div>", TEXT),
    (f"<div class=\"a\" \"b\" 'c>{TEXT}</div>", TEXT),
    (f"<div title=\"a > b\" id='x>y'>{TEXT}</div>", TEXT),
    (f"<div title = \"never closed>{TEXT}</div><p>More</p>", f"{TEXT} More"),
    (f"<p>{TEXT}</p><a href='x", TEXT),
    (f"<p>{TEXT}</p><!-- open", TEXT),
    (f"<p>a < b and <3 c, {TEXT}</p>", f"a < b and <3 c, {TEXT}"),
    (f"<script>if (a</b) x = '<p>no</p>'</SCRIPT ><p>{TEXT}</p><style>p{{}}", TEXT),
    (f"<p>{TEXT}</nope></p></b></div><p>More of it here.</p>", f"{TEXT} More of it here."),
    (f"<b><p>{TEXT}</b> goes on</p>", f"{TEXT} goes on"),
    (f"<p/><div/>{TEXT}<br/>End", f"{TEXT} End"),
    ("<", "<"), ("", ""), ("</", ""), ("<p", ""), ("<>x", "<>x"),
])
def test_broken_markup(page, want):
    assert html_text.main_text(page, {}) == want


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<a title=\"" * 100_000, "<a title='" + "<b c=\"" * 100_000, "<!--" * 250_000, "</a" * 300_000, "<script>" * 120_000,
    "<div>" * 8_000 + "</nope>" * 8_000, "<div>" * 50_000 + "</nope>" * 50_000, "<i>" * 50_000 + "</b>" * 50_000, "<p><b>" * 50_000,
    "<p title=it's>" * 70_000, "<a" + " " * 1_000_000 + "b", "&" * 1_000_000, "<a" + " x=" * 300_000 + ">",
])
def test_time_is_linear_in_the_page(page):
    """A megabyte of what makes a reader look back takes seconds."""
    begin = time.process_time()
    html_text.main_text(page, {})
    assert time.process_time() - begin < 15


def test_long_names_are_told_apart():
    one, two = "x" * 80 + "one", "x" * 80 + "two"
    kinds = [t[0] for t in html_text.tokens(f"<div class='{one}'>a</div><div class='{two}'>b</div>") if t[1]]
    assert len(set(kinds)) == 2 and all(len(k) < 60 for k in kinds)
