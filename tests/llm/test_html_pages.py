"""Labelled pages by hand, and pages of openings without ends."""

import time

import pytest

from dossier.llm import html_text as h

ONE = "The council met on Monday evening, and after two hours of debate the new bridge was approved by a narrow vote."
TWO = "Work begins in spring; the old crossing stays open for walkers until the summer, officials said afterwards."
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>'
FOOT = "<footer>Copyright 2024 Example Media. All rights reserved.</footer>"
CASES = {
    "plain": f"<html><head><title>x</title></head><body>{MENU}<article><h1>Bridge approved</h1><p>{ONE}</p><p>{TWO}</p></article>{FOOT}</body></html>",
    "no body": f"<head><title>x</title>{MENU}<article><h1>Bridge approved</h1><p>{ONE}<p>{TWO}</article>{FOOT}",
    "options": f"<body><form><select><option>One<option>Two</form>{MENU}<article><h1>Bridge approved</h1><p>{ONE}</p><p>{TWO}</p></article>{FOOT}",
    "button": f"<body><div class=bar><button>Menu</div>{MENU}<main><h1>Bridge approved</h1><p>{ONE}</p><p>{TWO}</p></main>{FOOT}",
    "comments": f"<body>{MENU}<article><h1>Bridge approved</h1><p>{ONE}</p><!-- <p>old > text</p> --><p>{TWO}</p></article><section class=comments><h3>Comments</h3><div class=comment><p>I never liked that bridge, it is much too dear.</p></div></section>{FOOT}",
    "form": f'<body>{MENU}<article><h1>Bridge approved</h1><p>{ONE}</p><form class="newsletter"><label>Your address</label><input><button>Send</button></form><p>{TWO}</p></article>{FOOT}',
    "script": f"<body><script>if (a < b) document.write('<p>no</p>')</script>{MENU}<article><h1>Bridge approved</h1><p>{ONE}</p><p>{TWO}</p></article><style>p {{ x: y }}</style>{FOOT}",
}


@pytest.mark.parametrize("name", CASES)
def test_articles(name):
    assert h.main_texts([CASES[name]], h.model()) == [f"Bridge approved\n\n{ONE}\n\n{TWO}"]


@pytest.mark.parametrize("piece", ['<a "', "<![CDATA[", "<!--", "</", "<p", "<", "<script", "</script", "<!x", "<b>", "&amp"])
def test_a_page_of_openings_takes_linear_time(piece):
    page = piece * (400_000 // len(piece))
    start = time.perf_counter()
    h.main_texts([page], h.model())
    assert time.perf_counter() - start < 20


def test_odd_pages():
    assert h.main_texts([None, "", "   ", "<p></p>"], h.model()) == ["", "", "", ""]
