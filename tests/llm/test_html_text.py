"""Skipped elements of web pages end where HTML ends them: the text after them stays."""

import pytest

from dossier.llm import html_text

WELL_FORMED = [
    "<select><option>A</option><option>B</option></select>",
    "<button><div>A</div>B</button>",
    "<p>x<button><div>A</div>B</button></p>",
    "<object>A<object>B</object><p>B</p></object>",
    "<select><optgroup label=x><option>A<optgroup label=y><option>B</select>",
    "<datalist><option>A<option>B</datalist>",
]
OPEN = [
    "<select><option>A<option>B</select>",
    "<option>A<option>B",
    "<select><option>A",
    "<select><option>A<select>",
    "<div><button>A</div>",
    "<button>A",
    "<button>A<button>B</button>",
    "<object data=x>A",
    "<object>A<object>B</object>",
    "<div><select><option>A</div>",
    "<ul><li><button>A<li>x</ul>",
    "</svg><select></svg><option>A</select>",
    "<head><title>A</title>",
]


def _texts(page):
    return [t for _, t in html_text.parse(page)[1]]


@pytest.mark.parametrize("before", WELL_FORMED + OPEN)
def test_text_after_a_skipped_element_stays(before):
    assert [t for t in _texts(before + "<article><p>One.</p><p>Two.</p></article>") if t != "x"] == ["One.", "Two."]


def test_article_after_a_language_picker():
    prose = "The town council met on Monday, and after a long talk it chose to keep the old bridge. " * 4
    page = f"<body><header><select><option>English<option>French</select></header><article><h1>Bridge</h1><p>{prose}</p><p>{prose}</p></article></body>"
    assert prose.strip() in html_text.main_texts([page], html_text.model())[0]
