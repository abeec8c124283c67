"""Pages where names of elements and the ratios of lines say different things."""

import pytest

from logstrata.llm.html_text import main_text

TEXT = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"c{i}" for i in range(300))


@pytest.mark.parametrize("comments", [
    f"<section id='comments'><article class='comment-body'><p>{LONG}</p></article></section>",
    f"<section id='comments'><article><p>{LONG}</p></article></section>",
    f"<div class='list'><article class='comment'><p>{LONG}</p></article></div>"])
def test_comments_longer_than_the_article(comments):
    for page in (f"<body><article><h1>T</h1><p>{TEXT}</p></article>{comments}</body>",
                 f"<body><main><article><h1>T</h1><p>{TEXT}</p></article></main>{comments}</body>"):
        assert main_text(page) == f"T\n{TEXT}"


@pytest.mark.parametrize("name", ["social-history", "notice-period", "menuChoices", "search-party"])
def test_names_inside_an_article(name):
    page = f"<article><h1>T</h1><p>{TEXT}</p><div class='{name}'><p>{LONG}</p></div><p>end</p></article>"
    assert main_text(page) == f"T\n{TEXT}\n{LONG}\nend"
    links = "".join(f"<li><a href=/{i}>l{i}</a></li>" for i in range(12))
    assert main_text(page.replace(f"<p>{LONG}</p>", f"<ul>{links}</ul>")) == f"T\n{TEXT}\nend"


def test_articles_side_by_side():
    page = f"<nav><a>m</a></nav><article><p>{TEXT}</p></article><article><p>{LONG}</p></article>"
    assert main_text(page) == f"{TEXT}\n{LONG}"
    assert main_text(page + page) == f"{TEXT}\n{LONG}\n{TEXT}\n{LONG}"


@pytest.mark.parametrize("words", [5, 40, 400])
def test_size_does_not_change_what_is_furniture(words):
    """A long sidebar is one as a short one is."""
    side = " ".join(f"s{i}" for i in range(words))
    page = f"<body><div class='sidebar'><p>{side}</p></div><article><p>{TEXT}</p></article></body>"
    assert main_text(page) == TEXT
