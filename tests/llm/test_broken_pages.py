"""Pages whose silent elements have no end."""
import time

import numpy as np
import pytest

from loomtrace.llm.dom import Page


def every_block(html):
    page = Page(html)
    return page.blocks(np.ones(len(page.tag), dtype=bool))


@pytest.mark.parametrize("html,want", [
    ("<html><head><title>t</title><meta charset=x><body><p>a</p><p>b</p>", ["a", "b"]),
    ("<head><title>t</title><p>a", ["a"]),
    ("<head><title>t</title>a<p>b", ["a", "b"]),
    ("<head><title>t<body><p>a", ["a"]),
    ("<head><script>if (a<b) x = 'it</script></head><body><p>a's</p>", ["a's"]),
    ("<head><script>if (a<b) x = \"</script></head><body><p>a</p>", ["a"]),
    ("<head><noscript><img src=x></head><body><p>a", ["a"]),
    ("<head><noscript><img src=x><body><p>a", ["a"]),
    ("<div><button>no</div><p>a</p>", ["a"]),
    ("<div><button><div>no</div>no</button>a</div>", ["a"]),
    ("<p><svg><g></p><p>a</p>", ["a"]),
    ("<body><p>a</p><noscript><p>b</p></body>", ["a", "b"]),
    ("<body><object><p>a", ["a"]),
    ("<div><button>no<button>no</button>a</div>", ["a"]),
    ("<div><object><object>no</object>no</object>a</div>", ["a"]),
    ("<noscript><script>'</noscript>'</script>no</noscript>a", ["a"]),
    ("<div><svg><title>no</svg>a</div>", ["a"]),
    ("<article><p data-x=it's>Hello there one</p><p>it's fine two</p></article>", ["Hello there one", "it's fine two"]),
    ("<p title='a>b' data-y=\"c>d\">one</p>", ["one"]),
    ("<p title= 'a>b'>one</p><p title=\"broken>two</p><p>three</p>", ["one", "two", "three"]),
    ("<p>a < b and b > c</p><p>x <y", ["a < b and b > c", "x <y"]),
    ("<p>one</p><!-- no", ["one"]),
    ("<p>one<!-- no --> two</p>", ["one two"]),
])
def test_text_of_broken_pages(html, want):
    assert every_block(html) == want


@pytest.mark.parametrize("piece", ['<a "', "<a b='", '<a b="', "<p x=it's>", "<a", "<!--", "<", "='", '<a b="c">', "<a b=\"'>"])
def test_broken_quotes_take_linear_time(piece):
    began = time.perf_counter()
    Page("<p>text</p>" + piece * (100_000 // len(piece)))
    Page(piece * (100_000 // len(piece)) + "<p>text</p>")
    assert time.perf_counter() - began < 2
