import numpy as np
import pytest

from loomtrace.llm import extraction
from loomtrace.llm.dom import Page
from loomtrace.llm.page_templates import MARK, template_page


@pytest.fixture(scope="module")
def trees(spark):
    return extraction.train(spark)


def every_block(html):
    page = Page(html)
    return page.blocks(np.ones(len(page.tag), dtype=bool))


def test_held_out_pages(trees):
    html = [template_page(s) for s in range(50_000, 50_150)]
    same = good = 0
    for page, text in zip(html, extraction.main_text(html, trees), strict=True):
        want = [b for b in every_block(page) if MARK in b]
        same += text == "\n\n".join(want)
        good += len(set(text.split()) & set(" ".join(want).split())) >= 0.8 * len(set(" ".join(want).split()))
    assert same >= 0.8 * len(html) and good >= 0.93 * len(html)


def test_a_kept_node_has_kept_ancestors(trees):
    for seed in range(60_000, 60_040):
        page = Page(template_page(seed))
        x, chars = page.features()
        kept = extraction.decoded(page, extraction.margins(trees, x), chars)
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])


def test_reading_html():
    assert every_block("<p>a &amp;  b<br>c<b>d</b>e<p>f<!-- <p>no --><script>x</p></script>g</p>") == ["a & b cde", "fg"]
    assert every_block("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>") == ["1", "2", "3", "4"]
    assert every_block("x<select><option>o</select><textarea>t</textarea>y") == ["xy"]
    assert every_block(None) == [] and every_block("") == [] and every_block("<") == ["<"]
    assert every_block("<div " + 'a="' + "x" * 9 + "<p>open") != []


def test_whole_table(spark, trees):
    page = template_page(70_000)
    long = "<body><nav><a href=x>m</a></nav><article>" + "<p>Some long text, with marks. And more.</p>" * 3000 + "</article></body>"
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>"), (4, "u", long)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id bigint, url string, html string, text string")
    out = extraction.extract(df, trees).collect()
    assert len(out) == 6 and all(len(r.text) == r.n_chars for r in out)
    assert {r.text for r in out if r.page_id in (2, 3, None)} == {""} and next(r.text for r in out if r.page_id == 4).count("\n\n") == 2999
    assert extraction.extract(df.limit(0), trees).collect() == []
