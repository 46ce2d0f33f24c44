"""Extraction looks at whole pages: all siblings, and what stands in or after elements that aren't raw text."""

import numpy as np
import pytest

from strandex.llm import html


def test_place_and_share_of_many_siblings():
    nodes = html.flatten(html.parse("<body><div>" + "<p>a b</p>" * 150 + "<h2>c</h2>" * 50 + "</div></body>"))
    rows = html.features(nodes)[:, -5:]
    got = {tag: np.array([r for x, r in zip(nodes, rows) if x.tag == tag]) for tag in ("p", "h2")}
    assert np.allclose(got["p"][:, 0], np.arange(150) / 200) and np.allclose(got["h2"][:, 0], np.arange(150, 200) / 200)
    assert np.allclose(got["p"][:, 2], 0.75) and np.allclose(got["h2"][:, 2], 0.25)


def runs(page):
    return [html._tidy(r for r, _ in x.runs) for x in html.flatten(html.parse(page)) if x.tag == "#text"]


@pytest.mark.parametrize("tag", ["select", "object", "svg", "math", "noscript", "template"])
def test_an_element_without_its_end_hides_nothing(tag):
    assert runs(f"<p>a</p><{tag}><article><p>b</p><p>c</p></article>") == ["a", "b", "c"]


def test_formulas_and_fallback_text_stay():
    assert runs("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn><mspace/></math> then <svg><path d='M0'/></svg>so</p>") == ["if x=1 then so"]
    assert " ".join(runs("<p>a<object data=x>b <i>c</i></object><xmp><p>&amp;</xmp><noscript>d</noscript><script>no<p></script>")) == "ab c <p>&amp; d"


PROSE = "The quick brown fox jumps over the lazy dog near the river bank, as it does on most days of the week."


@pytest.mark.parametrize("attrs", ['class="advert"', "class=ad", 'id="sponsor1"', "hidden", 'style="display: none"'])
@pytest.mark.parametrize("tag", ["span", "a", "em"])
def test_inline_adverts_and_hidden_text_go_and_the_block_stays_one(tag, attrs):
    page = f"<body><article><h1>A title</h1><p>{PROSE} <{tag} {attrs}>Buy now at shop</{tag}> Then on.</p><p>{PROSE} x<{tag} {attrs}>y</{tag}>z</p></article></body>"
    assert html.main_texts([page], html.default_model()) == [f"A title {PROSE} Then on. {PROSE} xz"]


def test_other_inline_elements_are_no_nodes():
    page = f'<body><article><p>{PROSE} <span class="note">so</span><a class=more href=/ad>it</a> <i aria-hidden="false">is</i>.</p></article></body>'
    assert html.main_texts([page], html.default_model()) == [f"{PROSE} soit is."]
    assert not [x for x in html.flatten(html.parse(page)) if x.tag in ("span", "a", "i")]


def test_white_space_between_inline_nodes_is_kept():
    nodes = html.flatten(html.parse("<p>a<b class=ad>b</b> <i class=ad>c</i>\n<u>d</u></p>"))
    assert html._joined(nodes, [True] * len(nodes)) == "ab c d"
    gone = [x.tag != "b" and x.parent is not None and x.parent.tag != "b" or x.parent is None for x in nodes]
    assert html._joined(nodes, gone) == "a c d"


def test_extract_replaces_the_column_and_keeps_the_rest(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "", "y"), (3, f"<article><p>{PROSE}</p></article>", "z")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert got.columns == ["page_id", "html", "text"]
    assert sorted((r.page_id, r.text) for r in got.collect()) == [(1, ""), (2, ""), (2, ""), (3, PROSE)]
