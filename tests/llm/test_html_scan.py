"""Pages whose markup names nothing: the scan over learned scores decides. And pages made to be slow."""

import time

import pytest

from respira.llm import htmltext

LINKS = "".join(f'<li><a href="/p{i}">Topic {i}</a></li>' for i in range(12))
PARAGRAPHS = [" ".join(f"{x} sentence {k} about rivers and bridges," for x in ("One", "Another", "Third", "Last")) for k in range(4)]


@pytest.fixture(scope="module")
def weights():
    return htmltext.learn(htmltext.labelled_pages())


@pytest.mark.parametrize(
    ("before", "after"),
    [
        (f'<div class="zq"><ul>{LINKS}</ul></div>', '<div class="w0"><a href="/a">Imprint</a> <a href="/b">Terms</a></div>'),
        ('<div class="k1"><a href="/">Home</a></div><div class="k2"><a href="/x">News</a><a href="/y">More news</a></div>', f'<div id="x9"><ul>{LINKS}</ul></div>'),
        (f'<table><tr><td><ul>{LINKS}</ul></td></tr></table>', "<div><div><a href=1>one</a></div><div><a href=2>two</a></div></div>"),
    ],
)
def test_scores_decide_where_nothing_is_named(weights, before, after):
    body = f"<h2>On rivers</h2><p>{PARAGRAPHS[0]}</p><p>{PARAGRAPHS[1]} with <a href='#x'>a link</a> inside</p><blockquote>{PARAGRAPHS[2]}</blockquote><p>{PARAGRAPHS[3]}</p>"
    got = htmltext.extract(f'<html><head><title>T</title></head><body>{before}<div class="k77">{body}</div>{after}</body></html>', weights)
    assert got.split("\n") == ["On rivers", PARAGRAPHS[0], f"{PARAGRAPHS[1]} with a link inside", PARAGRAPHS[2], PARAGRAPHS[3]]


@pytest.mark.parametrize("piece", ["<nav><h1>x", "<a ", "<a '", '<a b="c', "<!", "<!--", "<?", "<x y=\"z' ", "<div class=ad>a ", "<p>x<b>y</i>", "<td>x<table>", "<script>"])
def test_slow_pages(weights, piece):
    began = time.time()
    htmltext.extract(piece * 100_000, weights)
    assert time.time() - began < 15


def test_angles_inside_quotes(weights):
    words = " ".join(f"w{i}" for i in range(20))
    assert htmltext.extract(f"<body><article><p title='a < b' data-x=\"<p>no</p>\">{words}</p></article></body>", weights) == words
    assert htmltext.extract(f"<body><article><p>{words}</p><a href=x <p>{words}</p></article>", weights).endswith(words)
