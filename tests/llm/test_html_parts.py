"""Parts of a page that are thrown away by their markup, and parts that must not be."""

import time

import pytest

from respira.llm import htmltext

LONG = " ".join(f"w{i}" for i in range(30))


@pytest.fixture(scope="module")
def weights():
    return htmltext.learn(htmltext.labelled_pages())


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f'<article class="post no-comments"><h1>Head</h1><p>{LONG}</p></article>', f"Head\n{LONG}"),
        (f'<div class="content has-sidebar"><p>{LONG}</p></div>', LONG),
        (f'<div style="overflow:hidden"><p>{LONG}</p></div>', LONG),
        (f'<div class="overflow-hidden" data-x="hidden"><p>{LONG}</p></div>', LONG),
        (f'<article><h1>Head</h1><p>{LONG}</p><section id="related-work" aria-label="Comments on related work"><h2>Work</h2><p>{LONG}</p></section></article>', f"Head\n{LONG}\nWork\n{LONG}"),
        (f'<article><h1>Head</h1><div class="row with-menu">short</div><h2 id="comments">More</h2><p>{LONG}</p></article>', f"Head\nshort\nMore\n{LONG}"),
        (f'<article><h1>Head</h1><p class="ad">Buy<p>{LONG}</p><p>Last</p></article>', f"Head\n{LONG}\nLast"),
        (f"<article><h1>Head</h1><p>{LONG}</p><ul><li class=ad>Buy<li>one</ul><table><tr><td class=ad>Buy<td>two</table><dl><dt class=ad>Buy<dd>three</dl><p>{LONG}</article>", f"Head\n{LONG}\none\ntwo\nthree\n{LONG}"),
        (f'<article><h1>Head</h1><div class="ad">open<p>{LONG}</p></article>', f"Head\nopen\n{LONG}"),
        (f'<div class="sidebar" hidden><main><p>{LONG}</p></main></div>', LONG),
        (f"<form id=aspnetForm><article><header><h1>Head</h1></header><p>{LONG}</p></article></form>", f"Head\n{LONG}"),
        (f'<article><h1>Head</h1><p>{LONG}</p></article><section id="comments"><article class="comment"><p>nice {LONG}</p></article></section>', f"Head\n{LONG}"),
        (f'<div hidden><p>{LONG}</p></div><div class="related-posts"><p>x {LONG}</p></div><article><p>{LONG}</p><div style="display: none">gone</div><div aria-label="Share">gone</div></article>', LONG),
    ],
)
def test_parts(weights, body, text):
    assert htmltext.extract(f"<html><body>{body}</body></html>", weights) == text


def test_unclosed_parts_stay_linear(weights):
    began = time.time()
    for part in ('<div class="ad">a ', "<b>", "<p class=ad>x", "<i><b>x</i>", "<aside><article>x "):
        htmltext.extract(part * 20_000, weights)
    assert time.time() - began < 20
