"""Pages written apart from those that the weights are learned from: other words, layouts and names, half of them without an <article>."""

import itertools

import pytest

from respira.llm import htmltext

PROSE = (
    "The old bridge over the river was closed in spring, and the town waited for its engineers.",
    "Nobody had counted the boats that pass under it, though the harbour office keeps a ledger.",
    "In the evening the water falls; by morning it stands as high as the lower road.",
    "Stone from the quarry was carried here by barge until the railway came.",
    "Most of the piers rest on oak, which lasts as long as it stays wet.",
    "A survey of 1911 gives the width of each arch, and it has not been done again since then.",
)
LINKS = "".join(f'<li><a href="/{i}">Page {i}</a></li>' for i in range(14))
BEFORE = (
    f'<div class="q1"><ul>{LINKS}</ul></div>',
    '<div class="zz-top"><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a> <a href="/w">Weather</a></div>',
    f"<table><tr><td><ul>{LINKS}</ul></td></tr></table>",
)
AFTER = (
    '<div class="rx">' + "".join(f'<div class="rx-i"><a href="/u{i}">user{i}</a><p>{PROSE[i]} I liked this very much.</p></div>' for i in range(4)) + "</div>",
    '<ul class="k9">' + "".join(f'<li class="k9-row"><time>2 May</time> <span>{PROSE[-i]}</span></li>' for i in range(1, 4)) + "</ul>",
    f'<div class="foot-x"><ul>{LINKS}</ul></div>',
)
STREAM = '<div class="cmt-stream">' + "".join(f"<article><p>Reader {i}: {PROSE[i]}</p></article>" for i in range(3)) + "</div>"
BODIES = (
    (f"<h1>On bridges</h1><p>{PROSE[0]}</p><p>{PROSE[1]} {PROSE[2]}</p><p>{PROSE[3]}</p>", ("On bridges", PROSE[0], f"{PROSE[1]} {PROSE[2]}", PROSE[3])),
    (f'<h2>Piers</h2><p>See <a href="/x">this</a>.</p><ul>{LINKS}</ul><p>{PROSE[4]}</p><p>{PROSE[5]}</p>', ("Piers", "See this.", *(f"Page {i}" for i in range(14)), PROSE[4], PROSE[5])),
    (f"<p>Short words first.</p>{'<div><span></span></div>' * 12}<p>{PROSE[0]}</p><blockquote>{PROSE[3]}</blockquote><p>{PROSE[2]}</p>", ("Short words first.", PROSE[0], PROSE[3], PROSE[2])),
    (f"<h1>A table</h1><p>{PROSE[5]}</p><table><tr><th>Arch</th><th>Width</th></tr><tr><td>1</td><td>12 m</td></tr></table><p>{PROSE[1]}</p>", ("A table", PROSE[5], "Arch", "Width", "1", "12 m", PROSE[1])),
    (f'<h1>Parts</h1><div class="s1"><p>{PROSE[0]}</p></div><div class="s2"><h3>Later</h3><p>{PROSE[4]}</p><p>{PROSE[2]}</p></div>', ("Parts", PROSE[0], "Later", PROSE[4], PROSE[2])),
)
HOLDERS = ("article", "div class=m77", "section id=u3", "two")


def pages():
    for holder, (body, lines), before, after in itertools.product(HOLDERS, BODIES, BEFORE, AFTER):
        if holder == "two":
            other = f"<article><h1>Second</h1><p>{PROSE[3]} {PROSE[1]}</p></article>"
            yield f"<html><body>{before}<article>{body}</article><div><ul>{LINKS * 3}</ul></div>{other}{STREAM}{after}</body></html>", "\n".join((*lines, "Second", f"{PROSE[3]} {PROSE[1]}"))
        else:
            end = holder.split()[0]
            yield f"<html><body>{before}<{holder}>{body}</{end}>{STREAM if holder == 'article' else ''}{after}</body></html>", "\n".join(lines)


@pytest.fixture(scope="module")
def weights():
    return htmltext.learn(htmltext.labelled_pages())


def test_exact(weights):
    made = list(pages())
    wrong = [(p, t, got) for p, t in made if (got := htmltext.extract(p, weights)) != t]
    assert len(made) == 180 and len(wrong) <= 9, wrong[:2]


def test_scan_decides(weights, monkeypatch):
    """With the whole page for its region, a third of the pages without articles come out otherwise."""
    made = list(pages())
    monkeypatch.setattr(htmltext, "best_region", lambda scores: (0, len(scores)))
    assert sum(htmltext.extract(p, weights) != t for p, t in made if "<article>" not in p) >= 30


WORDS = " ".join(f"w{i}" for i in range(60))


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<div><p>See <a>this</a>.</p><ul>" + "<li><a>x</a></li>" * 30 + f"</ul><p>{WORDS}</p></div>", "See this.\n" + "x\n" * 30 + WORDS),
        ("<p>a b c d e f g h i j k l</p>" + "<div><span></span></div>" * 12 + f"<p>{WORDS}</p>", f"a b c d e f g h i j k l\n{WORDS}"),
        (f"<article><p>{WORDS}</p></article><ul>" + "<li><a>x</a></li>" * 60 + f"</ul><article><p>{WORDS} z</p></article>", f"{WORDS}\n{WORDS} z"),
        (f'<article><p>{WORDS}</p></article><div class="cmt-stream"><article>reader comment</article></div>', WORDS),
        (f"<article><p>{WORDS}</p><article><p>{WORDS} said a reader</p></article></article>", WORDS),
        ("".join(f'<div class="post"><time>date</time><p>{k} {WORDS}</p></div>' for k in "abc"), "\n".join(f"date\n{k} {WORDS}" for k in "abc")),
    ],
)
def test_text_that_tags_part(weights, body, text):
    assert htmltext.extract(f"<html><body>{body}</body></html>", weights) == text


@pytest.mark.parametrize("page", ["", "<p", "<p>", "</div></div>", "<article></article>", "<div class=a><div class=a>", "<a><a><li><td>x"])
def test_odd_pages(weights, page):
    assert htmltext.extract(page, weights) in ("", "x")
