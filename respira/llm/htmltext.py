"""Main text of web pages as a maximum-scoring subsequence: words score positive, tags negative.

A page is a sequence of tokens. A word's score depends on where it stands (inside an article or <main>, outside of one
that the page has, in a page without; there plain, in a block of links only, or in one of several like items that each bear a link or a
date) and a tag's on its name; a linear scan finds the contiguous region with the largest sum. Scores are log odds learned
from labelled pages: of words, how much more often they are main text there than not; of tags, how much more often they
stand outside the main text than inside, never above 0.

The region then takes in the rest of the smallest element around it: text that stands in that element itself, and parts
whose words score positive by themselves; a part of links only is left out. Where that element is the whole body, only
blocks of text directly in it that score positive are taken, and articles that count.

Articles that count are those whose ancestors have the same names and classes as the main one's, which is the first unless
another holds twice its words; an article within an article, as comments are, does not. Text outside them is not given out.

Parts that no page counts as its article (scripts, styles, menus, headers, footers, asides, forms, hidden elements, and
elements one of whose class names, id, role or label names adverts, comments and the like as a whole) are known by their
markup: such a part is one token with a score of its own, and its words are not given out. A part that holds an <article>,
<main> or <h1>, or is never closed though it needs an end tag, or is named so only in part (no-comments, related-work), is
kept: outside of articles its tag scores like a part that is no article. In a page with articles elsewhere, those of a part
so named count as outside.

The text is that of the region's blocks: references decoded, white space inside a block one space, blocks joined by \\n. Very long pages
are read whole, in time that grows as their length: open elements stand on a stack, and a tag that never ends is given up
at the next <, or, if quotes may hide that, after searches that sum up to WIDE_SHARE times the page.

Nulls: a null html is an empty page, whose text is empty; a null page_id or url stays null. Unclosed, crossed and cut-off
tags are read as they come. Repeated rows give the same text. Ties go to the region that begins first and then to the
longer one. An empty table gives no rows. Columns other than page_id, url and html play no part.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.llm.common import chunks

OPEN = re.compile(r"<(?=[A-Za-z/!?])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>", re.S)
#: A tag that has < inside quotes: looked for where TAG fails, until what was searched in vain is WIDE_SHARE times the page.
WIDE = re.compile(r"<(/?)([A-Za-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
WIDE_SHARE = 20
#: Elements that hold characters and no markup.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "select", "xmp", "noembed", "noframes")
#: Elements that are never part of an article.
APART = frozenset((*RAW, "head", "nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "canvas", "object", "audio", "video", "fieldset", "label", "datalist"))
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Words that name what is no article, if the whole class, id, role or label is made of them and of FILLING.
NOISE = frozenset(
    "ad ads adsense banner cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies respond sidebar aside widget widgets menu menus nav "
    "navbar navigation navigations breadcrumb breadcrumbs toc footer masthead topbar toolbar share sharing social related recirc trending pagination pager copyright complementary contentinfo search".split()
)
FILLING = frozenset("box container wrapper wrap inner list section area block slot unit bar items links posts articles stories buttons icons form message notice notification alert reply header head foot site page global post article entry".split())
#: Words that make a part doubtful wherever they stand in a name; it is kept, and outside of articles its tag scores like one that is none.
DOUBTFUL = NOISE | frozenset("notice notification alert reply discussion side foot head header legal disclaimer skip form".split())
STEMS = ("advert", "sponsor", "promo", "recommend")
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HOLDS = ("article", "main")
CORE = ("article", "main", "h1")
#: Elements that part a page into boxes, and marks that the items of a list of comments or teasers bear.
BOXES = frozenset("article body center div li main section td th".split())
MARKS = frozenset("a time cite".split())
ITEMS = frozenset("div li section".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose end tag may be left out; for each, the start tags that end it and the elements that shut it in.
CELLS = ("tr", "tbody", "thead", "tfoot")
IMPLIED = {
    "p": (BLOCKS - {"body", "caption", "head", "html", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "title", "tr"}, frozenset()), "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
    "td": ({"td", "th", *CELLS}, {"table"}), "th": ({"td", "th", *CELLS}, {"table"}), "tr": (set(CELLS), {"table"}),
}
ENDED_BY = {t: [n for n, (by, _) in IMPLIED.items() if t in by] for t in BLOCKS}
OPEN_END = re.compile(r"<(?:/?(?:article|main)|h1|body|/body)\b", re.I)


def _naming(name: str, attributes: str) -> str:
    """What an element's attributes say of it: "apart" for no article, "doubt" for perhaps none, or nothing."""
    said = ""
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" and value != "false" or key == "style" and re.search(r"(?:^|;)\s*display\s*:\s*none", value):
            return "apart"
        if key in ("class", "id", "role", "aria-label") and name not in HEADINGS:
            for token in [value] if key == "aria-label" else value.split():
                words = re.split(r"[\s_-]+", token.strip("-_ \t\r\n"))
                named = [w in NOISE or w.startswith(STEMS) for w in words]
                if any(named) and all(n or w in FILLING for n, w in zip(named, words, strict=True)):
                    return "apart"
                if any(named) or not DOUBTFUL.isdisjoint(words):
                    said = "doubt"
    return said


class Tag:
    """A tag at [start, at): its name, whether it closes, its attributes, and where its element ends, if known."""

    __slots__ = ("at", "attributes", "closed", "closes", "end", "name", "start")

    def __init__(self, start: int, at: int, closes: bool, name: str, attributes: str):
        self.start, self.at, self.closes, self.name, self.attributes = start, at, closes, name, attributes
        self.end, self.closed = None, False


def _tags(page: str) -> list[Tag]:
    """Tags, comments (no name) and whole raw elements in order, with the ends of elements; an end tag left out is put in."""
    out: list[Tag] = []
    stack: list[Tag] = []
    held: Counter = Counter()
    lower = None

    def ends(depth: int, where: int) -> None:
        """Elements of the stack above depth end: those whose end tag may be left out are closed there, others never were."""
        while len(stack) > depth:
            t = stack.pop()
            held[t.name] -= 1
            t.end, t.closed = where, t.name in IMPLIED

    def find(name: str, stops) -> int | None:
        if held[name]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    return i
                if stack[i].name in stops:
                    return None
        return None

    at, size = 0, len(page)
    budget = WIDE_SHARE * size
    while there := OPEN.search(page, at):
        at = there.start()
        m = TAG.match(page, at)
        if m is None and budget > 0 and (m := WIDE.match(page, at)) is None:
            budget -= size - at
        if m is None:
            at += 1
            continue
        at = m.end()
        tag = Tag(m.start(), at, *((bool(m[1]), m[2].lower(), m[3]) if m[2] else (False, "", "")))
        out.append(tag)
        name = tag.name
        if not name:
            continue
        if tag.closes:
            # an inline end tag does not end blocks
            i = find(name, () if name in BLOCKS else BLOCKS)
            if i is not None:
                opened = stack[i]
                ends(i + 1, tag.start)
                stack.pop()
                held[name] -= 1
                opened.end, opened.closed = at, True
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>").search(lower, at)
            tag.end = at = end.end() if end else size
            continue
        for other in ENDED_BY.get(name, ()):
            i = find(other, IMPLIED[other][1])
            if i is not None:
                ends(i, tag.start)
        if name not in VOID and not tag.attributes.endswith("/"):
            stack.append(tag)
            held[name] += 1
    for t in stack:
        if t.name in IMPLIED:
            t.end, t.closed = size, True
    return out


class Box:
    """An element that holds text: its parent's number, name, class, whether it is aside, and the tokens [first, last) in it."""

    __slots__ = ("aside", "first", "label", "last", "marked", "name", "parent")

    def __init__(self, parent: int, name: str, label: str, aside: bool, first: int):
        self.parent, self.name, self.label, self.aside, self.first, self.last, self.marked = parent, name, label, aside, first, first, False


class Token:
    """kind "tag" (value: name or /name), "text" (characters), "apart" (a whole part that is no article) or "doubt" (the tag of a part that may be none), the number of its box, and whether it stands in a link."""

    __slots__ = ("box", "kind", "linked", "value")

    def __init__(self, kind: str, value: str, box: int, linked: bool = False):
        self.kind, self.value, self.box, self.linked = kind, value, box, linked


def _label(attributes: str) -> str:
    return next((" ".join(sorted((m[2] or m[3] or m[4] or "").lower().split())) for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class"), "")


def tokens(page: str) -> tuple[list[Token], list[Box]]:
    """Tokens of a page and its boxes, of which number 0 is the page.

    A part that holds an article, a main or an h1 is never thrown away. Boxes in one named as no article and holding an
    article or a main are aside.
    """
    out: list[Token] = []
    boxes = [Box(-1, "", "", False, 0)]
    around: list[tuple[int, int]] = [(len(page) + 1, 0)]
    tags = _tags(page)
    cores = [(t.start, t.name) for t in tags if not t.closes and t.name in CORE]
    at, aside, linked = 0, 0, 0

    def leave(where: int) -> int:
        """The innermost box at a position."""
        while around[-1][0] <= where:
            boxes[around.pop()[1]].last = len(out)
        return around[-1][1]

    for t in tags:
        if t.start < at:
            continue
        if t.start > at:
            out.append(Token("text", page[at : t.start], leave(at), at < linked))
        at = t.at
        name = t.name
        if not name:
            continue
        if t.closes:
            out.append(Token("tag", f"/{name}", leave(t.start)))
            continue
        if name in RAW:
            out.append(Token("apart", name, leave(t.start)))
            at = t.end
            continue
        said = ""
        if name not in ("html", "body", "main") and name not in VOID and not t.attributes.endswith("/"):
            said = "apart" if name in APART else _naming(name, t.attributes)
        if said == "apart":
            end = t.end if t.closed else None
            if name in APART and not t.closed:
                m = OPEN_END.search(page, at)
                end = min(m.start() if m else len(page), t.end if t.end is not None else len(page))
            inside = {c for _, c in cores[bisect_left(cores, (t.start,)) : bisect_left(cores, (end,))]} if end is not None else set()
            if end is not None and not inside:
                out.append(Token("apart", name, leave(t.start)))
                at = end
                continue
            if not inside.isdisjoint(HOLDS):
                aside = max(aside, end)
        box = leave(t.start)
        if name in BOXES and not t.attributes.endswith("/"):
            boxes.append(Box(box, name, _label(t.attributes), t.start < aside, len(out)))
            box = len(boxes) - 1
            around.append((len(page) if t.end is None else t.end, box))
        if name in MARKS:
            boxes[box].marked = True
            if name == "a" and t.closed:
                linked = max(linked, t.end)
        out.append(Token("doubt" if said else "tag", name, box))
    rest = page[at:]
    cut = re.search(r"<[A-Za-z/!?][^<>]*\Z", rest)
    if rest:
        out.append(Token("text", rest[: cut.start()] if cut else rest, leave(at), at < linked))
    leave(len(page))
    boxes[0].last = len(out)
    return out, boxes


class Weights:
    """Log odds of words by place, of tags by name, and of a part that is no article."""

    def __init__(self, words: dict[str, float], tags: dict[str, float], apart: float, other: float):
        self.words, self.tags, self.apart, self.other = words, tags, apart, other


def _items(boxes: list[Box]) -> list[bool]:
    """Of each box: whether it is, or is in, one of several boxes side by side of one name and class that all bear marks."""
    marked = [b.marked for b in boxes]
    for i in range(len(boxes) - 1, 0, -1):
        marked[boxes[i].parent] |= marked[i]
    alike: dict[tuple, list[int]] = {}
    for i, b in enumerate(boxes):
        if b.label and b.name in ITEMS:
            alike.setdefault((b.parent, b.name, b.label), []).append(i)
    out = [False] * len(boxes)
    for group in alike.values():
        if len(group) > 1 and all(marked[i] for i in group):
            for i in group:
                out[i] = True
    for i in range(1, len(boxes)):
        out[i] |= out[boxes[i].parent]
    return out


def _counted(sequence: list[Token], boxes: list[Box], items: list[bool]) -> tuple[list[int], set[int]]:
    """The innermost article, or else the innermost <main>, of each box (0: none), and the articles that count."""
    inner, chain, ids = [0] * len(boxes), [0] * len(boxes), {}
    nested = [False] * len(boxes)
    for i, b in enumerate(boxes[1:], 1):
        chain[i] = ids.setdefault((chain[b.parent], b.name, b.label), len(ids) + 1)
        up = inner[b.parent]
        inner[i] = i if b.name == "article" or b.name == "main" and (not up or boxes[up].name == "main") else up
        nested[i] = nested[b.parent] or b.name == "article" and bool(up) and boxes[up].name == "article"
    words = Counter()
    for t in sequence:
        if t.kind == "text" and not items[t.box]:
            words[inner[t.box]] += len(t.value.split())
    holders = {i for i in range(1, len(boxes)) if inner[i] == i}
    front = {i for i in holders if not boxes[i].aside} or holders
    mains = {i for i in front if boxes[i].name == "main"}
    groups: dict[int, list[int]] = {}
    for i in sorted(front - mains):
        if not nested[i]:
            groups.setdefault(chain[boxes[i].parent], []).append(i)
    best: list[int] = []
    for group in groups.values():
        if not best or max(words[i] for i in group) > 2 * max(words[i] for i in best):
            best = group
    return inner, {*best, *mains}


def _blocks(sequence: list[Token]) -> list[int]:
    """Of each token: the number of its block of text."""
    out, at = [], 0
    for t in sequence:
        at += t.kind != "text" and t.value.lstrip("/") in BLOCKS
        out.append(at)
    return out


def places(sequence: list[Token], boxes: list[Box], items: list[bool]) -> tuple[list[str], list[int]]:
    """Of each token: inside an article that counts or a <main>, outside though the page has one, or none, and if it is in a block of links only or in one of several like items; of each box, the number of the article that counts around it, or 0."""
    inner, counts = _counted(sequence, boxes, items)
    where = ["inside" if i in counts else "outside" if counts else "none" for i in inner]
    blocks = _blocks(sequence)
    plain = {b for b, t in zip(blocks, sequence, strict=True) if t.kind == "text" and not t.linked and t.value.strip()}
    out = [where[t.box] + (" item" if items[t.box] else " link" if t.linked and b not in plain else "") for b, t in zip(blocks, sequence, strict=True)]
    return out, [i if i in counts and boxes[i].name == "article" else 0 for i in inner]


def learn(pages: list[tuple[str, str]]) -> Weights:
    """Weights from labelled pages: (html, main text). A run of text is main text if its words are those of the label, in order."""
    words: dict[str, Counter] = {w + k: Counter() for w in ("inside", "outside", "none") for k in ("", " link", " item")}
    tags: dict[str, Counter] = {}
    apart = Counter()
    for page, text in pages:
        (sequence, boxes), label = tokens(page), text.split()
        at, main = 0, []
        for t in sequence:
            run = entities.unescape(t.value).split() if t.kind == "text" else []
            good = bool(run) and label[at : at + len(run)] == run
            at += len(run) * good
            main.append(good)
        first = main.index(True) if True in main else 0
        last = len(main) - 1 - main[::-1].index(True) if True in main else -1
        for i, (t, place) in enumerate(zip(sequence, places(sequence, boxes, _items(boxes))[0], strict=True)):
            inside = first <= i <= last
            if t.kind == "text":
                words[place][main[i]] += len(entities.unescape(t.value).split())
            elif t.kind == "apart":
                apart[inside] += 1
            else:
                tags.setdefault(t.value, Counter())[inside] += 1
    odds = lambda c: math.log((c[True] + 0.5) / (c[False] + 0.5))
    return Weights(
        {k: max(-4.0, min(4.0, odds(c))) for k, c in words.items()},
        {k: max(-3.0, min(0.0, odds(c))) for k, c in tags.items()}, max(-3.0, min(-0.2, odds(apart))), -0.5,
    )


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the largest sum, (0, 0) if none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and found[0] == start:
            best, found = total, (start, i + 1)
    return found


def _kept(sequence: list[Token], boxes: list[Box], found: list[str], articles: list[int], scores: list[float], region: tuple[int, int]) -> list[bool]:
    """Of each token: whether it is given out, by the region, the smallest element around it, and the articles that count."""
    start, end = region
    sums, links = [0.0] * len(boxes), [0] * len(boxes)
    for t, s in zip(sequence, scores, strict=True):
        if t.kind == "text":
            sums[t.box] += s
        links[t.box] += t.kind == "tag" and t.value == "a"
    for i in range(len(boxes) - 1, 0, -1):
        sums[boxes[i].parent] += sums[i]
        links[boxes[i].parent] += links[i]
    held = [0] * len(boxes)
    for t, s in zip(sequence[start:end], scores[start:end], strict=True):
        held[t.box] += t.kind == "text" and s > 0
    for i in range(len(boxes) - 1, 0, -1):
        held[boxes[i].parent] += held[i]
    hold = max(i for i in range(len(boxes)) if held[i] == held[0])
    up, over = hold, set()
    while up > 0:
        if boxes[up].name == "article" or boxes[up].name == "li":
            hold = up if boxes[up].name == "article" else boxes[up].parent
        over.add(up)
        up = boxes[up].parent
    whole = boxes[hold].name not in ("", "body")
    # rows and cells stand with the text around them; other boxes are taken as they score
    within, bare, poor = [False] * len(boxes), [False] * len(boxes), [False] * len(boxes)
    for i, b in enumerate(boxes):
        within[i] = i == hold or i > 0 and within[b.parent]
        flows = b.name in ("li", "td", "th") and i > 0
        bare[i] = i == hold or flows and bare[b.parent]
        poor[i] = i > 0 and (poor[b.parent] or i not in over and not flows and sums[i] < 0 and links[i] > 2)
    rich = [articles[i] > 0 and sums[articles[i]] > 0 for i in range(len(boxes))]
    for i, b in enumerate(boxes):
        if within[i] and not bare[i]:
            rich[i] |= rich[b.parent] or sums[i] > 0 and whole
    block, total = _blocks(sequence), Counter()
    for k, t in enumerate(sequence):
        total[block[k]] += scores[k] if t.kind == "text" else 0.0
    out = []
    for k, (t, place) in enumerate(zip(sequence, found, strict=True)):
        fits = start <= k < end or rich[t.box] or bare[t.box] and (whole or total[block[k]] > 0)
        out.append(fits and not poor[t.box] and not place.startswith("outside") and not (place.endswith("item") and scores[k] < 0))
    return out


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page. Where nothing scores positive, items are read like other text."""
    if not page:
        return ""
    sequence, boxes = tokens(page)
    for items in (_items(boxes), [False] * len(boxes)):
        found, articles = places(sequence, boxes, items)
        scores = []
        for t, place in zip(sequence, found, strict=True):
            if t.kind == "text":
                scores.append(weights.words[place] * len(t.value.split()))
            else:
                part = t.kind == "apart" or t.kind == "doubt" and not place.startswith("inside")
                scores.append((weights.apart if part else 0.0) + (weights.tags.get(t.value, weights.other) if t.kind != "apart" else 0.0))
        region = best_region(scores)
        if region != (0, 0):
            break
    else:
        return ""
    blocks: list[list[str]] = [[]]
    for t, kept in zip(sequence, _kept(sequence, boxes, found, articles, scores, region), strict=True):
        if t.kind == "text" and kept:
            blocks[-1].append(t.value)
        elif t.kind != "text" and t.value.lstrip("/") in BLOCKS:
            blocks.append([])
        elif t.kind != "text" and t.value == "br":
            blocks[-1].append(" ")
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def labelled_pages(count: int = 400, seed: int = 11) -> list[tuple[str, str]]:
    """Labelled pages to learn from, made by rule: layouts, parts around and inside an article, lists and links in it, a second article, and items under made-up names, drawn at random."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("ka", "lo", "mi", "ter", "un", "sa", "vo", "ren")) for _ in range(rng.randint(1, 4)))
    say = lambda lo, hi: " ".join(word() for _ in range(rng.randint(lo, hi)))

    def noise() -> str:
        kind = rng.randrange(10)
        links = "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(rng.randint(2, 7)))
        return (
            f"<nav><ul>{links}</ul></nav>", f'<div class="ad">{say(3, 12)}</div>', f'<aside class="sidebar"><h3>{say(1, 3)}</h3><ul>{links}</ul></aside>', f'<div class="cookie-notice">{say(5, 15)} <button>ok</button></div>',
            f"<form><label>{say(1, 2)}</label><input name=q></form>", f"<script>var a='{say(2, 9)}';</script>", f'<section id="comments"><p>{say(4, 20)}</p><p>{say(4, 20)}</p></section>', f"<div><ul>{links}</ul></div>", items(), items(),
        )[kind]

    def items() -> str:
        """Comments or teasers: like boxes under made-up names, each with a link or a date."""
        name, mark = f"{word()}{rng.randint(1, 99)}", rng.choice(("<a href=/u>{}</a>", "<time>{}</time>", "<a href=/t><b>{}</b></a>"))
        each = "".join(f'<div class="{name}">{mark.format(say(1, 3))}<p>{say(4, 60)}</p></div>' for _ in range(rng.randint(2, 6)))
        return f'<div class="{word()}">{each}</div>'

    out = []
    for _ in range(count):
        holder = ("article", "main", "div", "section")[rng.choice((0, 0, 1, 2, 2, 3))]
        made, label = [], []
        for _ in range(2 if holder == "article" and rng.random() < 0.2 else 1):
            title = say(3, 9)
            label.append(title)
            body = f"<h1>{title}</h1>"
            for _ in range(rng.randint(1, 7)):
                text = say(5, 90)
                first, rest = text.split(" ", 1)
                drawn = rng.random()
                inline = text if drawn < 0.5 else f"{first} <b>{rest}</b>" if drawn < 0.75 else f"<a href=/x>{first}</a> {rest}"
                body += (noise() if rng.random() < 0.15 else "") + f"<p>{inline}" + ("</p>" if rng.random() < 0.8 else "")
                label.append(text)
                if rng.random() < 0.15:
                    rows = [say(1, 12) for _ in range(rng.randint(2, 5))]
                    body += "<ul>" + "".join(f"<li>{r}</li>" for r in rows) + "</ul>"
                    label += rows
            made.append(f"<{holder}>{body}</{holder}>")
        before, after = ("".join(noise() for _ in range(rng.randint(1, 4))) for _ in range(2))
        between = noise() if len(made) > 1 else ""
        page = f"<html><head><title>{label[0]}</title></head><body><header><p>{say(1, 6)}</p></header>{before}{between.join(made)}{after}<footer><p>{say(3, 15)}</p></footer></body></html>"
        out.append((page, "\n".join(label)))
    return out


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages."""
    learned = weights or learn(labelled_pages())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(batches, "html"):
            yield pdf[["page_id", "url"]].assign(text=[extract(h, learned) for h in pdf["html"]])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return picked.mapInPandas(rows, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
