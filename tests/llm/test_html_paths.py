"""Tag-path ratios: their definition, that they decide the result, and pages of deep nesting."""

import random
import time
from math import exp, sqrt

import pytest

from assaylake.llm import html_extract as h

PAGE = (
    "<body><div><ul>" + "".join(f"<li><a href='/{i}'>Part {i}</a></li>" for i in range(150)) + "</ul></div>"
    "<div><div><h2>A title</h2>" + "".join(f"<p>Sentence one of block {i}, with a comma. Another one, to be long enough; and more of it.</p>" for i in range(8)) + "<p>Short.</p></div>"
    "<div><span>Tags</span> <a href='/x'>one</a> <a href='/y'>two</a></div></div><div>All rights</div></body>"
)


def plain_scores(nodes):
    """The ratios of paths as their definition has them, with the paths as lists of tags."""
    def path(e):
        return (path(e.parent) if e.parent else ()) + (e.tag,)

    paths = [path(n.element) for n in nodes]
    ratio = {}
    for p in set(paths):
        own = [n for n, q in zip(nodes, paths) if q == p]
        ratio[p] = (sum(max(0, len(n.text) - n.linked) for n in own) / len(own), sum(len(h.PUNCTUATION.findall(n.text)) for n in own) / len(own))
    found = {}
    for i, p in enumerate(paths):
        near = [(exp(-((j - i) ** 2) / 2), ratio[paths[j]]) for j in (i - 1, i, i + 1) if 0 <= j < len(nodes)]
        smooth = [sum(w * r[k] for w, r in near) / sum(w for w, _ in near) for k in (0, 1)]
        found.setdefault(p, []).append(sqrt(ratio[p][0] * smooth[0]) * (1 + sqrt(ratio[p][1] * smooth[1])))
    return {n.element.path: sum(found[p]) / len(found[p]) for n, p in zip(nodes, paths)}


def random_page(rng):
    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            text = " ".join(rng.choices(["word", "longer", "sentence,", "end.", "<a href='x'>link</a>"], k=rng.randrange(1, 30)))
            return f"<{(t := rng.choice(['p', 'div', 'li', 'td']))}>{text}</{t}>"
        inner = "".join(block(depth - 1) for _ in range(rng.randrange(1, 5)))
        return f"<{(t := rng.choice(['div', 'section', 'ul', 'table']))}>{inner}</{t}>"

    return block(4)


def test_scores_equal_their_definition():
    rng = random.Random(7)
    for _ in range(60):
        nodes = h.read_page(random_page(rng)).nodes
        assert nodes
        want = plain_scores(nodes)
        got = h.path_scores(nodes)
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 * (1 + want[p]) for p in got)


def test_the_scores_decide():
    text = h.main_text(PAGE)
    assert text.startswith("A title\n\nSentence one of block 0,") and text.endswith("Short.")
    flat = h.main_text(PAGE, score=lambda nodes: {n.element.path: 1.0 for n in nodes})
    assert flat != text and "Tags" in flat


def test_links_of_an_article_go_by_their_path():
    """A list of links inside the article is no text; a linked paragraph on the paragraphs' path is."""
    blocks = [f"Sentence one of block {i}, with a comma. Another one, to be long enough." for i in range(5)]
    page = "<article><h1>Title</h1>" + "".join(f"<p>{b}</p>" for b in blocks) + "<p><a href='x'>A linked one.</a></p><ul><li><a href='y'>More</a></li><li><a href='z'>Next</a></li></ul></article>"
    assert h.main_text(page) == "\n\n".join(["Title", *blocks, "A linked one."])
    flat = h.main_text(page, score=lambda nodes: {n.element.path: 1.0 for n in nodes})
    assert "Next" in flat


@pytest.mark.parametrize("open_tags", ["<div>" * 200_000, "<div class='ad x'>" * 50_000, "<ul><li>" * 50_000, ("<ul><li>" + "<div>" * 20 + "</span></td>") * 5_000])
def test_deep_pages_take_linear_time(open_tags):
    began = time.process_time()
    text = h.main_text(open_tags + "<p>text. here, it is.</p>" * 10)
    assert time.process_time() - began < 20
    assert text == "\n\n".join(["text. here, it is."] * 10)
