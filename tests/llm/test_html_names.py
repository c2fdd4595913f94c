"""Names of page furniture on wrappers and on parts of the article."""

import pytest

from assaylake.llm.html_extract import main_text

LONG = ["One paragraph of the article, with several clauses; it ends here.", "Another paragraph of it, as long as the first, and it ends here too."]
BODY = "<h1>A headline</h1>" + "".join(f"<p>{p}</p>" for p in LONG)
PART = "<p>Earlier authors, among them several of note, held another view; we do not.</p>"
TEXT = ["A headline", *LONG]


@pytest.mark.parametrize("start", ["<div class='content no-sidebar'>", "<div class='page has-header'>", "<form id='aspnetForm'>", "<form class='search'>", "<div class='no-sidebar'><form id=form1><div class='with-footer'>"])
@pytest.mark.parametrize("inside", ["{}", "<article>{}</article>", "<div>{}</div>"])
def test_wrappers(start, inside):
    page = f"<body><nav>Home, blog</nav>{start}{inside.format(BODY)}<div class='share-buttons'>Share, like.</div></body>"
    assert main_text(page) == "\n\n".join(TEXT)


@pytest.mark.parametrize("part", [f"<section id='related-work'>{PART}</section>", f"<section class='social-policy'>{PART}</section>", PART.replace("<p>", "<p id='reply-to-critics'>")])
@pytest.mark.parametrize("inside", ["<article>{}</article>", "<div>{}</div>"])
def test_parts_of_the_article(part, inside):
    page = f"<body><div class='cookie-notice'><p>We use cookies, sorry.</p></div>{inside.format(f'{BODY}<h2 id=search>Search</h2>{part}')}</body>"
    assert main_text(page) == "\n\n".join([*TEXT, "Search", PART[3:-4]])


def test_reference_list():
    works = [f"Author {i}, A work of some length, with a title, volume {i}." for i in range(3)]
    page = f"<body><div>{BODY}<h2>References</h2><ol>" + "".join(f"<li><a href='/{i}'>{w}</a>" for i, w in enumerate(works)) + "</ol><ul><li><a href='/'>Home</a></ul></div></body>"
    assert main_text(page) == "\n\n".join([*TEXT, "References", *works])


def test_furniture_stays_out():
    page = f"<body><article>{BODY}<div class='related-posts'>{PART}</div><section id=comments>{PART * 9}</section></article></body>"
    assert main_text(page) == "\n\n".join(TEXT)
