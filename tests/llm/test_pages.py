"""Copies of pages, classes that decide, and tags that end in a slash."""

import pytest

from skein.llm import html


def texts(spark, pages):
    rows = [(k, url, page) for k, (url, page) in enumerate(pages)]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [t for _, t in sorted((r.page_id, r.text) for r in found)]


def plain(body, head=""):
    return f"<html><head>{head}<title>t</title></head><body><div><h1>Title of it</h1><p>{body}</p><p>More of the story</p></div></body></html>"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100])
def test_copies_keep_their_text(spark, n):
    same = [(f"http://a.example/{k}", plain("One text.")) for k in range(n)]
    alike = [(f"http://b.example/{k}", plain("One text.", f"<meta content={k}>")) for k in range(n)]
    assert set(texts(spark, same + alike)) == {"Title of it One text. More of the story"}


def test_copies_make_no_furniture(spark):
    """Fifty copies of one page weigh as much as one: what two other pages share with it isn't on most pages of the host."""
    pages = [("http://c.example/0", plain("A shared paragraph."))] * 50
    pages += [(f"http://c.example/{k}", f"<body><div><h1>Page {k}</h1><p>Body of page {k}</p><p>{'A shared paragraph.' if k < 2 else f'Own words {k}'}</p></div></body>") for k in range(8)]
    got = texts(spark, pages)
    assert set(got[:50]) == {"Title of it A shared paragraph. More of the story"}
    assert got[50:] == [f"Page {k} Body of page {k} {'A shared paragraph.' if k < 2 else f'Own words {k}'}" for k in range(8)]


def test_classes_decide(spark, monkeypatch):
    """A box of part of the pages is known by its class alone: no tag or name tells it from the article."""
    box = "<div><div><p>Latest offers</p><p>Call today</p></div></div>"
    pages = [(f"http://d.example/{k}", f"<body>{box if k % 4 else ''}<div><h2>Story {k}</h2><p>What happened on day {k}.</p></div></body>") for k in range(16)]
    want = [f"Story {k} What happened on day {k}." for k in range(16)]
    assert texts(spark, pages) == want
    monkeypatch.setattr(html.template_tokens, "__defaults__", (html.MIN_SHARE, 10**9))
    monkeypatch.setattr(html.templates, "__defaults__", (html.MIN_SHARE, 10**9, html.MIN_PAGES, html.MAIN_PAGES))
    assert texts(spark, pages) == [("Latest offers Call today " if k % 4 else "") + t for k, t in enumerate(want)]


def test_a_slash_in_a_value_closes_nothing(spark):
    page = '<body><div id="page"><main><div data-src=/a/>One</div><p>Two</p><br/><img src="x"/>Three</main></div></body>'
    other = [f'<body><div id="page"><main><div data-src=/{k}/>Part {k}</div><p>End {k}</p></main></div></body>' for k in range(11)]
    assert texts(spark, [(f"http://e.example/{k}", p) for k, p in enumerate([page, *other])])[0] == "One Two Three"
