"""Scores and threshold of tag paths, with and without an article element."""

import pytest

from misheard.llm import tag_paths

HEAD = "Head"
BODY = ["First paragraph, with text. And more of it, so that it has some length.",
        "Second: it is longer, with marks, and so on; it ends here. Or here.",
        "Third, and last, the paragraph closes the text. It says so, too."]
TEXT = f"<h1>{HEAD}</h1>" + "".join(f"<p>{p}</p>" for p in BODY)
LINES = [HEAD, *BODY]
COMMENTS = "<p>Ann: nice, thanks.</p><p>Bob: me too.</p>"


def lines(body):
    return tag_paths.extract(f"<html><body><nav>menu</nav>{body}<footer>Foot</footer></body></html>").split("\n")


@pytest.mark.parametrize("around", ["{}", "<main>{}</main>", "<div class=page>{}</div>"])
def test_two_articles_of_different_class(around):
    page = f'<article class="a">{TEXT}</article><article class="b">{TEXT.replace("First", "Other")}</article>'
    assert lines(around.format(page)) == [*LINES, *(x.replace("First", "Other") for x in LINES)]


@pytest.mark.parametrize("outer", ["article", "main", "div class=c"])
def test_link_lists_and_boxes_in_the_text(outer):
    name = outer.split()[0]
    links = '<ul class="zq"><li><a href="/">Home</a><li><a href="/m">More</a></ul>'
    box = '<div class="xk"><p>Buy now</p></div>'
    assert lines(f"<{outer}>{links}{TEXT}</{name}>") == LINES
    assert lines(f"<{outer}>{TEXT}{links}{box}</{name}>") == LINES
    assert lines(f"<{outer}>{box}{TEXT}{links}</{name}>") == LINES


@pytest.mark.parametrize("outer", ["article", "main", "div class=c"])
@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("start", ["", "<h3>2 Comments</h3>"])
def test_comments_without_a_telling_name(outer, inside, start):
    name = outer.split()[0]
    said = f'<div class="zq">{start}{COMMENTS}</div>'
    page = f"<{outer}>{TEXT}{said}</{name}>" if inside else f"<{outer}>{TEXT}</{name}>{said}"
    assert lines(page) == LINES


@pytest.mark.parametrize("outer", ["article", "main", "div class=c"])
def test_shapes_of_text_stay(outer):
    name = outer.split()[0]
    more = ("<h2>Next</h2><ul><li>Item one<li>Item two</ul><blockquote><p>Said so</p></blockquote><table><tr><td>1<td>2</table>"
            "<section><h3><a href=x>Linked</a></h3><p>Short</p></section><figure><figcaption>Seen</figcaption></figure>")
    want = ["Next", "Item one", "Item two", "Said so", "1", "2", "Linked", "Short", "Seen"]
    assert lines(f"<{outer}>{TEXT}{more}</{name}>") == LINES + want


def test_heading_above_the_container_of_the_text():
    body = "".join(f"<p>{p}</p>" for p in BODY)
    assert lines(f"<article><header><h1>Head</h1></header><div class=b>{body}</div></article>") == LINES
    assert lines(f"<div class=w><h1>Head</h1><div class=b>{body}</div></div>") == LINES


def test_parts_of_a_text_in_several_containers():
    parts = [f'<div class="part{k}">' + "".join(f"<p>{p} {k}</p>" for p in BODY) + "</div>" for k in range(3)]
    assert lines("".join(parts)) == [f"{p} {k}" for k in range(3) for p in BODY]
