"""Main text: densities against a plain recursion, and pages whose article is easily lost."""

import math
import random

import pytest

from rowwarden.llm import main_text as mt

P = ["<p>" + " ".join(f"word{i}{j}" for j in range(20)) + ".</p>" for i in range(30)]
TEXT = ["".join(p.removeprefix("<p>").removesuffix("</p>")) for p in P]
NAV = "<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>"


def page(body):
    return f"<html><head><title>t</title></head><body>{NAV}{body}<footer>Copyright</footer></body></html>"


def plain(node):
    """(chars, tags, link chars, link tags, nodes by id) of a subtree, by recursion."""
    chars = tags = links = link_tags = 0
    own = {}
    for child in node.children:
        if isinstance(child, str):
            chars += len("".join(child.split()))
        elif not child.skip:
            c, t, l, lt, more = plain(child)
            chars, tags, links, link_tags = chars + c, tags + t, links + l, link_tags + lt
            own |= more
    tags += node.parent is not None
    if node.tag == "a":
        links, link_tags = chars, link_tags + 1
    return chars, tags, links, link_tags, own | {id(node): (node, chars, tags, links, link_tags)}


def density(root, chars, tags, links, link_tags):
    if not chars:
        return 0.0
    share = plain(root)[2] / plain(root)[0]
    base = math.log(chars * links / max(1, chars - links) + share * chars + math.e)
    return chars / max(1, tags) * math.log(max(1.0, chars / max(1, links) * max(1, tags) / max(1, link_tags))) / base


def test_densities_as_by_plain_recursion():
    draw = random.Random(3)

    def made(depth):
        if depth == 0 or draw.random() < 0.2:
            return "x" * draw.randrange(40) + " "
        tag = draw.choice(["div", "p", "a", "ul", "li", "b", "section", "aside", "span"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(draw.randrange(4))) + f"</{tag}>"

    for _ in range(60):
        root = mt.parse(page(made(5) + made(5)))
        kept = mt.measure(root)
        values = plain(root)[4]
        assert {id(n) for n in kept} == set(values)
        for node, *counts in values.values():
            assert [node.chars, node.tags, node.link_chars, node.link_tags] == counts
            assert node.density == pytest.approx(density(root, *counts))
            assert node.sum == pytest.approx(sum(density(root, *values[id(c)][1:]) for c in node.children if not isinstance(c, str) and not c.skip))


@pytest.mark.parametrize("attribute", ["class='content has-sidebar'", "id='page' class='no-sidebar'", "class='post comments-open'", "class='discussion-paper'",
                                       "class='entry'", "style='display:none'", "class='banner'", "role=main"])
def test_a_name_round_the_article_does_not_empty_it(attribute):
    assert mt.main_text(page(f"<div {attribute}>{''.join(P[:5])}</div>")).split("\n") == TEXT[:5]


def test_a_form_round_the_page():
    assert mt.main_text(f"<body><form>{NAV}<div>{''.join(P[:5])}</div></form></body>").split("\n") == TEXT[:5]


@pytest.mark.parametrize("name", ["comments", "comment-list", "sidebar", "ad-slot", "site-footer", "cookie-consent", "related-posts", "newsletter-signup", "widget-area",
                                  "share-buttons", "main-nav", "adBox", "breadcrumbs"])
def test_furniture_goes(name):
    assert mt.main_text(page(f"<div>{''.join(P[:5])}</div><div class='x {name}'>{P[20]}</div>")).split("\n") == TEXT[:5]
    assert mt.main_text(page(f"<article>{''.join(P[:5])}<div id={name}>{P[20]}</div></article>")).split("\n") == TEXT[:5]


def test_long_comments_beside_an_article_go():
    assert mt.main_text(page(f"<article>{''.join(P[:3])}</article><div class=comments>{''.join(P[5:25])}</div>")).split("\n") == TEXT[:3]


def test_articles_in_several_containers_stay_whole():
    long = "<p>" + "letters " * 475 + "</p>"
    short = [f"<p>{'s' * 60} {i}</p>" for i in range(20)]
    for tag in ("div", "section"):
        found = mt.main_text(f"<body><{tag}>{long}</{tag}><{tag}>{''.join(short)}</{tag}></body>").split("\n")
        assert len(found) == 21 and found[0].startswith("letters")
    assert mt.main_text(page(f"<div>{''.join(P[:5])}</div><div>{''.join(P[5:10])}</div>")).split("\n") == TEXT[:10]
    assert mt.main_text(page(f"<article>{''.join(P[:5])}</article><article>{''.join(P[5:7])}</article>")).split("\n") == TEXT[:7]
    assert mt.main_text(page(f"<div><h1>The title</h1></div><div>{''.join(P[:5])}</div>")).split("\n") == ["The title", *TEXT[:5]]
    assert mt.main_text(page("One line here.<br>" + TEXT[0] + "<ul><li><a href=x>more and more links to read</a></li></ul>")) == "One line here. " + TEXT[0]
    cards = "".join(f"<article><a href={i}>Another story to read {i}</a></article>" for i in range(9))
    assert mt.main_text(page(f"<main>{''.join(P[:5])}</main>{cards}")).split("\n") == TEXT[:5]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", page(P[0])), (4, "w", "no tags at all &amp; a sign"), (4, "w", "no tags at all &amp; a sign"),
            (5, "x", "<div>" * 3000 + "deep" + "</div>" * 3000), (6, "y", page(f"<article>{P[0] * 4000}</article>")), (7, "z", page("")), (8, "q", "<article></article>")]
    table = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in mt.extract_pages(table).collect()), key=str)
    want = [(1, "u", ""), (2, None, ""), (None, "v", TEXT[0]), *[(4, "w", "no tags at all & a sign")] * 2, (5, "x", "deep"),
            (6, "y", "\n".join([TEXT[0]] * 4000)), (7, "z", ""), (8, "q", "")]
    assert got == sorted(((i, u, t, len(t)) for i, u, t in want), key=str)
    assert mt.extract_pages(table.limit(0)).count() == 0
