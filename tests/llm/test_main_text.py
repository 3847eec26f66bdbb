"""Main text against pages whose article is known."""

import math
import random

import pytest

from gaugeline.llm import main_text as M

WORDS = "lorem ipsum dolor sit amet consectetur elit sed tempor labore magna aliqua veniam quis nostrud".split()


def prose(rng, n=None):
    return " ".join(rng.choice(WORDS) for _ in range(n or rng.randrange(15, 60))).capitalize() + "."


MENU = '<ul>{}</ul>'.format("".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS[:8]))
FURNITURE = [
    f"<nav>{MENU}</nav>", f'<div class="top-menu">{MENU}</div>', f'<div id="sidebar">{MENU}<p>Our weekly letter brings all of it to you.</p></div>',
    "<header><h2>Site name</h2><p>The best site there is, for many years now and for many more.</p></header>",
    '<div class="cookie-notice">We use cookies to make this site better for everyone. <a href="/ok">Fine</a></div>',
    '<aside><p>Some words beside the article that do not belong to it at all.</p></aside>',
    '<form action="/s"><label>Search this site</label><input name="q"><button>Go</button></form>',
    '<div class="ad">Buy this thing now, it is the best thing that money can buy.</div>',
    "<script>var a = '<p>not text</p>';</script>", "<style>p > a { color: red }</style>", "<!-- <p>gone</p> -->",
    '<section class="comments"><h3>Comments</h3><article class="comment"><p>I liked this very much, thanks for writing it all down!</p></article></section>',
    "<footer><p>Copyright by us, all rights reserved. Every one of them.</p></footer>", "<noscript>Please turn it on</noscript>",
]


@pytest.mark.parametrize("open_tag,close_tag", [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ('<div class="post"><div class="body">', "</div></div>")])
def test_article_among_furniture(open_tag, close_tag):
    rng = random.Random(open_tag)
    for _ in range(40):
        parts = [prose(rng) for _ in range(rng.randrange(3, 9))]
        article = open_tag + "<h1>" + parts[0] + "</h1>" + "".join(rng.choice(["<p>{}</p>", "<p><b>{}", "<p> {}\n", "<blockquote>{}</blockquote>"]).format(p) for p in parts[1:]) + close_tag
        around = [rng.choice(FURNITURE) for _ in range(rng.randrange(0, 9))]
        cut = rng.randrange(0, len(around) + 1)
        page = "<!DOCTYPE html><html><head><title>No</title></head><body>" + "".join(around[:cut]) + article + "".join(around[cut:]) + "</body></html>"
        assert M.main_text(page) == "\n".join(parts)


def test_a_short_article_does_not_hide_the_long_text():
    rng = random.Random(7)
    long = [prose(rng, 40) for _ in range(6)]
    body = "".join(f"<p>{p}</p>" for p in long)
    quote = "<article><p>Short words of another page.</p></article>"
    assert "\n".join(long) in M.main_text(f"<body><div id=content>{body}</div>{quote}</body>")
    assert M.main_text(f"<body><div id=content>{body}{quote}</div></body>").startswith("\n".join(long))


def test_a_text_over_several_articles_is_whole():
    rng = random.Random(8)
    parts = [prose(rng, n) for n in (60, 50, 40, 30)]
    assert M.main_text("<body><div>" + "".join(f"<article><p>{p}</p></article>" for p in parts) + "</div></body>") == "\n".join(parts)


@pytest.mark.parametrize(
    "wrapper",
    ['<div class="content with-sidebar">{}</div>', '<div id="social-history">{}</div>', '<form id="aspnetForm"><input name="state">{}</form>', '<form id="aspnetForm"><article>{}</article><select><option>No</select></form>'],
)
def test_a_name_or_a_form_does_not_take_the_text_away(wrapper):
    rng = random.Random(wrapper)
    parts = [prose(rng, 40) for _ in range(5)]
    inner = "".join(f"<p>{p}</p>" for p in parts) + '<div id="sidebar"><p>Our weekly letter brings all of it to you.</p></div>'
    assert M.main_text(f"<body><nav>{MENU}</nav>{wrapper.format(inner)}<footer>Copyright</footer></body>") == "\n".join(parts)


def test_long_comments_are_left_out():
    rng = random.Random(9)
    comments = "".join(f'<div class="comment"><p>{prose(rng, 50)}</p></div>' for _ in range(9))
    assert M.main_text(f'<body><article><p>{WORDS[0]} {WORDS[1]}</p></article><section class="comments">{comments}</section></body>') == "lorem ipsum"


def test_an_advert_longer_than_the_article_is_left_out():
    assert M.main_text('<body><div class="ad">Buy this thing now, it is the best of all things.</div><article><p>Short.</p></article></body>') == "Short."


@pytest.mark.parametrize("part", ['<section id="social-history">{}</section>', '<div class="job-search-tips">{}</div>', '<div class="block the-notice-period">{}</div>'])
def test_a_part_of_an_article_named_like_furniture_stays(part):
    rng = random.Random(part)
    parts = [prose(rng, n) for n in (50, 6, 45, 50, 40)]
    inner = part.format(f"<h2>{parts[1]}</h2><p>{parts[2]}</p>")
    assert M.main_text(f"<body><article><p>{parts[0]}</p>{inner}<p>{parts[3]}</p><p>{parts[4]}</p></article></body>") == "\n".join(parts)
    links = '<div class="share-this-story"><a href="/a">Send it</a> <a href="/b">Print it</a></div>'
    assert M.main_text(f"<body><article><p>{parts[0]}</p>{links}{inner}</article></body>") == "\n".join(parts[:3])


def test_text_before_an_article_as_dense_as_it_stays():
    rng = random.Random(11)
    lead, parts = [prose(rng, 60) for _ in range(2)], [prose(rng, 40) for _ in range(4)]
    page = '<body><nav>{}</nav><div class="lead">{}</div><div>Thin <a href="/x">line</a></div><article>{}</article></body>'
    assert M.main_text(page.format(MENU, *("".join(f"<p>{p}</p>" for p in x) for x in (lead, parts)))) == "\n".join(lead + parts)


def test_a_standfirst_stays_a_byline_does_not():
    head = '<header><h1>Title</h1><p class="standfirst">What it is about.</p><p class="byline">By one of us</p><nav><p>Back</p></nav></header>'
    assert M.main_text(f"<article>{head}<p>{WORDS[0]} and more.</p></article>") == "Title\nWhat it is about.\nlorem and more."


def test_a_formula_stays_in_its_sentence():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>x=1</annotation></semantics></math>"
    assert M.main_text(f"<article><p>Let {formula} be the value.</p></article>") == "Let x=1 be the value."


def test_densities_against_their_definition():
    """Characters per tag with links, sums over children and the best node, each counted anew from the subtree."""
    rng = random.Random(12)
    for _ in range(60):
        part = lambda: rng.choice(["<p>{}</p>", "<div><p>{}</p><a href=x>go on</a></div>", "<a href=y>{}</a>", "<div>{}</div>"]).format(prose(rng))
        root = M.parse("<body>" + "".join(f"<div>{part()}{part()}</div>" for _ in range(rng.randrange(1, 7))) + "</body>")
        nodes = M.measure(root)

        def counts(node):
            inside = M.in_order(node)
            text = lambda n: sum(len("".join(c.split())) for x in M.in_order(n) for c in x.children if isinstance(c, str))
            links = [n for n in inside if n.tag == "a"]
            return text(node), len(inside) - 1, sum(map(text, links)), len([n for n in links if n is not node])

        whole, _, linked, _ = counts(root)
        density = {}
        for node in nodes:
            c, t, lc, lt = counts(node)
            t = max(1, t)
            base = math.log(c / max(1, c - lc) * lc + linked / max(1, whole) * c + math.e)
            density[id(node)] = max(0.0, c / t * math.log(c / max(1, lc) * t / max(1, lt)) / math.log(base)) if c and base > 1 else None
        for node in nodes:
            if density[id(node)] is not None:
                assert node.density == pytest.approx(density[id(node)])
            inner = [c for c in node.children if isinstance(c, M.Node)]
            if inner:
                assert node.total == pytest.approx(sum(c.density for c in inner))
            assert node.best.total == max(n.total for n in M.in_order(node))


def test_text_of_blocks():
    assert M.main_text("<article><p>a&amp;b &lt;i&gt;\n\t c&nbsp;&#233;<br>next <i>word</i>s</p><ul><li>one<li>two</ul></article>") == "a&b <i> c é\nnext words\none\ntwo"


def test_odd_pages():
    assert M.main_text("") == ""
    assert M.main_text("   \n") == ""
    assert M.main_text("just words & more") == "just words & more"
    assert M.main_text("<p>open <b>all the way") == "open all the way"
    assert M.main_text("<article><p>cut in a tag</p><p") == "cut in a tag"
    assert M.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    long = "word " * 300_000
    assert M.main_text(f"<article><p>{long}</p></article>") == long.strip()
    assert M.main_text("<nav><a href=/>only menu</a></nav>") == ""


def test_rows(spark):
    rows = [(1, "u", "<article><p>Text</p></article>", 5), (1, "u", "<article><p>Text</p></article>", 6), (None, None, None, None), (2, None, "", 1)]
    got = M.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", "Text", 4), (1, "u", "Text", 4), (None, None, "", 0), (2, None, "", 0)], key=repr)
    assert M.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
