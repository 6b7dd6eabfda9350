import itertools
import random
import time

from pyspark.sql import types as T

from vectide.llm import html
from vectide.llm.mincut import _flow_side, min_cut

PAGES = T.StructType().add("page_id", "long").add("url", "string").add("html", "string").add("text", "string").add("n_chars", "string")

LONG = "This is a paragraph of the article, which goes on for a while so that it looks like prose."


def cost(labels, scores, edges):
    return sum(max(s, 0) if not x else max(-s, 0) for x, s in zip(labels, scores)) + sum(w for a, b, w in edges if labels[a] != labels[b])


def test_cuts_are_minimal():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(0, 8)
        scores = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 3]) * rng.random() for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]
        best = min((cost(x, scores, edges) for x in itertools.product([False, True], repeat=n)), default=0)
        assert abs(cost(min_cut(scores, edges), scores, edges) - best) < 1e-6
        assert abs(cost(_flow_side(scores, edges), scores, edges) - best) < 1e-6


def page(body):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href='/x'>Home</a></li></ul></nav>{body}<footer>&copy; Someone</footer></body></html>"


def test_boilerplate_goes_and_content_stays():
    got = html.main_text(page(f"""<header class="site"><h2>Site name</h2></header><div class="cookie-notice"><p>{LONG}</p></div>
      <article><header><h1>Title &amp; more</h1></header><p>{LONG}</p><p>Short one.<p>Un<b>closed &lt;b&gt;  and\n\tspaces&nbsp;here.
      <div class='ad'>Buy this.</div><ul><li>Item of a list, first.</li><li>Second item.</ul><script>var t="</p>" + '<p>no</p>';</script>
      <form><p>{LONG}</p><input></form><!-- <p>{LONG}</p> --></article><aside><p>{LONG}</p></aside>
      <section id="comments"><div class="comment"><p>{LONG}</p></div></section>"""))
    assert got == "\n\n".join(["Title & more", LONG, "Short one.", "Unclosed <b> and spaces here.", "Item of a list, first.", "Second item."])


def test_no_article_element():
    got = html.main_text(page(f'<div id="sidebar"><p>{LONG}</p></div><div class="post"><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>'))
    assert got == "\n\n".join(["Head", LONG, LONG])


def test_edges(spark):
    many = page("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>")
    deep = page("<div>" * 3000 + f"<p>{LONG}</p>")
    rows = [(1, None), (2, ""), (3, "<p"), (4, "<!-- open"), (5, "<script>open"), (6, "</p></div><"), (7, page("")), (8, many), (9, page(f"<article><p>{LONG}</p></article>")), (9, page(f"<article><p>{LONG}</p></article>")), (None, "&#x41;&bogus;"), (10, deep), (11, "<div>" * 50_000 + "</p>" * 50_000 + "x"), (12, "<div>a" * 20_000)]
    df = spark.createDataFrame([(k, None, h, "x", "y") for k, h in rows], PAGES)
    got = html.extract(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = [(r["page_id"], r["text"], r["n_chars"]) for r in got.collect()]
    assert len(found) == len(rows) and all(n == len(t) for _, t, n in found)
    by = {k: t for k, t, _ in found}
    assert by[1] == by[2] == by[3] == by[4] == by[5] == by[7] == ""
    assert by[8].count(LONG) == 3000 and by[9] == LONG and by[10] == LONG
    assert html.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_names_are_evidence_and_attributes_are_parsed():
    one = f"<p>{LONG}</p>"
    whole = {
        f'<article class="post-1 hentry tag-news category-trending">{one}{one}</article>': 2,
        f'<div class="layout has-sidebar"><main><article>{one}</article></main></div>': 1,
        f'<div class="site no-sidebar"><div class="entry-content">{one}</div></div>': 1,
        f'<div class="page-no-sidebar">{one}</div>': 1,
        f'<article><p title="a hidden gem" data-x="class=ad">{LONG}</p></article>': 1,
        f'<article><p data-class="sidebar" id=first>{LONG}</p></article>': 1,
        f'<div class="page-banner-outerspace"><div>{one}{one}</div></div>': 2,
        f'<div class="content-sidebar-wrap"><main class="content">{one}</main></div>': 1,
    }
    for text, n in whole.items():
        assert html.main_text(page(text)) == "\n\n".join([LONG] * n), text
    for away in (
        f'<div id="onetrust-consent-sdk">{one}</div>',
        f"<div class=ad>{LONG}</div>",
        f"<div class='post-sidebar'>{one}</div>",
        f'<div class="sidebar"><article><h3>Teaser</h3>{one}</article></div>',
        f'<div id="comments"><ol><li class="comment"><article class="comment-body"><div class="comment-content">{one}</div></article></li></ol></div>',
        f'<div role="alert">{one}</div>',
        f'<p hidden>{LONG}</p><p style="color:red; display : none">{LONG}</p>',
        f'<a href="/x"><div>{LONG}</div><p>{LONG}</p></a>',
    ):
        assert html.main_text(page(away + f"<article>{one}</article>")) == LONG, away
    assert html.main_text(f"<article>{one}<section><h1>Replies</h1><article>{one}</article></section></article>").count(LONG) == 1


def test_forms_go_unless_they_frame_the_page():
    one = f"<p>{LONG}</p>"
    assert html.main_text(page(f"<form id=page><div><article>{one}</article></div><aside>{one}</aside></form>")) == LONG
    assert html.main_text(page(f"<form>{one}{one}</form>")) == f"{LONG}\n\n{LONG}"
    assert html.main_text(page(f"<article>{one}{one}{one}</article><form>{one}{one}<label>Name</label></form>")).count(LONG) == 3
    assert html.main_text(page(f"<form><p>Your name</p><label>{LONG}</label></form>")) == ""
    related = f'<section class="related-posts"><article><h3><a href=x>Another</a></h3>{one}</article></section>'
    assert html.main_text(page(f"<article>{one}</article>{related}")) == LONG


def test_hidden_inline_text_goes():
    text = f"<article><p>{LONG} <span hidden>no <span>no</span> no</span>yes <i style='display: none'>no</i><b aria-hidden=true>no</b>end.</p><p>{LONG}<span hidden>no</p><p>{LONG}</p></article>"
    assert html.main_text(page(text)).split("\n\n") == [f"{LONG} yes end.", LONG, LONG]


def test_edges_decide():
    """Blocks that their own score would put on the wrong side."""
    pages = {
        f"<div><h1>Head</h1><p>{LONG}</p><p>Short</p><p>{LONG}</p></div>": ["Head", LONG, "Short", LONG],
        f"<article><p>{LONG}</p><p><a href='/y'>A line that is a link</a></p><p>{LONG}</p></article>": [LONG, "A line that is a link", LONG],
        f"<div><p>{LONG}</p><p>{LONG}</p></div><ul><li><a href='/a'>One</a></li><li>Two of the menu, here.</li><li><a href='/b'>Three</a></li></ul>": [LONG, LONG],
    }
    changed = 0
    for text, want in pages.items():
        scores, _ = html.graph(html.blocks(text))
        assert html.main_text(text).split("\n\n") == want
        changed += [b[0] for b, s in zip(html.blocks(text), scores) if s > 0] != want
    assert changed == 2


def test_pages_against_exhaustive_cuts():
    rng = random.Random(3)
    parts = [f"<p>{LONG}</p>", "<p>Short</p>", "<p><a href=x>Linked words</a></p>", "<li>Item.</li>", f'<div class="promo-x">{LONG}</div>', "<h2>Head</h2>", "<div class=share>Tell others</div>", "<div class='entry'>", "</div>", "<section>", "</section>", "<aside>", "</aside>"]
    turned = 0
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 11)))
        found = html.blocks(text)
        scores, edges = html.graph(found)
        least = min((cost(x, scores, edges) for x in itertools.product([False, True], repeat=len(found))), default=0)
        labels = min_cut(scores, edges)
        assert abs(cost(labels, scores, edges) - least) < 1e-6
        assert html.main_text(text) == "\n\n".join(b[0] for b, x in zip(found, labels) if x)
        turned += any(x != (s > 0) for x, s in zip(labels, scores))
    assert turned >= 20


def test_odd_markup_takes_linear_time():
    began = time.perf_counter()
    for odd in ("<!-- ", "<script></script ", '<p x=">"', "<a href='", "<div ", "<a '>", "<p a", "&", "</p>", "<b", '<p """>', "<p '\">"):
        html.main_text(odd * 50_000)
    assert time.perf_counter() - began < 60
