import itertools
import math
import random

import numpy as np

from dialoom.llm.html_extract import FEATURES, OTHER, Forest, TreeModel, blocks, default_model, extract, labelled_pages, main_texts, owned, parse


def one(html):
    return main_texts([html], default_model())[0]


def test_held_out_pages():
    pages = labelled_pages(150, seed=99)
    got = main_texts([p for p, _ in pages], default_model())
    right = extra = missing = 0
    for text, (_, lines) in zip(got, pages):
        a, b = text.split("\n") if text else [], lines
        right += len(set(a) & set(b))
        extra += len(set(a) - set(b))
        missing += len(set(b) - set(a))
    assert extra <= 0.03 * right and missing <= 0.03 * right, (right, extra, missing)


ARTICLE = "<h1>A title here</h1><p>First paragraph, with <b>bold</b> &amp; <a href=x>a link</a> in it.<p>Second   one\n\tis short.</p>"
WANT = "A title here\nFirst paragraph, with bold & a link in it.\nSecond one is short."


def test_page():
    before = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad -->"
    for boilerplate in (
        '<div class="ad">Buy this now, it is cheap.</div>',
        '<div id="sidebar"><p>Look here for some other texts.</p></div>',
        '<div class="cookie-notice">We use cookies on this page.</div>',
        "<form action=/s><label>Your mail</label><p>Sign up here.</p></form>",
        '<section class="comments"><h2>Comments</h2><div class="comment"><p>I think that this is a very good text.</p></div></section>',
        "<header><p>The site of all sites.</p></header>",
        "<aside><p>Beside the text.</p></aside>",
        "<footer>&copy; somebody &middot; all rights.</footer>",
    ):
        assert one(f"{before}{boilerplate}<article>{ARTICLE}</article></body></html>") == WANT, boilerplate
        assert one(f"{before}<article>{ARTICLE}</article>{boilerplate}") == WANT, boilerplate
        assert one(f"{before}<article>{ARTICLE}{boilerplate}</article>") == WANT, boilerplate


def test_broken_markup():
    assert one(None) == one("") == one("<") == one("<p") == one("<!--") == ""
    assert one(f"<article>{ARTICLE}<p>cut &am") == WANT + "\ncut &am"
    assert one(f"<article>{ARTICLE}<p>cut <a hre") == WANT + "\ncut"
    assert one(f"<article>{ARTICLE}<p>1 < 2 &lt; 3 &#233;&eacute;&unknown;") == WANT + "\n1 < 2 < 3 éé&unknown;"
    for depth in (5000, 20_000):
        assert one("<div>" * depth + f"<article>{ARTICLE}</article>") == WANT
    assert len(one("<article>" + "<p>" + "word " * 300_000)) == 5 * 300_000 - 1


def test_head_without_end():
    metadata = "<title>t</title><meta charset=utf-8><link rel=x href=y><style>p{}</style><script>var t='</p>';</script>"
    rest = f"<nav><ul><li><a href=/>Home</a></li></ul></nav><article>{ARTICLE}</article>"
    for page in (
        f"<html><head>{metadata}<body>{rest}</body></html>",
        f"<head>{metadata}{rest}",
        f"<html><head>{metadata}<noscript><p>x</p></noscript><template><p>x</p></template><body>{rest}",
        f"<html><head><title>never closed<body>{rest}",
        f"<html><head><title>never closed</head>{rest}",
        f"<head><title>never closed{rest}",
    ):
        assert one(page) == WANT, page


def test_scripts_are_no_markup():
    for script in ("if (a<b && c) {} // don't", "s = '<head>'", "s = '<head><svg>'; t = \"<button\"", "for(i=0;i<n;i++) x = \"it's <template> \""):
        for head in (f"<head><script>{script}</script><title>t</title></head>", f"<head><script>{script}</script><title>t</title>"):
            page = f"<html>{head}<body><article>{ARTICLE}</article><p class=footer>That isn't it.</p></body></html>"
            assert one(page).startswith(WANT), (script, head)
        for around in ("button", "object", "svg", "template", "video"):
            assert one(f"<body><article><{around}>x<script>{script}</script>y</{around}>{ARTICLE}</article><p>isn't</p>").startswith(WANT), (script, around)


def test_unclosed_hidden_elements_end_with_their_parent():
    texts = lambda html: [t for _, t in blocks(parse(html))]
    for tag in "button select object audio video canvas datalist svg annotation template textarea iframe noscript title script style".split():
        assert texts(f"<body><div>a<{tag}>hidden</div>b<p>c</p>") == ["a", "b", "c"], tag
        assert texts(f"<body><ul><li>a<span><{tag}>hidden</span> b</li><li>c</ul>d") == ["a b", "c", "d"], tag
        if tag != "template":
            assert texts(f"<body><table><tr><td>a<{tag}>hidden<td>b</table>c") == ["a", "b", "c"], tag
    # closed ones hide all that they hold
    for tag in "button object audio video canvas template".split():
        assert texts(f"<div>a<{tag}><div>x<p>y<br/>z</div><ul><li>x<li>y</ul><{'x-' + tag}>x</{tag}> b</div>c") == ["a b", "c"], tag
    assert texts("<div>a<button>x<button>y</button> b</div>c") == ["a b", "c"]
    assert texts("<div>a<select><option>x<select> b</div><div><select><option>x<input> c</div><select><option>x<p>d") == ["a b", "c", "d"]
    assert texts("<div>a<svg><title>x<g><path/></svg> b<svg><script/><style/><text>x</text></svg> c<svg><desc><p>x</p></desc></svg></div><svg><g><p>d") == ["a b c", "d"]
    assert texts("<div>a<object>" + "<i></b></div2>" * 50_000 + "</div>b") == ["a", "b"]


def test_blocks_keep_page_order():
    page = parse("<div>one<p>two</p>three <ul><li>four<li>five</ul> six</div>seven")
    assert [t for _, t in blocks(page)] == ["one", "two", "three", "four", "five", "six", "seven"]


def test_rows(spark, sf_dir):
    rows = [(1, "u", f"<article>{ARTICLE}</article>", "x", 5), (1, "u", f"<article>{ARTICLE}</article>", "x", 5), (None, None, None, None, None), (2, "v", "", "x", 1)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(2)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert extract(pages.limit(0)).collect() == []
    import html
    import re

    texts = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():  # these pages hold their text in one article element
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.DOTALL)[1]
        lines = [" ".join(html.unescape(re.sub("<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)(?:>|$)", inner)]
        assert texts[r.page_id] == "\n".join(filter(None, lines)), r.page_id


def test_marginals_against_enumeration():
    """All states of small trees, one by one."""
    draw = random.Random(4)
    for _ in range(30):
        model = TreeModel(np.array([draw.gauss(0, 1) for _ in range(FEATURES)]), np.array([draw.gauss(0, 1) for _ in range((OTHER + 1) * 4)]).reshape(-1, 2, 2))
        html, open_ = "", []
        for _ in range(draw.randint(0, 9)):
            while open_ and draw.random() < 0.4:
                html += f"</{open_.pop()}>"
            open_.append(draw.choice(["div", "section", "article", "aside"]))
            html += f"<{open_[-1]} class={draw.choice(['menu', 'ad', 'x', 'post'])}>" + draw.choice(["", "some words.", "a"])
        page = parse(html)
        forest = Forest([page, page], [blocks(page)] * 2)
        n = len(page.tags)
        own = forest.x[:n] @ model.unary
        weights = {}
        for states in itertools.product((0, 1), repeat=n):
            score = sum(own[k] * s for k, s in enumerate(states))
            score += sum(model.pair[forest.kind[k], states[page.parents[k]], states[k]] for k in range(1, n))
            weights[states] = math.exp(score)
        z = sum(weights.values())
        nodes, edges, log_z = model.marginals(forest)
        assert np.allclose(log_z, math.log(z))
        for k in range(n):
            want = sum(w for s, w in weights.items() if s[k]) / z
            assert math.isclose(nodes[k, 1], want, abs_tol=1e-9) and math.isclose(nodes[n + k, 1], want, abs_tol=1e-9)
            for a, b in itertools.product((0, 1), repeat=2) if k else ():
                assert math.isclose(edges[k, a, b], sum(w for s, w in weights.items() if (s[page.parents[k]], s[k]) == (a, b)) / z, abs_tol=1e-9)


TEXT = [
    "Harbour plans delayed until spring",
    "The council voted on Tuesday to postpone the rebuilding of the old harbour, citing costs that have doubled since the first estimate was made.",
    "Residents had hoped that work would begin in October. Several of them spoke at length during the hearing.",
    "What happens next",
    "A second vote is expected in March, when the engineers present their revised drawings to the public.",
]


def test_hand_written_pages():
    """Layouts written by hand: their class names are none of the words that the model knows."""
    h, a, b, c, d = TEXT
    pages = [
        f"<html><body><nav><a href=/>Start</a> <a href=/n>News</a></nav><article><h1>{h}</h1><p>{a}</p><p>{b}</p><h2>{c}</h2><p>{d}</p></article><footer><p>Harbour Times 2024</p></footer></body></html>",
        f"<body><header><p>Harbour Times</p><ul><li><a href=/1>Politics</a><li><a href=/2>Sport</a></ul></header><main class=zx><h1>{h}</h1><p>{a}</p><p>{b}</p><h2>{c}</h2><p>{d}</p></main><aside><h3>Weather</h3><p>Rain.</p></aside><footer>Imprint</footer>",
        f"<body><div class=qq1><ul><li><a href=/1>Home</a></li><li><a href=/2>Local</a></li><li><a href=/3>World</a></li></ul></div><article class=kk><h1>{h}</h1><div><p>{a}</p></div><p>{b}</p><h2>{c}</h2><p>{d}</p></article><form><label>Mail</label><input><button>Go</button></form>",
        f"<body><main><article><h1>{h}</h1><p>{a}<p>{b}<h2>{c}</h2><p>{d}</article></main><aside><p>Advertisement</p></aside><footer><a href=/a>About us</a> <a href=/b>Jobs</a></footer>",
    ]
    for page in pages:
        assert one(page) == "\n".join(TEXT), page


def test_silent_blocks_and_formulas_stay():
    assert one(f'<article>{ARTICLE}<p aria-hidden="true">A visible paragraph that screen readers skip.</p></article>') == WANT + "\nA visible paragraph that screen readers skip."
    formula = "<math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>x+1</annotation></semantics></math>"
    assert one(f"<article>{ARTICLE}<p>Here a {formula} formula stands.</p></article>") == WANT + "\nHere a x+1 formula stands."
    assert one(f"<article>{ARTICLE}<p hidden>Not shown.</p></article>") == WANT


def test_inline_nodes():
    inside = lambda x: f"<article>{ARTICLE}<p>Before the words {x}and after them.</p></article>"
    for advert in (
        "<span class=advert>Buy this now, it is cheap.</span> ",
        "<ad-slot>Buy this now, it is cheap.</ad-slot> ",
        '<ins class="adv promo"><b>Buy</b> this <i>now</i>.</ins> ',
        "<span hidden>not shown</span> ",
        '<span style="color:red; display: none">not <b>shown</b></span> ',
        "<b style='visibility:hidden'>not shown</b> ",
    ):
        assert one(inside(advert)) == WANT + "\nBefore the words and after them.", advert
    for kept in ("<span class=text>in a span</span> ", "<b class=c17>in a span</b> ", '<span style="color:red">in a span</span> ', "<em>in a span</em> "):
        assert one(inside(kept)) == WANT + "\nBefore the words in a span and after them.", kept
    assert one(f'<article>{ARTICLE}<p style="display:none">Not shown.</p><div style="DISPLAY:NONE"><p>Not shown.</p></div></article>') == WANT
    # unclosed and crossed inline nodes end with the block around them
    page = parse("<div><p>a<span class=ad>b<b>c</span>d</b>e<p>f<x-y>g<div>h</div>i</x-y>j</div>k")
    assert [t for _, t in blocks(page)] == ["abcde", "fg", "h", "ij", "k"]
    assert [(page.tags[k], t) for k, t in owned(page)] == [("p", "ade"), ("span", "bc"), ("p", "f"), ("x-y", "g"), ("div", "h"), ("div", "ij"), ("html", "k")]


def test_the_title_in_an_articles_header_stays():
    h, a, b, c, d = TEXT
    for header in (f"<header><h1>{h}</h1></header>", f"<header class=zz><h1>{h}</h1></header>"):
        page = f"<body><header><p>Harbour Times</p></header><nav><a href=/>Start</a></nav><article>{header}<p>{a}</p><p>{b}</p><h2>{c}</h2><p>{d}</p></article><footer>Imprint</footer></body>"
        assert one(page) == "\n".join(TEXT), header
