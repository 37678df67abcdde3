import html
import random
import re
import time

from corpusgraph.llm import html_extraction as H
from corpusgraph.llm.html_extraction import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1><nav><ul><li><a href=x>Menu</a></ul></nav></header><div class="cookie-notice"><p>We use cookies, ok, yes, and so on for a long text.</p></div>
<div id=content><h2>Title &amp; more</h2><p>First paragraph, with commas,\n and  text that is long enough &eacute;.<p><b>Second <i>one</b>, also quite long, yes it is indeed.<br>
<blockquote><p>Quoted.</p></blockquote><ul><li>item one<li>item two</ul><table><tr><td>a<td>b</tr></table><form>no <input></form><!-- gone, gone -->
<div class="related"><ul><li><a href=1>other, story, with, commas</a></ul></div></div>
<section class="comments"><p>A reader says, hello, a long comment, a long comment, long.</p></section>
<aside><p>side, bar, text, which, is, long, with, many, commas, and more</p></aside><footer>&copy; 2000</footer></body></html>"""


def test_keeps_the_article_only():
    assert main_text(PAGE).split("\n\n") == [
        "Title & more", "First paragraph, with commas, and text that is long enough é.", "Second one, also quite long, yes it is indeed.",
        "Quoted.", "item one", "item two", "a b",
    ]


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<script>x") == main_text("<nav>menu</nav>") == ""
    assert main_text("plain text only") == "plain text only"
    assert main_text("<article><h1>Head") == "Head"
    assert main_text("<div>" * 5000 + "deep text, deep" + "</div>" * 5000) == "deep text, deep"
    assert main_text("<article><p>cut of") == "cut of"
    assert main_text("<p>a &lt;b&gt; &#233; &nosuch; 1 < 2</p>") == "a <b> é &nosuch; 1 < 2"
    assert len(main_text("<p>" + "long words, " * 100_000 + "</p>")) == 12 * 100_000 - 1


def test_generated_pages_match_their_template(spark, sf):
    """The driver's pages are one template: its headline and paragraphs, found by plain patterns."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for page in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", page.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>|<br>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body))
        want = "\n\n".join(x for x in parts if x)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (want, len(want), page.url)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, PAGE, "x"), (1, "u", None, "y"), (None, "u", "", None)], "page_id long, url string, html string, text string")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(str(r.page_id) + str(r.n_chars > 0) for r in out.collect()) == ["1False", "1True", "NoneFalse"]
    assert extract(df.limit(0)).count() == 0


def test_all_sections_of_pages_without_an_article():
    """Pages of several sections in div and main wrappers: every heading and paragraph, in order."""
    many = [f"Paragraph {i}, with commas, more commas, and words enough to score well in the first section." for i in range(30)]
    long = "One long paragraph, of a second section, that has four commas, no more, " + "and many words " * 60 + "in all."
    junk = '<div id=nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div>'
    end = "<div>&copy; 2000 Example Inc. All rights reserved.</div><div><a href=1>Terms</a> <a href=2>Privacy</a></div>"
    for open_, close in (("<div id=content>", "</div>"), ("<main>", "</main>"), ("", ""), ("<div><div>", "</div></div>"), ("<table><tr><td>", "</td></tr></table>")):
        for a, b in (("<div>", "</div>"), ("<section>", "</section>"), ("<section><div>", "</div></section>")):
            body = ["<h2>A</h2>", a, *(f"<p>{x}</p>" for x in many), b, "<h2>B</h2>", f"{a}<p>{long}</p>{b}", "<h3><a href=#c>C</a></h3>", "<ul><li>a short item</ul>", f"{a}<p>Yes.</p>{b}", "Loose text.", f"{a}<p>Fin.</p>{b}"]
            got = main_text(f"<html><body>{junk}{open_}{''.join(body)}{close}{end}</body></html>").split("\n\n")
            assert got == ["A", *many, "B", long.strip(), "C", "a short item", "Yes.", "Loose text.", "Fin."], (open_, a)


PROSE = "<p>A paragraph, with commas, and words enough to be prose of an article.</p>"
LINE = PROSE[3:-4]


def test_class_words_do_not_empty_a_page():
    side = '<div class="sidebar"><p>Short, aside.</p></div>'
    for name in ("content has-sidebar", "post ad-free", "entry no-comments", "tabs-menu content", "main with-widgets", "sidebar-right"):
        assert main_text(f'<body><div class="{name}">{PROSE * 4}</div>{side}</body>').split("\n\n") == [LINE] * 4, name
    for name in ("comments", "comment-list", "cookie-notice", "ads"):
        assert main_text(f'<body><div>{PROSE}</div><div class="{name}">{PROSE * 9}</div></body>') == LINE, name
    assert main_text(f'<body><article>{PROSE}</article><div class="sidebar-left">{PROSE * 9}</div></body>') == LINE


def test_siblings_lists_of_links_headers_and_broken_quotes():
    assert main_text(f"<body><article>{PROSE}</article><article>{PROSE}</article>") == f"{LINE}\n\n{LINE}"
    refs = "<ul><li><a href=1>Ref one</a><li><a href=2>Ref two</a></ul>"
    menu = "<ul><li><a href=1>Home</a><li><a href=2>News</a></ul>"
    assert main_text(f"<body><div>{menu}{PROSE}<h2>References</h2>{refs}</div>").split("\n\n") == [LINE, "References", "Ref one", "Ref two"]
    assert main_text(f"<body><div>{menu}{PROSE}{refs}{PROSE}{menu}</div>").split("\n\n") == [LINE, "Ref one", "Ref two", LINE]
    assert main_text(f"<body><p title='it's broken'>Text, here it's fine.</p>{PROSE}") == f"Text, here it's fine.\n\n{LINE}"
    assert main_text(f'<p title="open>Text, one, two.</p>{PROSE}') == f"Text, one, two.\n\n{LINE}"
    assert main_text(f"<body><div><header><h1>Title</h1></header><div>{PROSE}</div></div>") == f"Title\n\n{LINE}"
    assert main_text(f"<body><header><h1>Site</h1></header><div>{PROSE}</div>") == LINE


def test_broken_pages_take_time_in_proportion():
    def took(page):
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    assert took("</p>" * 1_000_000) < 10
    for deep, stray in (("<div>", "</p>"), ("<ul><li><div>", "<li></li>"), ("<div>", "</div><div>")):
        one, four = (took(deep * n + stray * n) for n in (10_000, 40_000))
        assert four < 10 * one + 0.5


def brute_best(root):
    """Points of each container by the rule, written as sums over all pairs of a text and an ancestor."""
    def nodes(x):
        return [] if x.drop else [x, *(y for c in x.children if isinstance(c, H.Node) for y in nodes(c))]

    def under(x):
        return [(t, link) for y in nodes(x) for t, _, link in [H._own_text(y)]]

    every, points = nodes(root), {}
    for x in every:
        text, own, links = H._own_text(x)
        if not own:
            continue
        worth = min(1, own / 25) + sum(text.count(c) for c in ",，、") + min(own / 100, 3) if x.tag in H.TEXT_BLOCKS and 2 * links <= own else 0
        up = x if x.tag in ("div", "section", "article", "main", "body", "html") else x.parent
        if x.tag in H.HEADINGS and x.parent is not None:
            up, worth = x.parent, 0
            points[id(up)] = points.get(id(up), 0) + 0.1
        for level in range(1, 7):
            if up is not None and worth:
                points[id(up)] = points.get(id(up), 0) + worth * {1: 1, 2: 1 / 2}.get(level, 1 / (3 * level))
                up = up.parent
    value = {}
    for x in every:
        chars, links = sum(len(t) for t, _ in under(x)), sum(n for _, n in under(x))
        value[id(x)] = points.get(id(x), 0) * (1 - links / chars) if chars else 0
    return max(value.values(), default=0), value


def test_scores_match_brute_force_on_random_trees():
    rng = random.Random(4)

    def tree(depth):
        kind = rng.choice(["div", "section", "p", "ul", "blockquote", "h2"] if depth else ["p", "li", "h3", "div"])
        inner = "".join(tree(depth - 1) for _ in range(rng.randrange(1, 4))) if depth and kind not in ("p", "h2") else ""
        words = " ".join(rng.choice(["word", "a, b,", "<a href=x>link text</a>", "longer words here"]) for _ in range(rng.randrange(0, 9)))
        return f"<{kind}>{words}{inner}</{kind}>"

    for _ in range(200):
        page = "<body>" + "".join(tree(3) for _ in range(3))
        root = H.parse(page)
        best = H.score(root)
        most, value = brute_best(root)
        assert (best is None) == (most <= 0)
        assert best is None or abs(value[id(best)] - most) < 1e-9


SECTION_IDS = "related-work search-algorithms social-media notice-period navigation sharing-data alert-system comments-on-method skip-lists login-flow advertising response".split()


def test_sections_keep_whatever_their_heading_s_slug_says():
    one, two = "<p>The first paragraph of it, long enough to be prose of an article.</p>", "<p>The second one, which follows, is a paragraph as well.</p>"
    for name in SECTION_IDS:
        for title in (name.replace("-", " ").capitalize(), "A heading of another kind"):
            body = f'<section><h2>Before</h2>{PROSE * 2}</section><section id="{name}"><h2>{title}</h2>{one}{two}</section><section><h2>After</h2>{PROSE * 2}</section>'
            got = main_text(f"<body><nav><a href=/>Home</a></nav><article><h1>T</h1>{body}</article><footer>Foot</footer>").split("\n\n")
            assert got == ["T", "Before", LINE, LINE, title, one[3:-4], two[3:-4], "After", LINE, LINE], (name, title)
    assert main_text(f'<body><div>{PROSE * 2}<div id="notice-period"><h2>The notice period</h2>{one}</div>{PROSE}</div>').split("\n\n") == [LINE, LINE, "The notice period", one[3:-4], LINE]


def test_clutter_in_an_article_still_goes():
    head = f"<body><article><h1>T</h1>{PROSE * 3}"
    for clutter in (
        '<section id="comments"><h2>Comments</h2><p>I like it, very much so.</p><p>And so do I, my friend.</p></section>',
        '<section id="reader-comments"><h2>Reader comments</h2><div class="c"><b>Ann</b><p>I like it, very much so.</p></div><div class="c"><b>Bob</b><p>And so do I, my friend.</p></div></section>',
        '<section id="login-flow"><h2>Login flow</h2><p>Please type your name, and then your password.</p><form><input></form></section>',
        '<div id="related-posts"><h3>Related posts</h3><ul><li><a href=1>One of them</a><li><a href=2>Another one</a></ul></div>',
        '<div class="newsletter"><h3>Newsletter</h3><p>Every week, free of charge.</p><p>We never share it, promised.</p></div>',
        '<div class="sidebar"><h3>About</h3><p>This is about us, and nobody else.</p><p>We are few, but we are many.</p></div>',
        '<div class="ad"><h3>Buy</h3><p>This is what you need, today.</p><p>And tomorrow, as well.</p></div>',
        '<p><b>Related</b></p><ul><li><a href=1>One of them</a><li><a href=2>Another one</a></ul>',
    ):
        got = main_text(f"{head}{clutter}{PROSE}</article>").split("\n\n")
        assert got == (["T", LINE, LINE, LINE, LINE] if "<b>Related" not in clutter else ["T", LINE, LINE, LINE, "Related", "One of them", "Another one", LINE]), clutter
    tail = main_text(head + "<p><b>Related</b></p><ul><li><a href=1>One of them</a><li><a href=2>Another one</a></ul></article>").split("\n\n")
    assert tail == ["T", LINE, LINE, LINE, "Related"]


def test_code_anchors_and_sources():
    code = '<pre><code><span class="k">if</span> x: <span class="comment"># a note</span></code></pre><p>See <code class="x"><span class="ad">ad</span></code>, please.</p>'
    assert main_text(f"<body><article>{PROSE}{code}{PROSE}</article>").split("\n\n") == [LINE, "if x: # a note", "See ad, please.", LINE]
    assert main_text(f'<body><article>{PROSE}<p id="comment-1">A remark, on the text.</p>{PROSE}</article>').split("\n\n") == [LINE, "A remark, on the text.", LINE]
    refs = "<ul><li><a href=1>Ref one</a><li><a href=2>Ref two</a></ul>"
    assert main_text(f"<body><article>{PROSE}<p><b>Sources</b></p>{refs}</article>").split("\n\n") == [LINE, "Sources", "Ref one", "Ref two"]


def plain_text(page):
    """Another extractor, for well-formed pages without clutter: blocks of a parsed XML tree in order."""
    import xml.etree.ElementTree as ET

    out = [[]]

    def walk(e):
        block = e.tag in H.BLOCKS
        if block:
            out.append([])
        out[-1].append(e.text or "")
        for c in e:
            walk(c)
            out[-1].append(c.tail or "")
        if block:
            out.append([])

    walk(ET.fromstring(page))
    texts = [" ".join("".join(x).split()) for x in out]
    return "\n\n".join(t for t in texts if t)


def test_text_matches_another_parser_on_random_articles():
    rng = random.Random(8)
    words = ["one", "two,", "<b>three</b>", "four", '<a href="x">five</a>', "<i>six, <code>seven</code></i>"]

    def para(kind="p"):
        return f"<{kind}>{' '.join(rng.sample(words, 4))} and a few words more, so that it is prose of an article in itself.</{kind}>"

    def block(depth):
        kind = rng.choice(["p", "p", "p", "section", "div", "blockquote", "ul", "pre"] if depth else ["p"])
        if kind in ("p", "pre"):
            return para(kind)
        if kind == "ul":
            return "<ul>" + "".join(para("li") for _ in range(rng.randrange(1, 4))) + "</ul>"
        name = rng.choice(["", f' id="{rng.choice(SECTION_IDS)}"']) if kind == "section" else ""
        title = "<h2>A title</h2>" if kind != "blockquote" else ""
        return f"<{kind}{name}>{title}{para()}" + "".join(block(depth - 1) for _ in range(rng.randrange(1, 4))) + f"{para()}</{kind}>"

    for _ in range(150):
        article = "<article><h1>Title</h1>" + "".join(block(3) for _ in range(rng.randrange(1, 5))) + para() + "</article>"
        page = f"<html><body><nav><a href='/'>Home</a></nav><div class='ad'>Buy it now.</div>{article}<div class='comments'><p>I like it.</p></div><footer>Foot</footer></body></html>"
        assert main_text(page) == plain_text(article)
