import math
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from trapline.llm.html_text import _content, extract, main_text, tree

SENTENCE = "Some long enough sentence of the article that goes on, with commas and words, number %d of many."


def paragraphs(first, last):
    return "".join(f"<p>{SENTENCE % i}</p>" for i in range(first, last))


def blocks(first, last, title="Title"):
    return "\n\n".join([title] * bool(title) + [SENTENCE % i for i in range(first, last)])


PAGES = {
    "no semantic tags": (
        '<html><head><title>x</title></head><body><div id="header"><a href=/>Home</a></div><div class="layout"><div class="post">'
        f'<h1>Title</h1><div class="body">{paragraphs(0, 5)}</div></div><div class="sidebar-left"><p>Side text about things</p><a href=1>one</a></div>'
        f'</div><div id="comments"><p>{SENTENCE % 9}</p><p>{SENTENCE % 8}</p></div><div class=footer>(c) 2020</div></body></html>',
        blocks(0, 5),
    ),
    "main": (
        f'<body><header><h1>Site</h1></header><main><h1>Title</h1>{paragraphs(0, 3)}<form><p>sign up please</p><input></form>'
        f'<div class="cookie-notice">We use cookies</div></main><aside>{paragraphs(3, 5)}</aside></body>',
        blocks(0, 3),
    ),
    "header and comments inside": (
        f'<article><header><h1>Title</h1></header>{paragraphs(0, 3)}<section class="comments">{paragraphs(4, 9)}</section><footer>by me</footer></article>',
        blocks(0, 3),
    ),
    "comments as articles": (
        f'<article><h1>Title</h1>{paragraphs(0, 2)}</article><div class="comment-list"><article class="comment">{paragraphs(5, 9)}</article></div>',
        blocks(0, 2),
    ),
    "short article": ("<nav><a href=1>a</a></nav><article><p>Hi.</p></article><footer>&copy; all rights reserved by nobody</footer>", "Hi."),
    "no tags": ("just text", "just text"),
    "breaks and references": ("<body>one<br>two &amp; three&nbsp;four &#x41;&#66;</body>", "one two & three four AB"),
    "list without end tags": (f"<article><h1>Title</h1>{paragraphs(0, 2)}<ul><li>a<li>b</ul></article>", blocks(0, 2) + "\n\na\n\nb"),
    "open comment": (f"<article><h1>Title</h1>{paragraphs(0, 2)}<!-- oops", blocks(0, 2)),
    "script": (f'<article><h1>Title</h1><script>if (a<b) "</p>"</script>{paragraphs(0, 2)}</article>', blocks(0, 2)),
    "cut off in a tag": (f"<article><h1>Title</h1>{paragraphs(0, 2)}<p cla", blocks(0, 2)),
    "nothing left": ("<nav>a</nav><script>b</script>", ""),
    "empty": ("", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, expected = PAGES[name]
    assert main_text(html) == expected


@pytest.mark.parametrize("html", ["<div>" * 20_000 + "x", "<b>" * 50_000, "<p" * 50_000, '"<a href="' * 20_000, "<!--" * 50_000, "</i>" * 50_000, "<i>" + "<b>" * 30_000 + "</u>" * 30_000])
def test_hostile_pages_take_no_time(html):
    assert len(main_text(html)) <= len(html)


def test_every_page_of_the_table(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    found = {r.page_id: r for r in extract(pages).collect()}
    for row in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", row.html, re.S)[1]
        parts = [re.sub(r"<(/?[a-z][^>]*)(>|$)|</?$", "", p.replace("<br>", " ")) for p in re.split(r"</?(?:p|h1)>", body)]
        expected = "\n\n".join(t for t in (" ".join(unescape(p).split()) for p in parts) if t)
        assert (found[row.page_id].text, found[row.page_id].n_chars) == (expected, len(expected))


def test_odd_rows(spark):
    data = [(1, "u", None), (2, None, "<p>é text</p>"), (None, "u", "<p>x</p>"), (2, None, "<p>é text</p>")]
    df = spark.createDataFrame(data, "page_id bigint, url string, html string").withColumn("text", F.lit("other"))
    rows = sorted((r.page_id or 0, r.text, r.n_chars) for r in extract(df).collect())
    assert rows == [(0, "x", 1), (1, "", 0), (2, "é text", 6), (2, "é text", 6)]
    assert extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-comments", "page-with-nav", "social-science", "search-result-page"])
def test_layout_names_leave_the_article(name):
    side = '<div class="sidebar"><p>Side text about things</p></div>'
    assert main_text(f'<body><div class="{name}"><h1>Title</h1>{paragraphs(0, 3)}{side}</div><div class=footer>(c) 2020</div></body>') == blocks(0, 3)
    assert main_text(f'<div class="{name}"><article><p>Hi.</p></article></div><div class="promo"><p>{SENTENCE % 1}</p></div>') == "Hi."


def test_formulas_and_labels_stay():
    html = f"<article><p>Let <math><mi>x</mi></math> be a <label>name</label>.</p>{paragraphs(0, 2)}</article>"
    assert main_text(html) == "Let x be a name.\n\n" + blocks(0, 2, "")


WHOLE = f"<h1>Title</h1>{paragraphs(0, 3)}"


@pytest.mark.parametrize(
    "html",
    [
        f'<body><form method=post><input name=a><div><article>{WHOLE}</article></div></form></body>',
        f'<body><form id=aspnetForm><div class=page><div>{WHOLE}</div></div><select><option>x</select></form></body>',
        f'<body><div data-title="The hidden cost of tea"><article>{WHOLE}</article></div></body>',
        f"<body><div class='prose hidden md:block'>{WHOLE}</div><p class=x>x</p></body>".replace("<p class=x>x</p>", ""),
        f'<article><h1>Title</h1><section aria-label="A hidden gem in town">{paragraphs(0, 3)}</section></article>',
        f'<article><h1 id="social">Title</h1><section id="related-work">{paragraphs(0, 3)}</section></article>',
        f'<article>{WHOLE}</article><ol class="commentlist"><li>{SENTENCE % 7}</li></ol>',
        f'<article>{WHOLE}</article><div class="userComments"><p>{SENTENCE % 7}</p></div>',
        f"<article>{WHOLE}</article><div>Copyright 2024 by the people who made this. All rights reserved.</div>",
        f"<article><!-- a --!>{WHOLE}</article>",
        f"<article><!-->{WHOLE}<!---></article>",
        f"<article><h1 title=it's>Title</h1>{paragraphs(0, 3)}</article>",
        f'<article>{WHOLE}<div style="display: none">x</div><p hidden>y</p><p aria-hidden="true">z</p></article>',
        f'<article>{WHOLE}<form><p>sign up please</p><input></form><div id="comments"><p>{SENTENCE % 7}</p></div></article>',
    ],
)
def test_articles_stay_whole(html):
    assert main_text(html) == blocks(0, 3)


def test_anchors_inside_an_article_are_no_roles():
    html = f'<article><h1>Title</h1><h2 id="comment-on-method">Comment</h2><p id="search">{SENTENCE % 0}</p><h2 id="social-science">Science</h2></article>'
    assert main_text(html) == f"Title\n\nComment\n\n{SENTENCE % 0}\n\nScience"


def naive_text(node, whole=None):
    """Density selection by its definition: every count taken anew from the subtree, on trees without names."""
    def chars(n):
        return sum(len(" ".join(p.split())) if isinstance(p, str) else chars(p) for p in n.parts)

    def tags(n):
        return sum(0 if isinstance(p, str) else 1 + tags(p) for p in n.parts)

    def links(n):
        if n.tag == "a":
            return chars(n), tags(n) + 1
        inner = [links(p) for p in n.parts if not isinstance(p, str)]
        return sum(c for c, _ in inner), sum(t for _, t in inner)

    body = links(node)[0] / max(chars(node), 1)

    def density(n):
        c, t, (lc, lt) = chars(n), max(tags(n), 1), links(n)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + body * c + math.e)
        value = math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0))
        return c / t * value / math.log(base) if base > 1 + 1e-9 else c / t * value

    def total(n):
        return sum(len(" ".join(p.split())) if isinstance(p, str) else density(p) for p in n.parts)

    def nodes(n):
        yield n
        for p in n.parts:
            if not isinstance(p, str):
                yield from nodes(p)

    best = max(nodes(node), key=total)
    path = [n for n in nodes(node) if any(m is best for m in nodes(n))]
    threshold = min(map(density, path))

    def pick(n):
        if n is best or n not in path and n.tag in ("div", "p") and chars(n) and density(n) >= threshold > 0:
            return [n]
        return [m for p in n.parts if not isinstance(p, str) for m in pick(p)]

    return [" ".join("".join(t for t in flat(n)).split()) for n in pick(node)]


def flat(n):
    for p in n.parts:
        if isinstance(p, str):
            yield p
        else:
            yield from flat(p)


@pytest.mark.parametrize("seed", range(60))
def test_density_selection_by_its_definition(seed):
    pick = random.Random(seed)

    def grow(depth):
        if depth == 0 or pick.random() < 0.3:
            words = " ".join("w" * pick.randrange(1, 9) + str(pick.randrange(10**6)) for _ in range(pick.choice([1, 3, 12, 40])))
            return pick.choice([f"<p>{words}</p>", f"<p>{words} <a href=x>{words[:20]}</a></p>", f"<a href=y>{words[:15]}</a>"])
        return f"<div>{''.join(grow(depth - 1) for _ in range(pick.randrange(1, 5)))}</div>"

    html = "<body>" + "".join(grow(4) for _ in range(3)) + "</body>"
    found = [" ".join("".join(flat(n)).split()) for n in _content(tree(html))]
    assert found == naive_text(tree(html))
