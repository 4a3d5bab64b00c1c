"""Pages by hand, the style tree against one merged in plain Python, and pages whose names tell nothing."""

import collections
import math
import random

from tidemark.llm import html_extract
from tidemark.llm.html_extract import GAMMA, LEAST_PAGES, LOW, Page

SCHEMA = "page_id long, url string, html string"


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><li>menu</ul></nav><header>Top</header><div class='promo x'>buy</div><article><h1>Head</h1><p>One <b>t</b>wo<br>three &amp; <p>four<script>var a='<p>';</script><div id=comments>c</div></article><footer>f</footer></body></html>"
    common = "<body><div class=a>Same on all</div><div class=b>Text {0} of page {0}</div></body>"
    rows = [(1, "http://a.b/1", page), (2, None, None), (3, "http://a.b/2", "no <markup")] + [(10 + i, f"http://h.x/{i}", common.format(i)) for i in range(6)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head One two three & four" and got[2].text == "" and got[3].text.startswith("no")
    assert got[10].text == "Text 0 of page 0" and got[10].n_chars == 16
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def extracted(spark, pages):
    rows = [(i, f"http://h.x/{i}", html) for i, html in enumerate(pages)]
    return [r.text for r in sorted(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())]


def test_html_tree_judges_inside_the_article(spark):
    own = lambda i: f"Own words {i} of page {i}"
    pages = [f"<body><main><p>Body {i}</p><article><p>{own(i)}</p><div class=box>Read our rules</div></article></main></body>" for i in range(6)]
    assert extracted(spark, pages) == [f"Body {i} {own(i)}" for i in range(6)]
    # Copies of one page are no boilerplate.
    assert extracted(spark, pages[:1] * 5) == [f"Body 0 {own(0)} Read our rules"] * 5


def test_html_host_size_changes_nothing(spark):
    page = lambda i: f"<div class=text>Own words {i} of {i * i}</div>" + "<div class=campaign>Closed today</div>" * (i < 4)
    for n in (20, 400):
        assert extracted(spark, [page(i) for i in range(n)]) == [f"Own words {i} of {i * i}" for i in range(n)]


def test_html_words_around_the_article(spark):
    text = "<p>Text</p><div class=comments>c</div>"
    pages = [f"<body class=has-sidebar><article>{text}</article></body>", f"<body><article class='post has-sidebar'>{text}</article></body>", f"<div class=with-sidebar><main>{text}</main></div>",
             f"<div class=with-sidebar>s<article>{text}</article></div>", f"<article>{text}<article class=comment>no</article></article><div class=ad>a</div>", "<div class=ad>a</div><nav>n</nav>"]
    assert extracted(spark, pages) == ["Text"] * 5 + [""]


def test_text_that_stays(spark):
    text = "Real text of this page"
    pages = [
        f"<main><h1>Title</h1><p>Introduction</p><article><p>{text}</p></article></main>",
        f"<div>{text}</div><article>Teaser</article>",
        f"<article><p>{text}</p><p class='post-share-price'>Costs 5</p></article>",
        f"<article><p>{text} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <object>and more</object></p></article>",
        f"<article><p>{text}<button>Send</button> <span class=share-buttons>Share</span>on</p><select><option>One</select><p>End",
        f"<article><xmp>{text}</xmp><p>a<p>b</article>",
    ]
    assert extracted(spark, pages) == [f"Title Introduction {text}", f"{text} Teaser", f"{text} Costs 5", f"{text} x=2 and more", f"{text} on End", f"{text} a b"]


def test_deep_and_long_markup():
    page = Page("<div>x" * 20_000 + "<p>end")
    assert len(page.blocks) == 20_001 and len(page.nodes()) == 20_001
    assert Page("<p>" + "y " * 500_000).blocks[0][0] == " ".join(["y"] * 500_000)
    assert [b[0] for b in Page("a<script>no</scrip").blocks] == ["a"] and [b[0] for b in Page("<<p <a 'b>c").blocks][:1]


def some_pages(seed=0):
    """Hosts whose templates repeat branches under names that tell nothing, and text of each page's own."""
    rng = random.Random(seed)
    rows = []
    for h in range(4):
        fixed = [f"<div class=z{'abc'[k]}><span>Same {h} {k}</span><i>words</i></div>" for k in range(3)]
        for i in range((3, 4, 9, 15)[h]):
            own = [f"<div class=q{'abcd'[k]}><p>Text {rng.random()}</p><p>{rng.choice('abc')}</p></div>" for k in range(rng.randint(1, 4))]
            parts = own + [f for f in fixed if rng.random() < 0.7]
            rng.shuffle(parts)
            rows.append((len(rows), f"https://user@H{h}.x:80/{i}", f"<body><section>{''.join(parts)}</section><section><div>{rng.choice(['Yes', 'No'])}</div></section></body>"))
    return rows + [(100, rows[-1][1], rows[-1][2]), (100, rows[-1][1], rows[-1][2]), (101, None, "<p>x"), (102, None, None), (103, "no url", "")]


def brute(rows):
    """The texts by a style tree of paths, merged host by host."""
    pages = []
    for i, url, html in rows:
        page = Page(html or "")
        host = (url or "").split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].lower() if "://" in (url or "") else ""
        pages.append((i, host, page))
    seen = collections.defaultdict(set)
    for _, host, page in pages:
        for node, _, style, content in page.nodes():
            seen[host, node].add((tuple(b[0] for b in page.blocks), style, content))

    def entropy(values):
        n = len(values)
        return 1.0 if n < 2 else -sum(c / n * math.log(c / n, n) for c in collections.Counter(values).values())

    low = {k for k, v in seen.items() if len(v) >= LEAST_PAGES and (1 - GAMMA) * entropy([s for _, s, _ in v]) + GAMMA * entropy([c for _, _, c in v]) <= LOW}
    out = []
    for i, host, page in pages:
        def stays(node):
            return not node or (host, node) not in low and stays(page.parents[node])
        out.append((i, " ".join(text for text, node in page.article() if stays(node))))
    return sorted(out), low


def test_style_tree_matches_one_in_plain_python(spark):
    rows = some_pages()
    want, low = brute(rows)
    df = spark.createDataFrame([(*r, 1, "c", 2) for r in rows], SCHEMA + ", text int, host string, `a.b` int")
    got = sorted((r.page_id, r.text) for r in html_extract.extract(df).collect())
    assert got == want and len(low) >= 6
    text = dict(want)
    assert not any("Same 2" in t or "Same 3" in t for t in text.values()) and any("Same 0" in t for t in text.values())
    assert all("Text" in t for i, t in want if i < 100)
