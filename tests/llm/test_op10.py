import json
import random

import pytest

from granary.llm import queries, wrappers


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def page_article(rng, k):
    paragraphs = [words(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
    title = words(rng, 4)
    ad = f'<div class="ad">{words(rng, 5)}</div>' if k % 2 else ""
    body = "".join(f"<p>{p}" + ("</p>" if rng.random() < 0.5 else "") for p in paragraphs)
    nav = "".join(f"<li><a href='/{i}'>{words(rng, 1)}</a>" for i in range(rng.randrange(1, 5)))
    page = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul>{nav}</ul></nav>{ad}
    <div class="cookie-notice"><p>We use cookies</p></div><article class="post-{k}"><h1>{title}</h1>{body}<aside><p>See also</p></aside><section class="comments"><p>First!</p></section></article>
    <aside><p>{words(rng, 20)}</p></aside><form><p>Search</p><button>Go</button></form><footer>&copy; x"""
    return page, "\n".join([title, *paragraphs])


def page_div(rng, k):
    paragraphs = [words(rng, rng.randrange(15, 40)) for _ in range(rng.randrange(2, 6))]
    page = f'<html><body><div id="menu"><ul><li>Home</li><li>News</li></ul></div><div class="wrap"><div class="text">{"".join(f"<p>{p}</p>" for p in paragraphs)}</div><div class="sidebar"><p>{words(rng, 9)}</p></div></div><div id="footer">All rights</div></body></html>'
    return page, "\n".join(paragraphs)


def test_query_on_two_kinds_of_hosts_and_odd_pages(spark, tmp_path):
    rng = random.Random(6)
    rows, want = [], {}
    for k in range(60):
        page, text = (page_article if k % 2 else page_div)(rng, k)
        rows.append((k, f"http://{'a' if k % 2 else 'b'}.example.com/{k}", page))
        want[k] = text
    odd = [
        (100, None, None, ""), (101, "http://a.example.com/x", "", ""), (102, "no url", "<article><p>a&nbsp;&lt;b&gt;  <b>c</b>d<br>e &#233;&amp", "a <b> cd e é&"), (103, "http://[bad", "plain < text", "plain < text"),
        (104, "http://a.example.com/y", "<article>" + "<p>same words</p>" * 3000 + "</article", "\n".join(["same words"] * 3000)), (105, "http://a.example.com/z", "<!-- open", ""), (106, "http://c.example.com", "<article><p>x</p><p a='>'>y</p></article><p b=\"", "x\ny"),
    ]
    rows += [o[:3] for o in odd]
    want |= {o[0]: o[3] for o in odd}
    spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, roots int").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op10_wrappers(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text in want.items():
        assert got[i].text == text, i
        assert got[i].n_chars == len(text)
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert queries.op10_wrappers(spark, f"{tmp_path}/none").count() == 0


def wrapper(*pages):
    got = None
    for page in pages:
        own = wrappers.page_wrapper(page)
        got = own if got is None else wrappers.aligned(got, own)
    return got


def texts(*pages):
    found = json.dumps(wrappers.rules(wrapper(*pages)))
    return [wrappers.main_text(p, found) for p in pages]


def test_alignment_gives_optional_repeated_and_slots():
    pages = ["<div><h1>T</h1><p>one</p><ul><li>x</li><li>y</li></ul></div>", "<div><h1>T</h1><p>two</p><p>three</p></div>", "<div><h1>T</h1><p>four</p></div>"]
    assert wrappers.expression(wrapper(*pages)) == "<div><h1>#TEXT</>(<p>#PCDATA</>)+(<ul>(<li>#PCDATA</>)+</>)?</>"
    # changing classes at one place are one element; other kinds keep their order
    made = wrapper("<body><i></i><div class='a x'>1</div><p>2</p></body>", "<body><div class='b x'>3</div><h2>4</h2><p>5</p></body>")
    assert wrappers.expression(made) == "<body><div.x>#PCDATA</>(<h2>#PCDATA</>)?<p>#PCDATA</></>"


def body(k, inner):
    return f"<html><body>{inner.format(t=f'Title {k}', a=f'first text {k} of the article ' * 4, b=f'second text {k} ' * 9)}</body></html>"


# Each with markers for a page's title and two paragraphs, which are all of the article.
MARKUP = {
    "a form around the page": '<form id="aspnetForm"><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><div><h1>{t}</h1><p>{a}</p><p>{b}</p></div><div class="footer">All rights</div></form>',
    "a class that names a sidebar": '<div class="page has-sidebar"><h1>{t}</h1><p>{a}</p><p>{b}</p><div class="sidebar"><p>Other news</p></div></div>',
    "a section named discussion": '<article><h1>{t}</h1><p>{a}</p><section id="discussion"><p>{b}</p></section></article><footer>x</footer>',
    "a class with the word search": '<div class="search-guide"><h1>{t}</h1><p>{a}</p><p>{b}</p></div><div class=foot>All rights</div>',
    "unnamed menu and footer": '<div><a href=1>Home page</a> <a href=2>All the news</a> <a href=3>About</a></div><h1>{t}</h1><p>{a}</p><p>{b}</p><div>Printed by the same house on every page</div>',
    "a fixed block in the article": '<article><h1>{t}</h1><p>{a}</p><div class="x"><h3>Be there</h3><p>Sign up now, on every page</p></div><p>{b}</p></article>',
    "a heading whose id has a word": '<div><h1 id="comments-on-method">{t}</h1><p>{a}</p><p>{b}</p></div><div class="comments"><p>First! {t}</p></div>',
    "a header in the article": '<header><a href="/">Site</a></header><article><header class="entry-header"><h1>{t}</h1></header><p>{a}</p><p>{b}</p><footer>by me</footer></article>',
    "comments as articles": '<main><h1>{t}</h1><p>{a}</p><p>{b}</p></main><div id="comments"><article class="comment"><p>so {t} it is</p></article><article class="comment"><p>no {t}</p></article></div>',
    "a header with the title": '<div class="header"><h2>Site</h2></div><div class="post-header"><h1>{t}</h1></div><div><p>{a}</p><p>{b}</p></div>',
    "adverts that differ": '<div class="ad">Buy {t} now</div><div class="body"><h1>{t}</h1><p>{a}</p><div class="ad-slot"><p>More {t}</p></div><p>{b}</p></div>',
}


@pytest.mark.parametrize("name", MARKUP)
def test_articles_are_read_through_the_wrapper(name):
    pages = [body(k, MARKUP[name]) for k in range(4)]
    for k, got in enumerate(texts(*pages)):
        assert got == "\n".join([f"Title {k}", (f"first text {k} of the article " * 4).strip(), (f"second text {k} " * 9).strip()])


def links(rng, n):
    return "".join(f'<li><a href="/{i}">{words(rng, rng.randrange(1, 4))}</a></li>' for i in range(n))


def some(rng, tag):
    return "".join(f'<{tag} class="comment"><p class="author">{words(rng, 1)}</p><p>{words(rng, 20)}</p></{tag}>' for _ in range(rng.randrange(5)))


# Layouts as sites have them: the page around a title t, a body b and the number k.
LAYOUTS = {
    "blog": lambda r, t, b, k: f'<body class="post-{k}"><header id="masthead"><h1 class="site-title"><a href="/">My Site</a></h1><nav><ul>{links(r, 5)}</ul></nav></header><div id="page"><main id="main"><article id="post-{k}" class="tag-{words(r, 1)}"><header class="entry-header"><h1>{t}</h1></header><div class="entry-content">{b}</div><footer><a href=x>{words(r, 2)}</a></footer></article><div class="comments-area"><h3>{k} Comments</h3>{some(r, "div")}</div></main><aside><section class="widget"><h2>Recent</h2><ul>{links(r, 4)}</ul></section><section><p>{words(r, 30)}</p></section></aside></div><footer id="colophon"><p>Proudly powered</p></footer></body>',
    "columns": lambda r, t, b, k: f'<body><div id="header"><div class="logo">Daily News</div><div class="menu"><ul>{links(r, 6)}</ul></div></div><div id="wrapper"><div id="left"><ul>{links(r, 5)}</ul></div><div id="content"><h1>{t}</h1>{b}</div><div id="right"><div class="banner">{words(r, 8)}</div><h4>Related</h4><ul>{links(r, 3)}</ul></div></div><div id="footer">All rights reserved.</div></body>',
    "tables": lambda r, t, b, k: f"<body><table><tr><td colspan=3>Site title here</td></tr><tr><td><a href=1>{words(r, 1)}</a><br><a href=2>{words(r, 2)}</a></td><td class=main><h1>{t}</h1>{b}</td><td class=ads>{words(r, 12)}</td></tr><tr><td colspan=3>Footer text of site</td></tr></table></body>",
    "form and sidebar": lambda r, t, b, k: f'<body><form id="aspnetForm"><div class="topbar"><a href=1>In</a> <a href=2>Out</a></div><div class="page has-sidebar"><div class="story"><h1>{t}</h1>{b}</div><section class="reader-comments">{some(r, "div")}</section><div class="sidebar"><p>{words(r, 30)}</p></div></div><div class="footer"><p>Terms and privacy</p></div></form></body>',
    "sections": lambda r, t, b, k: f'<body><div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div><nav>{links(r, 4)}</nav><section class="hero"><h1>{t}</h1></section><section class="text">{b}</section><section class="newsletter"><h3>Stay informed</h3><p>Sign up</p><form><input></form></section><section class="related"><h3>More</h3><div class="card"><a href=1>{words(r, 6)}</a><p>{words(r, 9)}</p></div></section><footer><ul>{links(r, 6)}</ul><p>(c) us</p></footer></body>',
    "roles": lambda r, t, b, k: f'<body><div role="navigation"><a href=1>A</a><a href=2>B</a></div><div role="main"><div class="notice">Down at {words(r, 2)}</div><h1>{t}</h1>{b}<div class="advert"><p>{words(r, 20)}</p></div></div><div role="contentinfo">Imprint</div><div id="disqus_thread"><p>{words(r, 40)}</p></div></body>',
    "title outside": lambda r, t, b, k: f'<body><div class="nav"><a href=1>x</a></div><ul class="breadcrumbs">{links(r, 2)}</ul><div class="title"><h1>{t}</h1></div><div class="article__body">{b}</div><ol class="commentlist">{some(r, "li")}</ol><div class="pagination"><a href=1>1</a><a href=2>2</a></div></body>',
}


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("n", [1, 3, 20])
def test_layouts_of_sites(name, n):
    rng = random.Random(n)
    pages, want = [], []
    for k in range(n):
        title, paragraphs = words(rng, 5), [words(rng, rng.randrange(8, 60)) for _ in range(rng.randrange(1, 7))]
        pages.append(LAYOUTS[name](rng, title, "".join(f"<p>{p}</p>" for p in paragraphs[:1]) + "".join(f"<h2>{p[:9].strip()}</h2><p>{p}</p>" for p in paragraphs[1:]), k))
        want.append("\n".join([title, *paragraphs[:1], *(x for p in paragraphs[1:] for x in (p[:9].strip(), p))]))
    if n == 1 and name == "tables":  # what has no name and is on one page only looks like the article
        return
    assert texts(*pages) == want


def test_a_host_of_several_layouts():
    rng = random.Random(5)
    pages, want = [], []
    for k in range(30):
        title, paragraphs = words(rng, 5), [words(rng, 30) for _ in range(3)]
        pages.append(LAYOUTS["blog" if k % 3 else "columns"](rng, title, "".join(f"<p>{p}</p>" for p in paragraphs), k))
        want.append("\n".join([title, *paragraphs]))
    front = [f'<body><header><h1><a href="/">My Site</a></h1></header><div><ul>{links(rng, 20)}</ul></div><footer><p>Proudly powered</p></footer></body>' for _ in range(5)]
    assert texts(*pages, *front) == want + [""] * 5


def test_shared_headings_stay_with_what_follows_and_copies_are_one_page():
    pages = [f"<body><article><h1>T{k}</h1><p>one {k}</p><h2>Sources</h2><p>two {k}</p><h2>Share</h2><p>now</p></article></body>" for k in range(5)]
    assert texts(*pages) == [f"T{k}\none {k}\nSources\ntwo {k}" for k in range(5)]
    assert texts(*[pages[0]] * 9) == ["T0\none 0\nSources\ntwo 0\nShare\nnow"] * 9
    assert texts("<body><nav><a href=1>a</a></nav></body>") == [""]
    assert texts("<body><div><a href=1>only</a> <a href=2>links</a></div></body>") == ["only links"]


def test_wrappers_do_not_depend_on_partitions(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = [(k, f"http://h{k % 3}.example.com/{k}", page_article(rng, k)[0] if k % 3 else body(k, list(MARKUP.values())[k // 3 % len(MARKUP)])) for k in range(150)] + [(None, None, "<p>x"), (5, "http://h1.example.com", "<p>y"), (5, "http://h1.example.com", "<p>y")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    one, many = frame.coalesce(1), frame.repartition(8, F.rand(4))
    made = [sorted((r.host, r.wrapper) for r in wrappers.infer(f).collect()) for f in (one, many)]
    assert made[0] == made[1]
    made = [sorted(((r.page_id or 0), r.text) for r in wrappers.extract(f, most_broadcast=m).collect()) for f, m in ((one, 1 << 20), (many, 0))]
    assert made[0] == made[1] and len(made[0]) == 153


def test_forms_of_a_host_are_aligned_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FAN_IN", 3)
    frame = spark.createDataFrame([(k, f"<body><h1>t{k}</h1>" + "".join(f"<div class=c{chr(97 + x)}><p>{k}</p></div>" for x in range(6) if k >> x & 1) + "</body>") for k in range(64)], "page_id long, html string").withColumn("url", F_lit("http://a.b"))
    got = wrappers.infer(frame).collect()
    assert len(got) == 1 and got[0].expression.count("<div.c") == 6


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_long_nested_and_unclosed_pages_end():
    deep = "<div>" * 300 + "text" + "</div>" * 10
    assert wrappers.main_text(deep, None) == "text"
    far = "<article>" + "<div>" * 3000 + "<p>one</p><nav><p>menu</p></nav>" + "</div>" * 3000 + "<p>two</p></article><div><p>out</p></div>"
    assert wrappers.main_text(far, None) == "one\ntwo"
    mixed = "<article>" + "".join(f"<h2>{i}</h2><p>p</p><ul><li>x</ul>" for i in range(3000)) + "</article>"
    assert texts(mixed, far)[0].count("\n") == 8999
    kinds = "<body>" + "".join(f'<div class="k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}"><p>t</p></div>' for i in range(3000)) + "</body>"
    assert wrappers.main_text(kinds, None).count("t") == 3000
    assert wrappers.main_text('<article><p>a</p><div hidden><p>b</p></div><div style="display: none"><p>c</p></div><video>no</video><p>d</p></article>', None) == "a\nd"
    assert wrappers.main_text("<a href='" * 2000, None) == ""
    assert wrappers.main_text("<p>x " * 5000, None).count("\n") == 4999
    assert wrappers.main_text("<div>" * 50_000 + "<p>x", None) == "x"


def test_hosts_of_many_kinds_lose_no_article():
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    page = lambda i: f"<body><article class='teaser'><p>short {i}</p></article><article id='{name(i)}'><p>text {name(i)}</p></article><div class='ad {name(i)}'><p>buy</p></div></body>"
    for order in (range(400), range(399, -1, -1)):
        found = wrapper(*map(page, order))
        assert wrappers.expression(found).count("<article") < 5
        found = json.dumps(wrappers.rules(found))
        assert all(wrappers.main_text(page(i), found) == f"short {i}\ntext {name(i)}" for i in range(400))
    plain = lambda i: f"<body><h1>{name(i)}</h1><div class='{name(i)}'><p>text {name(i)}</p></div></body>"
    found = json.dumps(wrappers.rules(wrapper(*map(plain, range(300)))))
    assert all(wrappers.main_text(plain(i), found) == f"{name(i)}\ntext {name(i)}" for i in range(300))


def test_elements_closed_by_a_slash_or_never_drop_nothing_else():
    text = lambda inner: wrappers.main_text(f"<article><p>a</p>{inner}<p>b</p></article>", None)
    for inner in ("<svg class='icon'/>", "<SVG/>", "<svg a=b />", "<iframe src='x'/>", "<button>", "<select>", "<canvas>", "<object data=x>", "<button/><p></p><button>Go</button>", "<svg/><svg><p>x</p></svg>", "<svg><p>x</p></svg>", "<object data=http://x/><p>x</p></object>", "<script src='x'/><p>x</p></script>", "<textarea/><p>x</p></textarea>", "<style>p{}</STYLE >"):
        assert text(inner) == "a\nb", inner
    assert text("<button><p>c</p><button>Go</button>") == "a\nc\nb"
    for inner in ("<script>", "<style>", "<title>"):
        assert text(inner) == "a", inner
    assert text("<button><svg>" * 50_000).startswith("a")
