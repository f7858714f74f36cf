import collections
import math
import random
import time

from quire.llm import html_text as H


def test_the_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookie-banner">Cookies?</div>
    <article><header><h1>Head&amp;line</h1></header><p><b>First <i>pa</i>ra.<br><p>Second\n\n  para&nbsp;x</p><ul><li>one<li>two</ul><aside>aside</aside>
    <form><input value=x>Send</form><table><tr><td>a<td>b</table><section class="comments"><article class="comment">Reader</article></section></article>
    <div class="sidebar">Side</div><footer>&copy; me</footer></body></html>"""
    assert H.main_text(page) == "Head&line First para. Second para x one two a b"


def test_odd_pages():
    assert H.main_text(None) == "" == H.main_text("") == H.main_text("<script>x")
    assert H.main_text("plain &lt;text&gt; a < b <3") == "plain <text> a < b <3"
    assert H.main_text("<p>one<p>two") == "one two"
    assert H.main_text("<div>a<span>b</span>c</div><div>d</div>") == "abc d"
    assert H.main_text("<main><p>x</main><p>outside") == "x"
    assert H.main_text("<body><div><p>unclosed <b>bold<div>more</div></body>") == "unclosed bold more"
    assert H.main_text("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>") == "yes"
    assert H.main_text("<!-- open <p>x") == ""
    assert H.main_text('<p title="a > b">ok</p>') == "ok"
    assert H.main_text("<div " * 3 + ">x") is not None
    assert len(H.main_text("<div>" * 30_000 + "deep")) == 4
    assert len(H.main_text("<p>" + "word " * 200_000)) == 999_999


def test_structure_tells_the_article():
    text = H.main_text
    assert text("<body><header><div>Site Name</div></header><div><p>Text</p></div>") == "Text"
    assert text('<body><div class="entry-header"><h1>Title</h1></div><section id="related-work"><p>Others did it.</p></section><p>Body</p>') == "Title Others did it. Body"
    assert text('<p class="ad-hoc">one</p><p class="notice">two</p><div class="search-results"><p>three</p></div>') == "one two three"
    assert text("<body><article><p>teaser</p></article><div><p>The real text has many more words than that</p></div>") == "The real text has many more words than that"
    assert text("<div class=post><header><h1>Head</h1></header><p>Body</p></div>") == "Head Body"
    long = "word " * 200
    assert text(f"<article><h1>H</h1><p>{long}</p></article><article><p>short teaser</p></article>") == f"H {long.strip()}"
    assert text(f'<main><div class="sidebar"><p>{long}</p></div></main>') == long.strip()  # a name alone removes no text
    assert text(f'<p>{long}</p><div class="sidebar"><a href=a>one two</a> <a href=b>three</a></div><div class="cookie-banner">We use cookies</div>') == long.strip()
    assert text(f'<article><p>short post</p><section class="comments"><p>{long}</p><p>{long}</p></section></article>') == "short post"
    assert text("<p>Some text here, more of it, and more</p><ul><li><a>Home</a><li><a>News</a><li><a>About</a></ul>") == "Some text here, more of it, and more"


def test_unclosed_markup_takes_linear_time():
    began = time.process_time()
    n = 5_000_000
    assert H.main_text("x" + "<a " * (n // 3)).startswith("x<a <a")
    for piece in ('<a b="', "<a b='\"", "<!--x", "</script ", "<title>x</title ", "<![CDATA["):
        H.main_text("<p>x" + piece * (200_000 // len(piece)))
    H.main_text("<p><table><td>" + "<div>" * 20_000 + "</p>" * 20_000)
    assert time.process_time() - began < 15


def test_templates_by_brute_force(spark):
    rng = random.Random(3)
    parts = [f"<div><p>Part {k} of the site</p><span>label {k}</span></div>" for k in range(6)]
    rows = []
    for i in range(120):
        body = "".join(p for k, p in enumerate(parts) if rng.random() < (0.9, 0.6, 0.4, 0.2, 0.05, 0.02)[k])
        rows.append((i, f"http://h{i % 3}.example/{i}" if i % 10 else None, f"<body>{body}<p>own text number {i % 100}</p><script>track({i})</script></body>"))
    seen, pages = collections.Counter(), collections.defaultdict(set)
    for _, url, page in rows:
        root = H.weigh(H.parse(page))
        shown = "|".join(H.blocks(root))
        if url and shown not in pages[host := url.split("/")[2]]:
            pages[host].add(shown)
            seen.update((host, h) for h in H.counted(root))
    want = {}
    for i, url, page in rows:
        n = len(pages[url.split("/")[2]]) if url else 0
        held = {h: c for (host, h), c in seen.items() if url and host == url.split("/")[2] and c >= 5}
        want[i] = H.main_text(page, {h for h, c in held.items() if 2 * c >= n}, {h for h, c in held.items() if 2 * c < n and c >= 5 * math.log2(n)})
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    for limit in (1_000_000, 0):
        assert {r.page_id: r.text for r in H.extract(df, broadcast_rows=limit).collect()} == want
    assert sum("Part 0" in t for t in want.values()) < 20 < sum("Part 3" in t for t in want.values())


def test_copies_and_pages_without_a_host_keep_their_text(spark):
    rows = [(i, "http://a.example/x", f"<body><p>One page, many times</p><script>{i}</script></body>") for i in range(8)]
    rows += [(10 + i, [None, "/relative", "x.html"][i % 3], f"<body><p>common line</p><p>{i}</p></body>") for i in range(12)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()}
    assert all(got[i] == "One page, many times" for i in range(8)) and all(got[10 + i] == f"common line {i}" for i in range(12))


def test_the_query(spark, tables):
    from quire.llm.queries import op9_html

    path = tables(pages=([(1, "http://a.example/1", "<p>é &amp; x", 5), (2, None, None, 5), (None, "u", "", 5)], "page_id BIGINT, url STRING, html STRING, text INT"))
    assert [tuple(r) for r in op9_html(spark, path).orderBy("page_id").collect()] == [(None, "u", "", 0), (1, "http://a.example/1", "é & x", 5), (2, None, "", 0)]


def test_templates_are_deleted_by_host(spark):
    rows = []
    for i in range(12):
        rows.append((i, f"https://a.example/{i}", f"<body><div>Welcome to our site</div><p>text {i}</p><p>shared line</p><div>Terms of use</div></body>" if i < 9 else f"<body><p>text {i}</p></body>"))
    rows += [(20 + i, f"//b.example/{i}", f"<body><div>Welcome to our site</div><p>text {i}</p></body>") for i in range(3)]
    rows += [(30, None, None), (31, None, ""), (None, "http://a.example:80/x", "<p>null id</p>"), (32, "x", "<p>" + "w " * 60_000 + "</p>"), (20, "//b.example/0", "<body><div>Welcome to our site</div><p>text 0</p></body>")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id BIGINT, url STRING, html STRING, h STRING, t INT")
    got = [(r.page_id, r.text) for r in H.extract(df).collect()]
    assert len(got) == len(rows)
    by_id = dict(got)
    assert [by_id[i] for i in range(12)] == [f"text {i}" for i in range(12)]
    assert by_id[20] == "Welcome to our site text 0" and by_id[30] == by_id[31] == "" and by_id[None] == "null id" and len(by_id[32]) == 119_999
    assert H.extract(df.limit(0)).count() == 0


def test_inline_templates_in_blocks_that_vary(spark):
    rows = [(i, f"https://a.example/{i}", f"<body><div>{i} May <a>Share this story</a></div><p>text {i} <span>Read also our guide</span></p></body>") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    for limit in (1_000_000, 0):
        assert {r.page_id: r.text for r in H.extract(df, broadcast_rows=limit).collect()} == {i: f"{i} May text {i}" for i in range(8)}


def test_templates_of_a_part_of_a_host(spark):
    rows = []
    for i in range(200):
        head = "<div>Written by our travel desk</div>" if i % 5 < 2 else ""
        rows.append((i, f"https://a.example/{i}", f"<body>{head}<p>own text {i} with <b>bold</b> words{' of it' * (i % 5)}</p></body>" if i % 2 else f"<body>{head}<p>own text {i} and more of it</p></body>"))
    copied = "<p>An article that was copied</p><p>all of it to many pages</p>"
    rows += [(1000 + i, f"https://a.example/c{i}", f"<body>{copied}<p>{i}</p></body>") for i in range(60)]
    rows += [(2000 + i, f"https://a.example/d{i}", "<body><p>One page under many names</p></body>") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    for limit in (1_000_000, 0):
        got = {r.page_id: r.text for r in H.extract(df, broadcast_rows=limit).collect()}
        for i in range(200):
            assert got[i] == (f"own text {i} with bold words{' of it' * (i % 5)}" if i % 2 else f"own text {i} and more of it"), i
        assert all(got[1000 + i] == f"An article that was copied all of it to many pages {i}" for i in range(60))
        assert all(got[2000 + i] == "One page under many names" for i in range(300))
