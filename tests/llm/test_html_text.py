from plait.llm import html_text


def text(source, **kw):
    return html_text.text_of(html_text.read(source), **kw)


SHELL = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>T</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><!-- ad --><div class="ad">Buy {n}</div>{main}<footer>&copy; host &middot; {n}</footer></body></html>"""


def test_article():
    page = SHELL.format(n=1, main="<article><h1>A &amp; B</h1><p><b>Open bold.<br><p>Two\n  words&nbsp;here</p><ul><li>x<li>y</ul><aside>no</aside></article>")
    assert text(page) == "A & B\nOpen bold.\nTwo words here\nx\ny"


def test_other_shells():
    assert text('<div id="sidebar">no</div><main><div class="post-content"><p>yes</p><div class="comments"><p>no</p></div></div></main>') == "yes"
    assert text('<body><div class="cookie-notice">no</div><p>One.</p><div>Two <a href="#">link</a> more words here</div><div><a>Menu</a> <a>Other</a></div>') == "One.\nTwo link more words here"
    assert text("<article><header><h1>Title</h1></header><p>a<form><input>no</form><p>b</article>") == "Title\na\nb"
    assert text("<header><h1>Site</h1></header><article><p>a</article>") == "a"


def test_what_belongs_to_the_article():
    assert text('<article><div class="entry-header"><h1>Title</h1></div><p>a</p></article>') == "Title\na"
    assert text('<div class="page-header"><h1>Site</h1></div><article><p>a</p></article>') == "a"
    assert text("<main><h1>Title</h1><article><p>a</p></article><p>b</p></main>") == "Title\na\nb"
    assert text('<p>One.</p><p><a href="#">All of it a link</a></p><h2><a href="#">Head</a></h2><div><a>Menu</a></div>') == "One.\nAll of it a link\nHead"


def test_reading_is_linear():
    import time

    for unit in ('<a "x', "<a x='>", '<a "> " ', "<", "<a ", "<!-- ", "<script ", "</a", '<a b="', "<a '\"> ", "<b></i>", "<div></p>"):
        took = []
        for n in (10_000, 160_000):
            began = time.process_time()
            html_text.read(unit * n)
            took.append(time.process_time() - began)
        assert took[1] < 0.05 + 50 * took[0], unit


def test_malformed():
    for s in ("", "<", "<<p>a", "<p title=it's>a", "</div></p>a", "<script>never closed", "<!-- never closed", "<p>a<b", "plain", "<article>" * 300 + "x"):
        text(s)
    assert text("</div></p>a") == "a" and text("plain &lt;text&gt;") == "plain <text>"


def test_template_text_is_dropped(spark):
    rows = []
    for i in range(12):
        main = f"<article><div><p>Share this story with a friend</p></div><p>Story {i} begins.</p><p>Second {i * 7}.</p></article>"
        rows.append((i, f"https://Blog.example.com:80/{i}?x#y", SHELL.format(n=i, main=main), "x"))
    rows.append((50, "http://one.example.org/", SHELL.format(n=50, main="<article><p>Alone.</p></article>"), "x"))
    rows += [(60, None, None, "x"), (61, "odd", "", "x"), (61, "odd", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df.repartition(4)).collect()}
    for i in range(12):
        assert got[i].text == f"Story {i} begins.\nSecond {i * 7}."
    assert got[50].text == "Alone." and got[50].n_chars == 6 and got[60].text == got[61].text == ""
    assert html_text.extract(df).count() == len(rows)
    old, html_text.BROADCAST_TOKENS = html_text.BROADCAST_TOKENS, 0
    try:
        again = {r.page_id: r for r in html_text.extract(df).collect()}
    finally:
        html_text.BROADCAST_TOKENS = old
    assert again == got
    assert html_text.extract(df.limit(0)).count() == 0


def shell(i, title, paragraphs, tail=""):
    """A page whose class names say nothing."""
    menu = "".join(f'<li class="k{k}"><a href="/{k}">Section {k + i % 3}</a></li>' for k in range(5))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f'<html><body><div class="q1"><ul>{menu}</ul></div><div class="q2">Offer {i} today</div><div class="q3"><h1>{title}</h1><div class="q4">{body}</div></div><div class="q5"><a href="/x">Other story {i}</a></div><div class="q6">All rights reserved</div>{tail}</body></html>'


def test_template_decides_where_names_say_nothing(spark):
    story = lambda i, k: " ".join(f"word{(i * 7 + k * j) % 50}" for j in range(30 + 5 * k))
    rows = [(i, f"https://plain.example/{i}", shell(i, f"Title {i}", [story(i, k) for k in range(1 + i % 4)])) for i in range(12)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(df.repartition(3)).collect()}
    assert got == {i: "\n".join([f"Title {i}", *(story(i, k) for k in range(1 + i % 4))]) for i in range(12)}
    alone = {r.page_id: r.text for r in html_text.extract(df, use_templates=False).collect()}
    assert all(alone[i] != got[i] and "Offer" in alone[i] for i in got)


def brute_skeleton(pages):
    """Tokens that stand exactly once on every page, and of the others the groups of equal vectors."""
    from collections import Counter

    pages = [Counter(html_text.read(p).tokens) for p in dict.fromkeys(pages)]
    every = set().union(*pages)
    vectors = {}
    for t in every:
        vectors.setdefault(tuple(p[t] for p in pages), set()).add(t)
    once = lambda v: set(v) <= {0, 1}
    skeleton = vectors.get((1,) * len(pages), set())
    optional = [c for v, c in vectors.items() if once(v) and 0 in v and sum(v) >= html_text.OPTIONAL * len(pages) and len(c) >= html_text.CLASS_TOKENS]
    return skeleton, optional if len(pages) >= html_text.OPTIONAL_PAGES else []


def test_templates_equal_brute_force(spark):
    rows = []
    for i in range(30):
        tail = "<section><h3>Follow us</h3><p>By mail</p><p>By post</p></section>" if i % 15 else ""
        rows.append((i, f"https://a.example/{i}", shell(i, f"Title {i}", [f"Text {i}", "x"][: 1 + i % 2], tail)))
    rows += [(100 + i, f"https://b.example/{i}", shell(i, "Same", [f"Text {i}"])) for i in range(5)] + [(200, "https://c.example/", shell(1, "T", ["x"]))]
    df = html_text.with_host(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {}
    for r in html_text.templates(df.repartition(4)).collect():
        got.setdefault(r.host, ([], []))[r.kind].append({t & 0xFFFFFFFFFFFFFFFF for t in r.tokens})
    assert set(got) == {"a.example", "b.example"}
    for host, (skeleton, optional) in got.items():
        want = brute_skeleton([h for _, u, h in rows if host in u])
        assert set().union(*skeleton) == want[0] and sorted(map(sorted, optional)) == sorted(map(sorted, want[1]))
    assert got["a.example"][1] and not got["b.example"][1]
