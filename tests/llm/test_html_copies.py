"""Hosts whose pages share article text."""

from plait.llm import html_text
from tests.llm.test_html_text import SHELL


def extract(spark, mains):
    rows = [(i, f"https://host.example/{i}", SHELL.format(n=i, main=m)) for i, m in enumerate(mains)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in sorted(html_text.extract(df.repartition(3)).collect())]


def test_near_copies_keep_their_article(spark):
    shared = ["A headline.", "The first paragraph.", "The second one.", "And a last word."]
    page = lambda i: "<article>" + "".join(f"<p>{s}</p>" for s in [*shared, f"Printed on day {i}."]) + "</article>"
    want = [*shared]
    got = extract(spark, [page(i) for i in range(6)])
    assert got == ["\n".join([*want, f"Printed on day {i}."]) for i in range(6)]
    # nine of ten pages of a host: optional classes
    got = extract(spark, [page(i) for i in range(19)] + ["<article><p>Other.</p><p>Text.</p></article>"])
    assert got == ["\n".join([*want, f"Printed on day {i}."]) for i in range(19)] + ["Other.\nText."]


def test_subheading_of_every_article_stays(spark):
    got = extract(spark, [f"<article><h1>Story {i}</h1><p>One {i}.</p><h2>Summary</h2><p>Two {i}.</p><p>Three {i}.</p></article>" for i in range(8)])
    assert got == [f"Story {i}\nOne {i}.\nSummary\nTwo {i}.\nThree {i}." for i in range(8)]


def test_exact_copies_are_one_page(spark):
    copy = "<article><p>Bold.</p><p>One.</p><p>Two.</p><p>Same.</p></article>"
    rows = [(i, "https://h.example/", copy) for i in range(5)] + [(9, "https://h.example/", copy.replace("Same", "Else"))]
    classes = html_text.templates(html_text.with_host(spark.createDataFrame(rows, "page_id long, url string, html string")))
    assert classes.count() == 0
