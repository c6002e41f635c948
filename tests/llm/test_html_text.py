"""Templates: classes against brute force, sites without article elements, what names and forms may hide."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loamline.llm import html_text as h
from loamline.llm.shared import table

KINDS = "page_id long, url string, html string"

SITES = [
    "<body><div class=a{s}><p>Brand {s} of all</div><div><h1>Head {i}</h1><p>Story {i} of site {s}<p>and more {i}</div><div><p>All rules of site {s} apply</div></body>",
    "<body><table><tr><td>Logo {s}<td><h2>Head {i}</h2><div>Story {i} of site {s}</div>and more {i}<td>Bottom {s}</table></body>",
    "<div id=w{s}><div><a href=x>Start {s}</a> <a href=y>News</a></div><section><h1><a href=z>Head {i}</a></h1><blockquote>Story {i} of site {s}</blockquote><div>and more {i}</div></section><div><a href=a>See {i} too</a></div></div>",
    "<div><center>Welcome {s}</center><h3>Head {i}</h3>Story {i} of site {s}<p>and more {i}</p><div class=low>Call us {s}</div></div>",
    "<body><dl><dt>Site {s}<dd>Always here</dl><div class=t><div class=u><h1>Head {i}</h1></div><div class=v><p>Story {i} of site {s}<p>and more {i}</div></div></body>",
]


def extracted(spark, rows, **more):
    return {r.page_id: r.text for r in h.extracted(spark.createDataFrame(rows, KINDS), **more).collect()}


def test_sites_without_article(spark):
    rows = [(100 * s + i, f"http://s{s}.example/{i}", SITES[s % 5].format(s=s, i=f"{i}x{s}")) for s in range(10) for i in range(6)]
    got = extracted(spark, rows)
    assert got == {100 * s + i: f"Head {i}x{s} Story {i}x{s} of site {s} and more {i}x{s}" for s in range(10) for i in range(6)}
    off = extracted(spark, rows, support=1000)
    assert len({k // 100 for k in off if off[k] != got[k]}) == 10


@pytest.mark.parametrize("page, text", [
    ('<article><h1>T{i}</h1><p class="side-effects">one {i}</p><p class="form">two {i}</p><div class="related-work">three {i}</div><p>four {i}</p></article>', "T{i} one {i} two {i} three {i} four {i}"),
    ("<body><form action=x><h1>T{i}</h1><p>Body {i} of the page</p><label>Mail</label></form></body>", "T{i} Body {i} of the page"),
    ('<body><p>Text {i} <span class="advert">BUY <b>NOW</b></span>goes on</p><form><label>Find {i}</label></form></body>', "Text {i} goes on"),
    ('<body><p>Seen {i}</p><div style="color:red; display: none">not {i}</div><p hidden>nor {i}</p><p>end {i}<i style="visibility:hidden">x</i></p></body>', "Seen {i} end {i}"),
    ('<body><div class="header">Site {i}</div><div class="comment-list"><p>Nice {i}</p></div><div role=navigation>a {i}</div><p>Text {i}</p></body>', "Text {i}"),
])
def test_names_and_forms(spark, page, text):
    assert h.main_text(page.format(i=7), {}, {}, set()).removesuffix(" Mail") == text.format(i=7)
    assert extracted(spark, [(i, f"http://a.example/{i}", page.format(i=i)) for i in range(12)]) == {i: text.format(i=i) for i in range(12)}


def test_classes_match_brute_force(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    more = spark.createDataFrame([(10_000 + i, f"http://x.example/{i}", SITES[i % 5].format(s=i % 2, i=i)) for i in range(40)], KINDS)
    slim = pages.select("page_id", "url", "html").unionByName(more).select(F.col("page_id").alias("k"), F.col("url").alias("u"), h.host_of(F.col("url")).alias("host"), F.col("html").alias("p"))
    vectors, pages_of = defaultdict(dict), Counter()
    for r in slim.collect():
        items = h.items_of(r.p or "")
        pages_of[r.host] += any(t for _, t, _, _ in items)
        for token, n in Counter(h.token_of(p, None) for p, t, _, _ in items if t is None).items():
            vectors[r.host, token][r.k] = n
    classes = defaultdict(set)
    for (host, token), v in vectors.items():
        if len(v) >= max(3, 0.05 * pages_of[host]):
            classes[host, tuple(sorted(v.items()))].add(token)
    want = {(host, frozenset(c)) for (host, _), c in classes.items() if len(c) > 1}
    seqs = h.sequences(slim)
    hosts = seqs.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    got = h.equivalence_classes(h.occurrences(seqs), hosts, support=3, share=0.05).groupBy("host", "cid").agg(F.collect_list("token").alias("t")).collect()
    assert {(r.host, frozenset(r.t)) for r in got} == want and any(len(c) > 3 for _, c in want)


def test_walk_finds_slots_order_and_cuts():
    class_of = {1: (9, 7), 2: (9, 7), 3: (9, 7), 4: (5, 8), 5: (5, 8), 6: (5, 8)}
    slots, forms, bad = h.walk([1, 4, 0, 2, 5, 0, 6, 0, 3, 0], class_of)
    assert [s for s, t in zip(slots, [1, 4, 0, 2, 5, 0, 6, 0, 3, 0]) if t == 0] == [((5, 8), 1), ((5, 8), 2), ((9, 7), 2), ((0, 0), 0)] and not bad
    assert h.walk([1, 4, 2, 5, 6, 3], class_of)[1] == forms and h.walk([1, 4, 5, 2, 6, 3], class_of)[1] != forms
    assert h.walk([1, 2, 3, 1, 3, 2], class_of)[2] == {(9, 7)}


@pytest.mark.parametrize("page, text", [
    ('<article><section class="social"><h2>Social life of bees {i}</h2><p>They live {i} together</p></section></article>', "Social life of bees {i} They live {i} together"),
    ('<main><div class="search"><p>How we search {i} things</p></div></main>', "How we search {i} things"),
    ('<article><p>Text {i}</p><section class="related"><p>Work {i} that came before</p></section><div class="notice"><p>Note {i} well</p></div></article>', "Text {i} Work {i} that came before Note {i} well"),
    ('<article><p data-x=it\'s>one {i}</p><p class=a"b>two {i}</p><p title="a > b">three {i}</p><p title = \'x>y\' id="q">four {i}</p></article>', "one {i} two {i} three {i} four {i}"),
    ('<article><p>Story {i}</p></article><div class="responses"><p>reader says {i}</p></div>', "Story {i}"),
    ('<p>Seen {i}</p><script>if (a < b) document.write("<p>no</p>")</script><p>end {i}</p><!-- <p>x</p> --><p>and <b', "Seen {i} end {i} and"),
    ('<p>a < b and {i} > c</p><p>1 <2', "a < b and {i} > c 1 <2"),
])
def test_names_are_evidence_and_markup_is_html(spark, page, text):
    assert h.main_text(page.format(i=7), {}, {}, set()) == text.format(i=7)
    assert extracted(spark, [(i, f"http://{i}.example/", page.format(i=i)) for i in range(3)]) == {i: text.format(i=i) for i in range(3)}


def test_the_host_decides_what_a_name_only_suggests(spark):
    page = '<article><h1>Head {i}</h1><p>Story {i} goes on</p><div class="{name}"><p>Also see {i} of all</p></div></article>'
    rows = [(100 * s + i, f"http://s{s}.example/{i}", page.format(i=f"{i}x{s}", name=name)) for s, name in enumerate(("related", "more-facts")) for i in range(12)]
    rows += [(300 + i, f"http://s3.example/{i}", page.format(i=f"{i}x3", name="related" if i == 5 else "c")) for i in range(90)]
    got = extracted(spark, rows)
    assert {got[i] for i in range(12)} == {f"Head {i}x0 Story {i}x0 goes on" for i in range(12)}
    assert {got[100 + i] for i in range(12)} == {f"Head {i}x1 Story {i}x1 goes on Also see {i}x1 of all" for i in range(12)}
    assert got[305] == "Head 5x3 Story 5x3 goes on Also see 5x3 of all"


def test_broken_and_deep_pages_take_linear_time():
    import time

    for page, text in (("<script " * 50_000, ""), ("<a href='" * 50_000, ""), ("<!-- " * 80_000, ""), ("<p x=\"" * 60_000 + ">", ""), ("<p>a" + "<div>" * 60_000 + "x" + "</p>" * 60_000, "a x"), ("<svg>" * 50_000 + "<p>x", ""), ("&amp" * 100_000 + "<p>", "&" * 100_000)):
        at = time.perf_counter()
        assert h.main_text(page, {}, {}, set()) == text
        assert time.perf_counter() - at < 5


def test_odd_tables(spark):
    got = h.extracted(spark.createDataFrame([], KINDS))
    assert got.count() == 0 and got.columns == ["page_id", "url", "text", "n_chars"]
    clash = spark.createDataFrame([(None, None, "<p>a</p>", 1, 2, "x"), (1, "http://a.example", None, 1, 2, "x"), (1, "http://a.example", None, 1, 2, "x")], KINDS + ", k int, pages int, host string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in h.extracted(clash).collect()) == [(0, "a", 1), (1, "", 0), (1, "", 0)]
