"""Main text, mixing, the quality classifier and the pipeline."""

import html
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamline.llm import html_text, mixing, quality_model
from loamline.llm.shared import table


def article(page):
    m = re.search(r"<article>(.*)</article>", page, re.S)
    return " ".join(" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", m[1]) if x.strip())


def test_main_text_of_whole_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extracted(pages).collect()}
    want = {r.page_id: (r.url, " ".join(article(r.html).split()), len(" ".join(article(r.html).split()))) for r in pages.collect()}
    assert got == want


SITE = """<html><head><title>T{i}</title><script>if (a<b) x("</p>")</script></head><body><header><a href=/>Home</a></header>
<ul class="main-menu"><li>One<li>Two</ul><div id=c{i} class="col"><div class="story"><h2>Title {i}</h2><p>Body&nbsp;text &amp; more {i}<br>next <b>bo</b>ld
<p>Second   part {i} of the story with words<div class="newsletter-box">Join us</div><p>Always the same closing line</p></div>
<div class="comments"><article><p>Nice post {i}</article></div></div><aside>Side {i}</aside><form><p>Search</form><!-- <p>no</p> --><footer>&copy; site</footer></body></html>"""


def test_template_of_a_site_without_article(spark):
    rows = [(i, f"http://www.site.example/{i}", SITE.format(i=i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Body text & more {i} next bold Second part {i} of the story with words" for i in range(12)}


def test_odd_pages(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (2, "not a url[", "", "x"), (3, "http://a/", "no markup &lt;at&gt; all", "x"), (4, "http://a/", "<p>open <script>never closed", "x"), (None, "http://a/", "<article><nav>menu</nav><p>text</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 9, r.text, r.n_chars) for r in html_text.extracted(pages).collect()))
    assert got == [(1, "", 0), (1, "", 0), (2, "", 0), (3, "no markup <at> all", 18), (4, "open", 4), (9, "text", 4)]
    assert html_text.extracted(pages.limit(0)).count() == 0


def shared_out(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, target, stopped = sum(sizes.values()), {}, set()
    while True:
        free = sum(w[s] for s in order if s not in stopped)
        left = total - sum(most * sizes[s] for s in stopped)
        target = {s: float(most * sizes[s]) if s in stopped else left * w[s] / free if free else 0.0 for s in order}
        more = {s for s in order if s not in stopped and target[s] > most * sizes[s]}
        if not more:
            return target
        stopped |= more


def test_mix_meets_targets(documents, odd):
    for docs in (documents, odd):
        rows = mixing.mixed(docs).collect()
        source = defaultdict(list)
        for r in docs.select("doc_id", "source", "text").collect():
            source[r.source].append((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))))
        sizes = {s: sum(n for _, n in v) for s, v in source.items()}
        target = shared_out(sizes)
        assert sorted(map(str, ((d, n, sizes[s], round(target[s], 4)) for s, v in source.items() for d, n in v))) == sorted(str((r.doc_id, r.size, r.source_size, round(r.target, 4))) for r in rows)
        assert all(0 <= r.taken <= 3 * r.size for r in rows)
        again = sorted(map(str, mixing.mixed(docs).collect()))
        assert again == sorted(map(str, rows))
    rows = mixing.mixed(documents).join(documents.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert all(abs(r.taken - r.target) <= max(0.1 * r.target, r.largest) for r in rows)


def test_mix_is_emitted_as_counted(documents, empty):
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mixed(documents).where("size > 0").collect()}
    got = {r.doc_id: r["count"] for r in mixing.emitted(documents).groupBy("doc_id").count().collect()}
    assert {d: n for d, n in taken.items() if n} == {d: n for d, n in got.items() if taken.get(d)}
    assert mixing.mixed(empty).count() == 0 and mixing.emitted(empty).count() == 0


def test_targets_stop_at_three_times_a_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, None: 7}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = shared_out(sizes)
    assert all(got[s] == pytest.approx(want[s]) for s in sizes) and got["a"] == 30


def test_classifier_on_held_out_rows(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    got = quality_model.judged(docs, labels.where("doc_id % 3 > 0")).join(labels.where("doc_id % 3 = 0"), "doc_id")
    clean, bad = got.where("quality = 1 and toxic = 0"), got.where("quality = 0")
    assert clean.agg(F.avg(F.col("kept").cast("int"))).first()[0] > 0.95
    assert bad.agg(F.avg(F.col("kept").cast("int"))).first()[0] < 0.15


def test_classifier_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_model.judged(odd, labels).where("kept is not null").count() == odd.count()
    assert quality_model.judged(odd, labels.limit(0)).count() == odd.count()
    assert quality_model.judged(empty, labels).count() == 0


def test_sparse_groups_shrink_to_the_prior(spark):
    rows = [("big", "en", int(i % 10 > 0)) for i in range(500)] + [("bad", "en", int(i % 10 == 0)) for i in range(500)] + [("new", "en", 1)]
    prior, groups = quality_model.posteriors(spark.createDataFrame(rows, "host string, path string, quality int"), "quality")
    got = {r.host: r.quality for r in groups.collect()}
    assert got["bad"] < 0.2 and got["big"] > 0.8 and prior < got["new"] < 0.95


def test_logistic_separates():
    x = np.random.default_rng(0).normal(size=(400, 2))
    y = (x[:, 0] - x[:, 1] > 0).astype(float)
    w = quality_model.logistic(x, y)
    assert (((x @ w[:2] + w[2]) > 0) == (y > 0)).mean() > 0.97


def test_stages_keep_the_columns_and_reread(spark, tmp_path, odd):
    sf_dir = "/root/testdata/sf0.001"
    for start in (table(spark, sf_dir, "documents"), odd.select("doc_id", "text", "lang", "source", "n_chars", "row", "fp", "kept")):
        docs = start
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf_dir)
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == start.columns, name
            out.write.parquet(str(tmp_path / f"{id(start)}-{name}"))
            docs = spark.read.parquet(str(tmp_path / f"{id(start)}-{name}"))
        assert docs.count() > 0


def test_pipeline_rows_are_its_stages_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    ids = {r.doc_id for r in rows}
    judged = {r.doc_id: r.kept for r in quality_model.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()}
    assert rows and all(judged[d] for d in ids)


def test_labelled_texts_that_begin_alike_all_teach(spark):
    opening = "Copyright notice of the corpus, the same in every text. "
    rows = [(i, opening + (f"vile slur number{i}" if i % 3 == 0 else f"calm words number{i}"), "en", "a") for i in range(60)]
    docs = spark.createDataFrame([*rows, *((60 + i, rows[i][1], "en", "a") for i in range(30))], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(docs, labels)
    assert sorted(model.lexicon) == sorted(quality_model.bw.hash_of([b"vile", b"slur"]))
    assert model.toxic_prior == pytest.approx(quality_model.logit(20.5 / 61))


PARTS = """<html><body><div class="top">Site name</div><div class="content"><h1>Title {i}</h1><p>Lead {i}</p><div class="body"><p>Long body of page {i} that holds the most of all words there<p>and its second part {i}</div><div class="more"><p>Last part {i}</div></div></body></html>"""


def test_all_parts_of_a_page_without_article(spark):
    for n in (4, 12):
        rows = [(i, f"http://site.example/{i}", PARTS.format(i=i)) for i in range(n)]
        got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == {i: f"Title {i} Lead {i} Long body of page {i} that holds the most of all words there and its second part {i} Last part {i}" for i in range(n)}


def test_every_article_of_a_template(spark):
    page = "<html><body><p>Site</p><article class=a><p>First {i} with words</article><div><p>Between {i}</div><article class=b><p>Second {i}</article></body></html>"
    rows = [(i, f"http://site.example/{i}", page.format(i=i)) for i in range(4)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"First {i} with words Second {i}" for i in range(4)}


def test_fixed_texts_despite_empty_and_other_pages(spark):
    other = "<html><body><section><h1>Other {i}</h1></section></body></html>"
    for more in ([None], ["", " "], [other.format(i=0)], [other.format(i=i) for i in range(9)], [SITE.format(i=50).replace("<p>Always the same closing line</p>", "")]):
        pages = [*(SITE.format(i=i) for i in range(12)), *more]
        rows = [(i, f"http://www.site.example/{i}", p) for i, p in enumerate(pages)]
        got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert {i: got[i] for i in range(12)} == {i: f"Title {i} Body text & more {i} next bold Second part {i} of the story with words" for i in range(12)}
        if other[:20] in str(more[0]) and "Other" in str(more[0]):
            assert [got[12 + i] for i in range(len(more))] == [f"Other {i}" for i in range(len(more))]


def test_pages_that_are_copies_keep_their_texts(spark):
    rows = [(i, f"http://site.example/{i}", PARTS.format(i=i if i > 14 else 0)) for i in range(20)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"Long body of page {i if i > 14 else 0} that" in got[i] and f"Last part {i if i > 14 else 0}" in got[i] for i in range(20))


def test_paths_without_labels_have_their_hosts_prior(spark):
    rows = [(i, f"some plain words {i}", "en", "bad" if i % 2 else "big") for i in range(400)] + [(1000 + i, "some plain words", x, h) for i, (x, h) in enumerate((x, h) for x in ("fr", None) for h in ("bad", "big", "new", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0 or i % 20 == 1), int(i % 2 and i % 20 != 3)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_model.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    for i in (1000, 1004):
        bad, big, new, none = (got[i + k] for k in range(4))
        assert bad.p_good < 0.3 < new.p_good < big.p_good and bad.p_toxic > 0.7 > new.p_toxic > big.p_toxic
        assert (new.p_good, new.p_toxic) == (none.p_good, none.p_toxic)
