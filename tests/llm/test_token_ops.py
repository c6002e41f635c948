"""Token counts, quality rules, licences."""

import random
import re
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loamline.llm import licences, quality_rules
from loamline.llm.tokens import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAME = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts_match_the_library(spark, documents, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    parts = ["a", "b ", " ", "  ", "\n", " \n", "'ll", "é", "漢", "1", "#", " ", "<|endoftext|>", " x", "word", "."]
    mixed = spark.createDataFrame([(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(400)], "doc_id long, text string")
    for docs in (documents, odd, mixed):
        got = rows(token_counts(docs, PATH))
        want = sorted(((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.select("doc_id", "text").collect()), key=str)
        assert got == want


def test_empty_tables(spark, empty):
    assert token_counts(empty, PATH).count() == 0
    assert licences.licence_scan(empty).count() == 0
    assert quality_rules.judged(empty, []).count() == 0
    assert quality_rules.fit(empty, spark.createDataFrame([], "doc_id long, quality int")) == []


def base_statistics(text):
    ws = WORD.findall(text or "")
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    hit = set()
    for i in range(len(ws) - 4):
        if windows[tuple(ws[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, rep = len(ws), len(hit)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 10 or 100 * rep > 20 * n


def test_quality_rules_base_matches_brute_force(documents, odd):
    for docs in (documents, odd):
        got = rows(quality_rules.judged(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == sorted(((r.doc_id, *base_statistics(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)


def test_quality_rules_learn_what_labels_say(spark, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    rules = quality_rules.fit(docs, half)
    assert rules
    held = quality_rules.judged(docs, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed")
    good = held.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = held.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.97 and bad < 0.3


def test_decision_list_finds_a_planted_conjunction():
    rng = random.Random(1)
    made = [{n: rng.random() for n in quality_rules.FEATURES} for _ in range(900)]
    data = [(r, r["repeat_share"] > 0.5 and r["upper_share"] > 0.6) for r in made]
    rules = quality_rules.learn(data)
    assert sum(any(r.covers(x) for r in rules) == bad for x, bad in data) > 0.97 * len(data)
    assert quality_rules.learn([]) == [] and quality_rules.learn([(made[0], False)] * 50) == []


def base_licences(text):
    ws = NAME.findall(lower(text or ""))
    at = [(i, label) for phrase, label in licences.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    return len(ws), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_licence_base_matches_brute_force(documents, odd):
    for docs in (documents, odd):
        got = licences.licence_scan(docs)
        assert rows(got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == sorted(((r.doc_id, *base_licences(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
        for r in got.collect():
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize("text, label", [("Foo. Licensed under CC BY-NC 4.0.", "cc-by-nc"), ("bla Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd")])
def test_licence_texts_give_labels_of_their_own(spark, text, label):
    r = licences.licence_scan(spark.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert label in r[0].labels.split(",") and 0 < r[0].score <= 1 and r[1].labels == "" and r[1].score == 0


def test_words_put_in_or_left_out_dont_part_a_licence_text(spark):
    text = {}
    for label, _, t in licences.TEXTS:
        text.setdefault(label, " ".join(w.decode() for w in licences.item_words(t)))
    bsd, mpl = text["bsd"].split(), text["mpl"].split()
    n, at = len(bsd), bsd.index("redistributions")
    docs = {
        1: (" ".join([*bsd[:at], "1.", *bsd[at:]]), "bsd"),
        2: (" ".join([*bsd[:15], *bsd[17:]]), "bsd"),
        3: (" ".join([*bsd[:12], "as", "said", *bsd[12:20], "here", *bsd[20:28], *bsd[30:]]), "bsd"),
        4: (" ".join([*mpl[:7], "of", "use", *mpl[7:]]), "mpl"),
        5: (" ".join([*bsd[:8], *reversed(bsd[8:])]), ""),
        6: (" ".join([*bsd[:15], *["other"] * n, *bsd[90:]]), ""),
    }
    got = licences.licence_scan(spark.createDataFrame([(k, "some words before " + t + " and after") for k, (t, _) in docs.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {k: label for k, (_, label) in docs.items()}
    assert {r.doc_id: round(r.score * n, 6) for r in got if r.doc_id < 4} == {1: n, 2: n - 2, 3: n - 2}


def test_plain_licences_in_the_wild(spark):
    of = lambda label, k=0: [t for x, _, t in licences.TEXTS if x == label][k]
    mit, bsd = of("mit", 1), of("bsd")
    docs = {
        1: (" ".join(mit.split()[:30]), "mit"), 2: (mit.replace("any person", "any natural person").title(), "mit"), 3: (bsd.replace("met: redis", "met:\n1. Redis").replace("disclaimer. redis", "disclaimer.\n2. Redis"), "bsd"),
        4: ("Copyright 2020\n" + of("lgpl"), "gpl,lgpl"), 5: (of("unlicense"), "unlicense"), 6: (f"{of('zlib')} and also {of('boost')}", "boost,zlib"), 7: ("the license of the software is in the public interest and permission is granted to the person", ""),
    }
    got = licences.licence_scan(spark.createDataFrame([(k, "Head of a file. " + t + " int main() {}") for k, (t, _) in docs.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.labels for r in got} == {k: label for k, (_, label) in docs.items()}


def common(a, b):
    best = [0] * (len(b) + 1)
    for w in a:
        new = [0]
        for j, x in enumerate(b):
            new.append(max(new[-1], best[j + 1], best[j] + (w == x)))
        best = new
    return best[-1]


def test_labels_and_score_match_brute_force(spark):
    """Every stretch of a document as long as a text may grow is held against every text."""
    rng = random.Random(11)
    texts = [(label, [w.decode() for w in licences.item_words(p)], [w.decode() for w in licences.item_words(t)]) for label, p, t in licences.TEXTS if len(t) < 700]
    docs = {}
    for k in range(40):
        label, _, t = rng.choice(texts)
        ws = [w for w in t if rng.random() > 0.15]
        for _ in range(rng.randint(0, len(ws) // 4)):
            ws.insert(rng.randint(0, len(ws)), rng.choice(["new", "words", *t]))
        docs[k] = rng.choices(["plain", "prose", "the", "of", "software", "license"], k=rng.randint(0, 12)) + ws + rng.choices(["other", "and", "terms"], k=rng.randint(0, 12))
    got = {r.doc_id: r for r in licences.licence_scan(spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")).collect()}
    some = 0
    for k, d in docs.items():
        want, best = set(filter(None, got[k].base_labels.split(","))), 0.0
        for label, phrase, t in texts:
            if any(d[i : i + len(phrase)] == phrase for i in range(len(d))):
                slack = int(len(t) / licences.LEAST_MATCH) - len(t)
                share = max(common(d[max(0, a) : a + len(t) + 2 * slack], t) for a in range(-slack, max(1, len(d) - len(t)))) / len(t)
                if share >= licences.LEAST_MATCH:
                    want.add(label)
                    best = max(best, share)
        labels = set(filter(None, got[k].labels.split(",")))
        assert want <= labels, (k, want, labels)
        if best:
            some += 1
            assert labels == want and got[k].score == pytest.approx(best, abs=0.02), k
    assert some > 15


def test_words_in_order_match_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        text, doc = rng.choices(range(6), k=rng.randint(1, 70)), rng.choices(range(-1, 7), k=rng.randint(0, 90))
        best = [0] * (len(text) + 1)
        for w in doc:
            new = [0]
            for j, x in enumerate(text):
                new.append(max(new[-1], best[j + 1], best[j] + (w == x)))
            best = new
        places = {w: sum(1 << j for j, x in enumerate(text) if x == w) for w in text}
        assert licences.in_order(licences.np.array(doc, dtype=int), places, len(text)) == best[-1]
