"""The classifier's posteriors and scores, and the pipeline, against plain Python."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from loamline.llm import line_dedup, mixing, quality_model, simhash
from loamline.llm.shared import table

NAME = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {ord(a): a.lower() for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def logit(p):
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def shrinkage(groups, prior):
    """Pseudo-rows by moments from (n, k) of groups."""
    n, squares = sum(g[0] for g in groups), sum(g[0] ** 2 for g in groups)
    if not n or len(groups) < 2:
        return 1000.0
    noise = prior * (1 - prior)
    spread = sum(g[0] * (g[1] / g[0] - prior) ** 2 for g in groups)
    between = (spread - noise * (len(groups) - 1)) / max(n - squares / n, 1.0)
    return min(max(noise / between - 1, 2.0), 1000.0) if between > 0 else 1000.0


def posteriors(rows):
    """From (host, path, 0/1): the global rate, hosts' and paths' shrunk rates."""
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, p, y in rows:
        for g in (paths[h, p], hosts[h]):
            g[0] += 1
            g[1] += y
    prior = (sum(y for *_, y in rows) + 1) / (len(rows) + 2)
    a, b = shrinkage(list(hosts.values()), prior), shrinkage(list(paths.values()), prior)
    by_host = {h: (k + a * prior) / (n + a) for h, (n, k) in hosts.items()}
    return prior, by_host, {(h, p): (k + b * by_host[h]) / (n + b) for (h, p), (n, k) in paths.items()}


def test_scores_match_brute_force(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    labels = labels.where("doc_id % 4 > 0").unionByName(spark.createDataFrame([(0, None, 1), (1, 1, None)], labels.schema))
    model = quality_model.fit(docs, labels)
    rows = docs.collect()
    of = {r.doc_id: r for r in rows}
    known = [(of[x.doc_id].source, of[x.doc_id].lang, x.quality, x.toxic) for x in labels.collect() if x.doc_id in of]
    good, good_hosts, good_paths = posteriors([(h, p, q) for h, p, q, _ in known if q is not None])
    bad, bad_hosts, bad_paths = posteriors([(h, p, t) for h, p, _, t in known if t is not None])
    lexicon = dict(zip(model.lexicon.tolist(), model.ratios.tolist(), strict=True))
    got = {r.doc_id: r for r in quality_model.judged(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in rows:
        t = r.text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        n, c = max(len(ws), 1), max(len(t.encode()), 1)
        style = [sum(t.count(x) for x in "#*$%&|<>") / c, sum("A" <= x <= "Z" for x in t) / c, t.count("!") / n, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / n, min(sum(len(w.encode()) for w in ws) / n, 40) / 10, math.log1p(len(ws)) / 5]
        z = np.clip((np.array(style) - model.mean) / model.scale, -10, 10) @ model.weights[:-1] + model.weights[-1]
        words = {int(quality_model.bw.hash_of([w.encode()])[0]) for w in set(NAME.findall(t.translate(LOWER)))}
        z += logit(good_paths.get((r.source, r.lang), good_hosts.get(r.source, good))) - logit(good)
        x = sum(lexicon.get(h, 0.0) for h in words) + model.toxic_prior + logit(bad_paths.get((r.source, r.lang), bad_hosts.get(r.source, bad))) - logit(bad)
        p, q = 1 / (1 + math.exp(-min(max(z, -700), 700))), 1 / (1 + math.exp(-min(max(x, -700), 700)))
        assert got[r.doc_id].p_good == pytest.approx(p, abs=1e-6) and got[r.doc_id].p_toxic == pytest.approx(q, abs=1e-6)
        assert got[r.doc_id].kept == (got[r.doc_id].p_good >= 0.5 and got[r.doc_id].p_toxic < 0.5)


def test_toxic_documents_are_caught_on_held_out_rows(spark):
    """Of documents labelled good, each judged by a model that hasn't seen its label."""
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    n = Counter()
    for fold in range(3):
        got = quality_model.judged(docs, labels.where(f"doc_id % 3 <> {fold}")).join(labels.where(f"doc_id % 3 = {fold} and quality = 1"), "doc_id")
        n.update({(r.toxic, r.kept): r["count"] for r in got.groupBy("toxic", "kept").count().collect()})
    assert n[1, False] >= 0.9 * (n[1, False] + n[1, True]) and n[0, True] >= 0.98 * (n[0, True] + n[0, False])


def test_classifier_of_ties(spark):
    """Rows repeated in full, and texts with contradicting labels, are judged alike however often they come."""
    rows = [(1, "same words here", "en", "a"), (1, "same words here", "en", "a"), (2, "same words here", "en", "a"), (3, "other words", "en", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_model.judged(docs, labels).collect()
    assert len(got) == 4 and len({(r.p_good, r.p_toxic) for r in got if r.doc_id < 3}) == 1


def fingerprint(text):
    ws = (text or "").translate(LOWER).split()
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) > 2 else [" ".join(ws)] if ws else []
    sums = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), seed=42)
        for b in range(64):
            sums[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * sums[b] > len(grams))


def test_simhash_of_nothing_and_of_ties(spark, empty, odd):
    assert simhash.document_classes(empty).count() == 0 and simhash.one_of_each(empty).count() == 0
    got = simhash.document_classes(odd).collect()
    assert len(got) == odd.count()
    blank = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in blank} == {3, 4, 5, None} and {r.component_id for r in blank} == {3}
    assert {r.component_id for r in got if r.doc_id in (6, 7)} == {6}


def test_mix_refuses_a_clashing_number(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 7)], "doc_id long, text string, source string, COPY int")
    with pytest.raises(ValueError):
        mixing.emitted(docs)
    assert mixing.emitted(docs, number="again").columns == ["doc_id", "text", "source", "COPY", "again"]
    assert "copy_" in corpus_pipeline.mixture(spark, docs, "").columns


def near(a, b):
    """Whether one word put in, left out or changed makes one of the other."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :])


def pipeline_by_hand(docs, kept, benchmark):
    """Rows (doc_id, text) that are left after the second to fourth stage, from those that the classifier keeps."""
    rows = sorted((d for d in docs if d[0] in kept), key=lambda d: d[0])
    seen, out = [], []
    exact = set()
    for i, text, *_ in rows:
        stay, words = [], 0
        for line in (text or "").split("\n"):
            ws = tuple(w for w in re.split(r"[\x20\x09-\x0D]+", line) if w)
            again = bool(ws) and (ws in exact or len(ws) >= 5 and any(len(s) >= 5 and near(ws, s) for s in seen))
            if ws and ws not in exact:
                exact.add(ws)
                seen.append(ws)
            if not again:
                stay.append(line)
                words += len(ws)
        if text is None or words or not text.split():
            out.append((i, text if text is None or len(stay) == len(text.split("\n")) else "\n".join(stay)))
    prints = [fingerprint(t) for _, t in out]
    root = list(range(len(out)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(out)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    out = [d for k, d in enumerate(out) if find(k) == k]
    windows = defaultdict(set)
    for t in benchmark:
        ws = NAME.findall((t or "").translate(LOWER))
        m = min(13, len(ws))
        for k in range(len(ws) - m + 1 if m else 0):
            windows[m].add(tuple(ws[k : k + m]))
    clean = []
    for i, t in out:
        ws = NAME.findall((t or "").translate(LOWER))
        hit = {p + x for m, known in windows.items() for p in range(len(ws) - m + 1) if tuple(ws[p : p + m]) in known for x in range(m)}
        if not (hit and 20 * len(hit) >= len(ws)):
            clean.append((i, t))
    return clean


def test_pipeline_matches_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = table(spark, sf_dir, "documents")
    kept = {r.doc_id for r in quality_model.judged(docs, table(spark, sf_dir, "labels")).where("kept").collect()}
    by_hand = pipeline_by_hand([(r.doc_id, r.text) for r in docs.collect()], kept, [r.text for r in table(spark, sf_dir, "benchmark").collect()])
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    mine = spark.createDataFrame([(i, t, source[i]) for i, t in by_hand], "doc_id long, text string, source string")
    taken = Counter({r.doc_id: r.taken // r["size"] for r in mixing.mixed(mine).where("size > 0").collect()})
    texts = dict(by_hand)
    assert len(rows) > 20 and {r.doc_id for r in rows} <= texts.keys()
    assert all(r.text == texts[r.doc_id] for r in rows)
    assert Counter(r.doc_id for r in rows if (r.text or "").split()) == +taken
    assert line_dedup.LEAST_WORDS == 5
