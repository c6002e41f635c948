"""Decontamination, SimHash, line dedup, repeated strings, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from loamline.llm import decontaminate, line_dedup, simhash, suffix_dedup
from loamline.llm.components import components
from loamline.llm.shared import table

NAME = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def contaminated(text, items):
    ws = NAME.findall(lower(text))
    hit, named = set(), set()
    places = defaultdict(list)
    for i, w in enumerate(ws):
        places[w].append(i)
    for item, t in items:
        iw = NAME.findall(lower(t))
        size = min(13, len(iw))
        for k in range(len(iw) - size + 1 if size else 0):
            win = iw[k : k + size]
            for i in places[win[0]]:
                if ws[i : i + size] == win:
                    hit |= set(range(i, i + size))
                    named.add(item)
    named = sorted(str(x) for x in named if x is not None)
    return len(ws), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("index_bytes", [8 << 20, 3000])
def test_decontamination_matches_brute_force(spark, sf_dir, documents, odd, index_bytes, monkeypatch):
    real = decontaminate.indexes
    monkeypatch.setattr(decontaminate, "indexes", lambda b, **k: real(b, **k, index_bytes=index_bytes))
    short = spark.createDataFrame([(1, "same text"), (2, "ÉCOLE one"), (3, None), (4, ""), (None, "six plain"), (5, "wort"), (5, "Repeated line of six")], "item_id long, text string")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    for docs, b in ((documents, bench), (documents, bench.unionByName(short)), (odd, short)):
        items = [(r.item_id, r.text) for r in b.collect()]
        assert rows(decontaminate.contamination(docs, b)) == sorted(((r.doc_id, *contaminated(r.text, items)) for r in docs.select("doc_id", "text").collect()), key=str)


def test_decontamination_of_nothing(spark, odd, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.contamination(odd, none).collect()} == {0}
    assert decontaminate.contamination(empty, none).count() == 0


def fingerprint(text):
    ws = lower(text).replace("\x0b", " ").replace("\x0c", " ").split() if False else re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def test_simhash_matches_brute_force(spark, documents, odd):
    for docs in (documents, odd):
        own = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
        group = list(range(len(own)))

        def root(i):
            while group[i] != i:
                i = group[i]
            return i

        for i, (_, a) in enumerate(own):
            for j in range(i):
                if (a ^ own[j][1]).bit_count() <= 3:
                    group[root(i)] = root(j)
        least = {}
        for i, (d, _) in enumerate(own):
            if d is not None:
                least[root(i)] = min(d, least.get(root(i), d))
        want = sorted(((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(own)), key=str)
        assert rows(simhash.document_classes(docs)) == want


@pytest.mark.parametrize("long_list", [1000, 3])
def test_no_near_fingerprint_is_lost(spark, monkeypatch, long_list):
    monkeypatch.setattr(simhash, "LONG_LIST", long_list)
    rng = random.Random(5)
    found = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        found.add(x)
        for _ in range(25):
            found.add(x ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(1, 4))}))
    fps = [x - (1 << 64) if x >> 63 else x for x in found]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()
    near = {(a, b) for a in fps for b in fps if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert all((r.a, r.b) in near for r in links)
    parts = []
    for pairs in (near, {(r.a, r.b) for r in links}):
        up = {x: x for x in fps}

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        parts.append({x: top(x) for x in fps})
    assert parts[0] == parts[1]


def test_one_of_each_component_stays(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert sorted(set(ids)) == sorted({r.component_id for r in simhash.document_classes(odd).collect() if r.component_id is not None})
    assert ids == [1, 2, 3, 6, 8, 9, 10, 10]  # the texts of id 10 are no near duplicates


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)}


def edit_distance_one(a, b):
    if a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def kept_lines(docs):
    order = []
    for d, t in docs:
        for pos, line in enumerate((t or "").split("\n")):
            ws = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if ws:
                order.append((d, t, pos, ws))
    first = {}
    for d, _, pos, ws in sorted(order, key=lambda x: (x[0], x[2])):
        first.setdefault(ws, (d, pos))
    near = {a for a in first for b in first if min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 1 and first[b] < first[a] and edit_distance_one(a, b)}
    gone = {(d, pos) for d, _, pos, ws in order if ws in near or first[ws] != (d, pos)}
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) if any(g[0] == d for g in gone) else t for d, t in docs}


def test_line_dedup_matches_brute_force(spark, documents):
    rng = random.Random(9)
    made = []
    for d in range(60):
        made.append((d, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 5)))))
    base = [f"w{i}" for i in range(12)]
    for d in range(60, 120):
        ws = list(base)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(ws))
            kind = rng.choice("dis")
            ws[i : i + (kind != "i")] = [] if kind == "d" else [f"x{rng.randrange(4)}"]
        made.append((d, " ".join(ws)))
    for docs in (spark.createDataFrame(made, "doc_id long, text string"), documents):
        have = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = {r.doc_id: r.text for r in line_dedup.deduplicated(docs).collect()}
        assert got == kept_lines(have)


def test_line_dedup_of_odd_rows(odd, empty):
    out = line_dedup.without_repeats(odd)
    got = sorted((r.row.doc_id or 0, r.kept_text, r.n_lines, r.n_gone) for r in out.where("row.doc_id in (1, 2, 4, 5, 7) or row.doc_id = 10").collect())
    assert out.count() == odd.count()
    texts = {g[0]: g[1] for g in got}
    assert texts[1] == "one two three four five six seven\nRepeated line of six plain words\n"
    assert texts[2] == "short line" and texts[4] == "" and texts[5] == " \n\t " and texts[7] == ""
    assert line_dedup.deduplicated(empty).count() == 0
    nothing = out.where("row.text is null").collect()
    assert nothing and all(r.kept_text is None and r.n_lines == 0 for r in nothing)


def repeats(texts, size):
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((len(t), int(gone.sum()), len(edge) // 2, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("run", [20_000, 1])
def test_repeated_strings_match_brute_force(spark, documents, odd, run):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdef é") for _ in range(400))
    made = []
    for d in range(80):
        a, b = sorted(rng.randrange(400) for _ in range(2))
        made.append((d, "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(30))) + passage[a:b] + "".join(rng.choice("uvwxyz") for _ in range(rng.randrange(300)))))
    made += [(200, "ab" * 300), (201, "a" * 199), (202, "a" * 200), (203, None), (204, passage[:250]), (204, passage[:250])]
    for docs in (spark.createDataFrame(made, "doc_id long, text string"), documents, odd.where("length(coalesce(text, '')) < 1000")):
        have = [(r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
        want = sorted(((d, *x) for (d, _), x in zip(have, repeats([t for _, t in have], 200), strict=True)), key=str)
        got = suffix_dedup.deduplicated(docs, run=run).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert rows(got) == want


def test_repeated_strings_of_nothing(empty):
    assert suffix_dedup.deduplicated(empty).count() == 0


def test_line_dedup_without_bitmaps_and_with_shorter_lines(spark, documents, monkeypatch):
    docs = documents.limit(60)
    want = rows(line_dedup.deduplicated(docs))
    monkeypatch.setattr("loamline.llm.shared.MOST_MARKS", 0)
    assert rows(line_dedup.deduplicated(docs)) == want
    few = spark.createDataFrame([(1, "one two three\none two four\nplain"), (2, "one three")], "doc_id long, text string")
    assert [r.n_gone for r in line_dedup.without_repeats(few).collect()] == [0, 0]
    gone = {r.row.doc_id: r.kept_text for r in line_dedup.without_repeats(few, least_words=2).collect()}
    assert gone == {1: "one two three\nplain", 2: ""}
