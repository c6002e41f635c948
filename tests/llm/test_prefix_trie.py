"""The conversation trie against a trie of dictionaries."""

import hashlib
import random
import zlib

import pytest

from loamline.llm import prefix_trie as P
from loamline.llm.shared import table

TURNS = "conv_id long, turn long, role string, text string, c long, depth string, n int"


def brute(rows):
    """rows: (conv_id, turn, role, text) with distinct turns."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members = {}
    for c, chain in built.items():
        for d in range(len(chain) + 1):
            members.setdefault(tuple(chain[:d]), []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + (len(members[p]) - 1) * len(p[-1][1] if p else "")
    out = []
    for p, m in members.items():
        ends = sorted(c for c in m if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in P.prefix_trie(df).collect())


def made(spark, rows):
    return spark.createDataFrame([(*r, 1, "d", 2) for r in rows], TURNS)


def test_table_matches_brute_force(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    assert found(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed", range(3))
def test_random_tries_match_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(P, "BLOCK", [3, 1024, 2][seed])
    monkeypatch.setattr(P, "CHUNK", [4, 1 << 20, 9][seed])
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(420), 150):
        shape = rng.random()
        for t in range(rng.choice([1, 2, 3, 4, 8, 15])):
            role, text = ("u", "a" * (t % 3)) if shape < 0.6 else (rng.choice(["u", None]), rng.choice(["a", "bé", None, "", "漢字x"]))
            rows.append((c, None if t == 0 and shape < 0.3 else t, role, text))
    rows += [(None, 1, "u", "nobody's"), (None, None, None, None), (7, None, None, None), (10**15, 1, "u", "far")]
    rng.shuffle(rows)
    rows = list({r[:2]: r for r in rows}.values())
    assert found(made(spark, rows).repartition(3)) == brute(rows)


def test_one_conversation_with_most_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 16)
    rows = [(5, t, "u", f"turn {t % 7}") for t in range(300)] + [(c, t, "u", f"turn {t % 7}") for c in (100, 105, 0) for t in range(40)]
    assert found(made(spark, rows)) == brute(rows)


def test_copies_ties_and_empty_tables(spark):
    rows = [(c, t, "u", "same") for c in range(60) for t in range(3)]
    assert found(made(spark, rows)) == brute(rows)
    twice = made(spark, [(200, 1, "u", "x"), (200, 1, "u", "x"), (200, 1, "a", "x")])
    got = P.prefix_trie(twice).orderBy("depth").collect()
    assert [(r.depth, r.n_convs) for r in got] == [(d, 1) for d in range(len(got))] and len(got) == 4
    assert found(made(spark, [])) == [] and found(made(spark, [(None, 1, "u", "x")])) == []
