"""Vector codes against plain integer Lloyd rounds."""

import hashlib
import math
import random

import numpy as np
import pytest

from loamline.llm import vector_codes as V
from loamline.llm.shared import table

VECTORS = "vec_id long, embedding array<float>, label int, code string, v int, error string"


def brute(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, embedding, label)."""
    kept = [(k, [math.floor(1024 * float(x)) for x in e], label) for k, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    size = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = sorted(((k, v + [0] * (parts * size - len(v)), label) for k, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[tuple(v[i * size : (i + 1) * size]) for i in range(parts)] for _, v, _ in kept]
    books = [[c[i] for c in cut[:entries]] for i in range(parts)]

    def best(p, book):
        return min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for i in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(best(c[i], books[i])[1], []).append(c[i])
            for j, g in groups.items():
                books[i][j] = tuple(sum(x) // len(g) for x in zip(*g, strict=True))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for (k, _, label), c in zip(kept, cut, strict=True):
        found = [best(c[i], books[i]) for i in range(parts)]
        out.append((k, "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    return sorted(str((k, code, e, by_label[label], sha)) for k, code, e, label in out)


def found(df):
    return sorted(str(tuple(r)) for r in V.coded(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def made(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "e") for r in rows], VECTORS)


def test_few_vectors_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], rng.choice([0, 1, None])) for i in range(400)]
    rows += [(500, None, 1), (501, [None, *[0.1] * 7], 1), (502, [float("nan")] * 8, None), (503, [float("-inf"), *[0.0] * 7], 2), (None, [0.5] * 8, 2), (None, [-0.5] * 8, 2), (3, rows[3][1], rows[3][2])]
    rows += [(600 + i, [0.25] * 8, 3) for i in range(200)] + [(900, [], 1), (901, [0.1, 0.2, 0.3], 1), (902, [-0.0001] * 8, 1)]
    df = made(spark, rows)
    assert found(df) == brute([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1)], [(2, [1.0, 2.0, 3.0, 4.0], None), (1, [1.0, 2.0, 3.0, 4.0], None)]):
        assert found(made(spark, rows)) == brute(rows)
    far = V.coded(made(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)])).collect()
    assert [r.error for r in far] == [0, 0, 0]


@pytest.mark.parametrize("most", [3000, 1 << 20, 1 << 26])
def test_nearest_is_exact_and_takes_the_first(most):
    rng = np.random.default_rng(most)
    p, e = rng.integers(-most, most, (50, 16)), rng.integers(-most, most, (20, 16))
    e[7], p[3] = e[2], e[2]
    codes, d = V.nearest(p, e)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(e)) for x in p]
    assert list(zip(d.tolist(), codes.tolist(), strict=True)) == want and codes[3] == 2


def test_sums_kept_by_differences_equal_sums_made_anew(spark, sf_dir):
    rows, size = V.usable(table(spark, sf_dir, "embeddings"))
    books, _ = V.fitted(rows, size, rounds=3)
    again, _ = V.fitted(rows, size, rounds=2)
    codes = V.assigned(rows, again.entries, None).select("code", "v").collect()
    counts, sums = np.zeros_like(books.counts), np.zeros_like(books.sums)
    for r in codes:
        for i, c in enumerate(r.code):
            counts[i, c] += 1
            sums[i, c] += np.array(r.v[i * size : (i + 1) * size])
    assert (counts == books.counts).all() and (sums == books.sums).all()
