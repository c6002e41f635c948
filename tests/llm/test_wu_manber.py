"""The search index of decontamination at its bound."""

import random
import time

import pyarrow as pa

from loamline.llm.decontaminate import INDEX_BYTES, Index


def test_index_at_its_bound_is_small_and_still_skips():
    draw = random.Random(1)
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(20_000)]
    items, size = [], 0
    while size < INDEX_BYTES:
        items.append((str(len(items)), " ".join(draw.choices(vocabulary, k=60))))
        size += len(items[-1][1])
    start = time.process_time()
    index = Index(items)
    assert time.process_time() - start < 10
    (p,) = index.patterns
    assert p.jump.mean() > 10 and p.jump.nbytes + p.blocks.nbytes + p.wholes.nbytes + p.ends.nbytes < 64 << 20
    own = draw.sample(range(len(items)), 40)
    texts = ["before " + items[i][1] + " after" for i in own] + [" ".join(draw.choices(vocabulary, k=300)) for _ in range(40)]
    found = list(index.search(pa.array(texts)))
    assert [items_ for _, _, items_ in found] == [{str(i)} for i in own] + [set()] * 40
    assert all(spans[0][0] == 1 and spans[-1][1] == 60 for _, spans, _ in found[:40])
