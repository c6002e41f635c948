import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loamline.llm import bytewords as bw

TEXT = st.text(alphabet="aB9 \t\n.é漢!", max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 50))
def test_words_of_columns_match_a_regex(texts, limit):
    data, offsets = bw.utf8(pa.array(texts, pa.string()))
    found = []
    for a, b in bw.blocks(offsets, limit):
        part = bw.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, rows = bw.spans(part, offsets[a : b + 1] - offsets[a], bw.ALNUM)
        raw = part.tobytes()
        found += [[raw[s:e].decode() for s, e in zip(starts[x:y], ends[x:y], strict=True)] for x, y in zip(rows[:-1], rows[1:], strict=True)]
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert found == [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t) for t in lower]


def test_hash_does_not_depend_on_place():
    data = np.frombuffer(b"abc xyz abc", np.uint8)
    h = bw.hashes(data, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[2] != h[1] and h[0] == bw.hash_of([b"abc"])[0]
