"""Files of id planes: exact round trips, and counts and checksums by the library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
import pytest

from loamline.llm import id_planes
from loamline.llm.shared import table_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_ids_match_the_library(library):
    rng = random.Random(5)
    parts = ["a", "b ", " ", "  ", "\n", " \n", "\t", "\x0b", "\x1c", "\x85", "　", "\0", "'ll", "é", "漢", "1", "#", "<|endoftext|>", " x", "word", ".", "\n\n"]
    of = id_planes.Ids(PATH).of
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert np.frombuffer(of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        block = rng.integers(0, 2**32, n, dtype=np.uint32).astype("<u4").tobytes()
        planes = id_planes.planes_of(block, bits)
        assert len(planes) == (32 if bits else 4) and id_planes.block_of(planes, n, bits) == block
    ones = id_planes.planes_of(np.array([1, 256, 1], "<u4").tobytes(), bits)
    assert ones[0] == (b"\x05" if bits else b"\x01\x00\x01") and ones[8 if bits else 1] == (b"\x02" if bits else b"\x00\x01\x00")


@pytest.mark.parametrize("bits", [False, True])
def test_documents_cross_blocks(tmp_path, bits):
    rng, fs = random.Random(2), pafs.LocalFileSystem()
    docs = [(i, np.array([rng.randrange(50000) for _ in range(rng.choice([0, 1, 5, 40]))], "<u4").tobytes()) for i in range(300)]
    w = id_planes.FileWriter(fs, f"{tmp_path}/f", pa.int64(), bits=bits, block=16, level=1)
    for k, ids in docs:
        w.add(k, ids)
    w.close()
    r = id_planes.FileReader(fs, f"{tmp_path}/f")
    assert [(k, b"".join(p)) for k, _, p in r.documents()] == docs
    assert r.footer["n_docs"] == 300 and {b[1] for b in r.footer["blocks"][:-1]} == {16}
    (tmp_path / "half").write_bytes((tmp_path / "f").read_bytes()[:-9])
    with pytest.raises(ValueError):
        id_planes.FileReader(fs, f"{tmp_path}/half")


def wanted(docs, library):
    """By document in order: key, number of ids before it, ids with the end."""
    data = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in docs.select("doc_id", "text").collect()]
    out, at = {}, 0
    for k, ids in sorted(data, key=lambda x: (x[0] is not None, x[0] or 0)):
        out.setdefault(k, []).append((at, ids))
        at += len(ids)
    return out


@pytest.mark.parametrize("which", ["documents", "odd", "empty"])
def test_folder_matches_brute_force(spark, request, library, which):
    docs, folder = request.getfixturevalue(which), table_path(spark)
    want = wanted(docs, library)
    made = id_planes.write_ids(docs, PATH, folder, block=512, file_ids=3000)
    n = sum(map(len, want.values()))
    assert (made.n_docs, made.n_ids) == (n, sum(len(i) for v in want.values() for _, i in v))
    got = {}
    for r in id_planes.read_ids(spark, folder).collect():
        got.setdefault(r.doc_id, []).append((r.start, list(r.ids)))
    sums = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in id_planes.digests(spark, folder).collect()}
    assert len(sums) == n and set(got) == set(want)
    for k, rows in want.items():
        assert sorted(map(str, (i for _, i in got[k]))) == sorted(map(str, (i for _, i in rows)))  # equal keys go by a hash
        starts, at = sorted(got[k]), min(s for s, _ in rows)
        for s, ids in starts:
            assert s == at
            at += len(ids)
            assert sums[k, s] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_files_that_the_index_lacks_are_no_part(spark, library):
    docs = spark.createDataFrame([(3, "c"), (1, "a b"), (2, None)], "doc_id long, text string")
    folder = table_path(spark)
    fs, top = pafs.FileSystem.from_uri(folder)
    fs.create_dir(top)
    with fs.open_output_stream(f"{top}/ids-000000-0000-lost.bin") as f:
        f.write(b"half a fi")
    id_planes.write_ids(docs, PATH, folder)
    assert [(r.doc_id, r.start) for r in id_planes.digests(spark, folder).orderBy("start").collect()] == [(1, 0), (2, 3), (3, 4)]
    assert not [f for f in fs.get_file_info(pafs.FileSelector(top)) if "lost" in f.path]
