"""Token ids of whole texts in files of compressed planes, and back.

A file holds ids in blocks of a fixed number. A block is transposed: byte planes hold first every id's
lowest byte, then the second and so on; bit planes likewise for single bits. Each plane is compressed
alone with zstandard. Beside the blocks stand batches of document keys and lengths. The footer indexes
both, so a reader may start at any block.

    magic | block or key batch, in any order | footer (JSON) | length of the footer, 8 bytes | magic

A folder of files has an index table (`index`, one row for each file, written by Spark) and `header.json`.
Tasks give files names of their own, and a file counts once the index names it: what a lost or repeated
task has left is no part of the folder and is deleted at the end.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import mapped
from .tokens import byte_symbols

MAGIC = b"idplane1"
END_ID = 2
BLOCK_IDS = 1 << 16
#: Ids in a file, after which a task begins another.
FILE_IDS = 1 << 26
#: Documents in a batch of keys.
KEY_ROWS = 1 << 14
#: Strings that a Python worker remembers, and as many older ones.
REMEMBERED = 700_000
_BEFORE_WORD = re.compile(r"(?=[ \n]\S)")


class Uneven(Exception):
    """White space that plain cuts don't keep together."""


class Ids(dict):
    """From strings that begin and end where pre-tokens do to their ids, as little-endian bytes of four; the library is asked for new ones.

    A space before a visible character always opens a pre-token, and a line feed before one is a
    pre-token; so texts may be cut there. Longer runs of white space must stay whole; parts with such runs
    have a memory of their own, so that plain cuts never meet them. A string met again is found until
    REMEMBERED others have come twice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model, self.symbols = tokenizer.encode, tokenizer.model.tokenize, byte_symbols()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.older, self.runs = {}, {}

    def asked(self, part: str) -> bytes:
        """A word of Latin letters is one pre-token, and so are the marks after it: the merge rules alone are asked for them. All else goes through the whole library."""
        word = part.rstrip(".,!?;:")
        letters = word[1:] if word[:1] == " " else word
        if letters.isalpha() and (letters.isascii() or max(letters) < "\u0250"):
            symbols = letters if letters.isascii() else "".join(map(self.symbols.__getitem__, letters.encode()))
            ids = [t.id for t in self.model(symbols if letters is word else "\u0120" + symbols)]
            if len(word) == len(part):
                return struct.pack(f"<{len(ids)}I", *ids)
            return struct.pack(f"<{len(ids)}I", *ids) + self.run(part[len(word) :])
        ids = self.encode(part, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def run(self, part: str) -> bytes:
        if (out := self.runs.get(part)) is None:
            out = self.asked(part)
            if len(part) <= 64:
                if len(self.runs) >= REMEMBERED:
                    self.runs.clear()
                self.runs[part] = out
        return out

    def __missing__(self, part: str) -> bytes:
        word = part[1:] if part[:1] == " " else part
        if part != "\n" and word.split() != [word]:
            raise Uneven
        out = self.older.get(part) or self.asked(part)
        if len(part) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[part] = out
        return out

    def of(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # they end what stands before them, like the end of the text
            return self.run(text)
        if "\0" not in text:
            try:
                return b"".join(map(self.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))
            except Uneven:
                pass
        return b"".join([self.run(p) for p in _BEFORE_WORD.split(text) if p])


@functools.lru_cache(2)
def ids_here(path: str) -> Ids:
    """The memory of this Python worker, kept between its tasks."""
    return Ids(path)


def planes_of(block: bytes, bits: bool) -> list[bytes]:
    """The planes of a block of 4-byte ids, lowest byte or bit first; a block that isn't a multiple of eight ids is filled up in its last bytes of each bit plane."""
    raw = np.frombuffer(block, np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, i].tobytes() for i in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, i], bitorder="little").tobytes() for i in range(32)]


def block_of(planes: list[bytes], n: int, bits: bool) -> bytes:
    """What planes_of was given, of n ids."""
    if not bits:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).tobytes()
    flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(flat, axis=1, bitorder="little").tobytes()


class FileWriter:
    """One file; the folder's `fs` may be any that pyarrow opens."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: pa.DataType, *, bits: bool, block: int, level: int):
        self.out, self.kind, self.bits, self.block = fs.open_output_stream(path), kind, bits, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.blocks, self.batches, self.ids, self.keys, self.lengths = [], [], bytearray(), [], []
        self.n_docs = self.n_ids = self.at = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: Any, ids: bytes) -> None:
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.n_docs, self.n_ids = self.n_docs + 1, self.n_ids + len(ids) // 4
        self.ids += ids
        if len(self.ids) >= 4 * self.block:
            whole = len(self.ids) // (4 * self.block) * 4 * self.block
            for i in range(0, whole, 4 * self.block):
                self._block(bytes(self.ids[i : i + 4 * self.block]))
            del self.ids[:whole]
        if len(self.keys) >= KEY_ROWS:
            self._batch()

    def _block(self, ids: bytes) -> None:
        packed = [self.pack(p) for p in planes_of(ids, self.bits)]
        self.blocks.append([self.at, len(ids) // 4, [len(p) for p in packed]])
        self._write(b"".join(packed))

    def _batch(self) -> None:
        rows = pa.record_batch([pa.array(self.keys, self.kind), pa.array(self.lengths, pa.int64())], names=["key", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_batch(rows)
        packed = self.pack(sink.getvalue().to_pybytes())
        self.batches.append([self.at, len(packed), len(self.keys)])
        self._write(packed)
        self.keys, self.lengths = [], []

    def close(self) -> None:
        if self.ids:
            self._block(bytes(self.ids))
        if self.keys:
            self._batch()
        footer = json.dumps({"bits": self.bits, "n_docs": self.n_docs, "n_ids": self.n_ids, "blocks": self.blocks, "keys": self.batches}).encode()
        self._write(footer + len(footer).to_bytes(8, "little") + MAGIC)
        self.out.close()


class FileReader:
    """One file, read by its footer's index."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no whole file of planes")
        n = int.from_bytes(tail[:8], "little")
        self.footer = json.loads(self.file.read_at(n, size - 16 - n))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def block(self, i: int) -> bytes:
        at, n, sizes = self.footer["blocks"][i]
        data, planes = self.file.read_at(sum(sizes), at), []
        for s in sizes:
            planes.append(self.unpack(data[:s]))
            data = data[s:]
        return block_of(planes, n, self.footer["bits"])

    def documents(self) -> Iterator[tuple[Any, int, Iterator[memoryview]]]:
        """(key, number of ids, their bytes in pieces) in the file's order; take the pieces before the next document."""
        left, following = memoryview(b""), iter(range(len(self.footer["blocks"])))
        for at, size, _ in self.footer["keys"]:
            rows = pa.ipc.open_stream(self.unpack(self.file.read_at(size, at))).read_next_batch()
            for key, n in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                pieces, due = [], 4 * n
                while due > len(left):
                    if left:
                        pieces.append(left)
                        due -= len(left)
                    left = memoryview(self.block(next(following)))
                if due:
                    pieces.append(left[:due])
                    left = left[due:]
                yield key, n, iter(pieces)


class Folder(NamedTuple):
    """A written folder: its address, files and ids."""

    path: str
    n_files: int
    n_docs: int
    n_ids: int


def _at(folder: str, *more: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, "/".join([path.rstrip("/"), *more])


def write_ids(docs: DataFrame, path: str, folder: str, *, text: str = "text", key: str = "doc_id", end_id: int = END_ID, bits: bool = False, block: int = BLOCK_IDS, level: int = 3, file_ids: int = FILE_IDS) -> Folder:
    """Writes the ids of every row's whole text, with `end_id` after each, into `folder`, in ascending order of `key`.

    path: the tokenizer's file. Null and empty texts have the end id alone. A null key comes first; equal
    keys go by a hash of the text, and rows repeated in full stay repeated. A key of most rows is dealt
    over many files by that hash. Other columns are ignored; an empty table makes a folder without files.
    Texts are shuffled once, by range; a task holds one batch of texts and one block of ids at a time. The
    driver gets one row for each file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    order = ["k", F.xxhash64("t"), F.monotonically_increasing_id()]
    rows = rows.withColumns({"o1": order[1], "o2": order[2]})
    dealt = rows.repartitionByRange("k", "o1", "o2").sortWithinPartitions("k", "o1", "o2").select("k", "t")
    end = end_id.to_bytes(4, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _at(folder)
        part, of = TaskContext.get().partitionId(), ids_here(path).of
        done, now, name = [], None, ""

        def closed() -> None:
            now.close()
            done.append((part, len(done), name, now.n_docs, now.n_ids, now.at))

        try:
            for b in batches:
                kind = b.schema.field(0).type
                for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if now is None:
                        name = f"ids-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.bin"
                        now = FileWriter(fs, f"{top}/{name}", kind, bits=bits, block=block, level=level)
                    now.add(k, of(t.as_py() or "") + end)
                    if now.n_ids >= file_ids:
                        closed()
                        now = None
        except BaseException:
            if now is not None:
                now.out.close()
            raise
        if now is not None:
            closed()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "file", "n_docs", "n_ids", "n_bytes"), d, strict=True)) for d in done], schema=_INDEX_ARROW)

    fs, top = _at(folder)
    fs.create_dir(top, recursive=True)
    mapped(dealt, write, INDEX).write.parquet(f"{folder}/index")
    files = sorted(spark.read.schema(INDEX).parquet(f"{folder}/index").collect(), key=lambda r: (r["part"], r["seq"]))
    named = {r["file"] for r in files}
    for found in fs.get_file_info(pafs.FileSelector(top)):
        if found.base_name.startswith("ids-") and found.base_name not in named:
            fs.delete_file(found.path)
    kind = rows.schema["k"].dataType.simpleString()
    starts, total = [], 0
    for r in files:
        starts.append([r["file"], total])
        total += r["n_ids"]
    head = {"format": MAGIC.decode(), "key": key, "key_type": kind, "end_id": end_id, "block": block, "bits": bits, "n_ids": total, "n_docs": sum(r["n_docs"] for r in files), "files": starts}
    with fs.open_output_stream(f"{top}/header.json") as out:
        out.write(json.dumps(head).encode())
    return Folder(folder, len(files), head["n_docs"], total)


INDEX = "part int, seq int, file string, n_docs long, n_ids long, n_bytes long"
_INDEX_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])


def _read(spark: SparkSession, folder: str, more: str, row) -> DataFrame:
    fs, top = _at(folder)
    with fs.open_input_stream(f"{top}/header.json") as f:
        head = json.loads(f.read())
    schema = T._parse_datatype_string(f"k {head['key_type']}, start long, n_tokens long, {more}")
    files = spark.createDataFrame(head["files"], "file string, start long")
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema.fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _at(folder)
        for b in batches:
            for f in b.to_pylist():
                out, held, at = [], 0, f["start"]
                for k, n, pieces in FileReader(fs, f"{top}/{f['file']}").documents():
                    out.append((k, at, n, row(pieces)))
                    at, held = at + n, held + n
                    if len(out) >= KEY_ROWS or held >= 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    spread = files.repartition(max(1, len(head["files"]))) if head["files"] else files
    return mapped(spread, read, schema).withColumnRenamed("k", head["key"])


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids array<int>) of every document in a folder, one task for each file; `start` counts the ids of all documents before it."""
    return _read(spark, folder, "ids array<int>", lambda pieces: np.frombuffer(b"".join(pieces), "<u4").astype(np.int32))


def _crc32(pieces: Iterator[memoryview]) -> int:
    out = 0
    for p in pieces:
        out = zlib.crc32(p, out)
    return out


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document in a folder: as read_ids, with the crc32 of its ids as little-endian unsigned 32-bit integers in place of them."""
    return _read(spark, folder, "ids_crc32 long", _crc32)


def written_and_read(docs: DataFrame, path: str, folder: str, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """digests() of the folder that write_ids() makes of docs; the folder stays."""
    write_ids(docs, path, folder, text=text, key=key)
    return digests(docs.sparkSession, folder)
