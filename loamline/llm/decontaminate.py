"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are windows of words. For each length of window, a table gives for every block of the
last words how far the search may jump: blocks that end no window let it skip to the next place where
one could end. Where the jump is zero, the block's hash names a bucket of windows; what follows are the
whole window's hash and the comparison of the very bytes. Many places of a text jump at once, as numpy
lanes. Tables have two slots and more for each block of a window, so they don't fill up as a benchmark grows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .shared import sent, with_text

WINDOW = 13
BLOCK = 3
#: Bytes of benchmark text in one search index. Larger benchmarks are searched for in as many passes.
INDEX_BYTES = 8 << 20
_LANE = 256
_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(_ODD)


def item_words(text: str) -> list[bytes]:
    data = bw.LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = bw.spans(data, np.array([0, len(data)]), bw.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words that end at each place; the first size-1 places mean nothing."""
    out = h.copy()
    for k in range(1, size):
        out[k:] += h[:-k] * np.uint64(pow(_ODD, k, 1 << 64))
    return (out ^ (out >> np.uint64(31))) * _MIX


class Patterns:
    """Windows of one length, as arrays: nothing is held for each window but its last block, its whole hash and where its words stand."""

    def __init__(self, words: Words, ends: np.ndarray, size: int):
        """`ends`: the last words of the windows, as places in `words`."""
        self.size, self.block, self.words = size, min(BLOCK, size), words
        blocks, wholes = rolled(words.h, self.block), rolled(words.h, size)
        bits = min(max(int(len(ends) * size).bit_length() + 1, 12), 25)  # two slots and more for each block
        self.shift = np.uint64(64 - bits)
        self.jump = np.full(1 << bits, size - self.block + 1, dtype=np.uint8)
        for back in range(size - self.block, -1, -1):  # nearer ends last, so the shortest jump stays
            self.jump[(blocks[ends - back] >> self.shift).astype(np.int64)] = back
        order = np.argsort(blocks[ends], kind="stable")
        self.ends, self.blocks, self.wholes = ends[order].astype(np.int32), blocks[ends][order], wholes[ends][order]

    def places(self, h: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place where a window ends, window), by equal blocks and hashes. row_start: for each word, the index of its row's first word."""
        blocks = rolled(h, self.block)
        jump = self.jump[(blocks >> self.shift).astype(np.int64)]
        at = np.arange(self.size - 1, len(h), _LANE, dtype=np.int64)
        end = np.minimum(at + _LANE, len(h))
        found = []
        while len(at):
            step = jump[at]
            stop = step == 0
            if stop.any():
                found.append(at[stop])
            at = at + np.maximum(step, 1)
            live = at < end
            at, end = at[live], end[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        e = np.sort(np.concatenate(found))
        e = e[e - self.size + 1 >= row_start[e]]
        first, last = np.searchsorted(self.blocks, blocks[e]), np.searchsorted(self.blocks, blocks[e], "right")
        n = last - first
        e, bucket = np.repeat(e, n), np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if not len(e):
            return e, bucket
        same = self.wholes[bucket] == rolled(h, self.size)[e]
        return e[same], bucket[same]


@dataclass
class Words:
    """Words of many texts: bytes, where each starts and ends, the first word of each text (one more than texts), hashes."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    h: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        low = bw.LOWER[data]
        starts, ends, rows = bw.spans(low, offsets, bw.ALNUM)
        return cls(low, starts.astype(np.int32), ends.astype(np.int32), rows, bw.hashes(low, starts, ends))


class Index:
    """What to search for: windows of WINDOW words of every item, or the whole of a shorter one."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = [i for i, _ in items]
        raw = [t.encode() for _, t in items]
        self.words = w = Words.of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        counts = np.diff(w.rows)
        size_of = np.repeat(np.minimum(counts, window), counts)
        place = np.arange(len(w.h)) - np.repeat(w.rows[:-1], counts)
        self.item_of = np.repeat(np.arange(len(items), dtype=np.int32), counts)
        self.patterns = [Patterns(w, np.flatnonzero((size_of == size) & (place >= size - 1)), int(size)) for size in np.unique(size_of)]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int]], set]]:
        """For each text: its number of words, the (first, last) words of all occurrences, and their items."""
        data, offsets = bw.utf8(texts)
        for a, b in bw.blocks(offsets):
            w = Words.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            spans: list[list[tuple[int, int]]] = [[] for _ in range(b - a)]
            items: list[set] = [set() for _ in range(b - a)]
            n = np.diff(w.rows)
            row_of, row_start = np.repeat(np.arange(b - a), n), np.repeat(w.rows[:-1], n)
            for p in self.patterns if len(w.h) else ():
                before, text = -1, []
                for e, bucket in zip(*(x.tolist() for x in p.places(w.h, row_start)), strict=True):
                    end = int(p.ends[bucket])
                    if e != before:
                        before, text = e, _written(w, e, p.size)
                    if text == _written(self.words, end, p.size):
                        r = row_of[e]
                        last = int(e - w.rows[r])
                        spans[r].append((last - p.size + 1, last))
                        items[r].add(self.names[self.item_of[end]])
            yield from zip(n.tolist(), spans, items, strict=True)


def _written(w: Words, end: int, size: int) -> list[bytes]:
    """The very bytes of `size` words up to the one at `end`."""
    return [w.data[a:b].tobytes() for a, b in zip(w.starts[end - size + 1 : end + 1], w.ends[end - size + 1 : end + 1], strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def indexes(benchmark: DataFrame, *, text: str = "text", key: str = "item_id", index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """Search indexes of at most about `index_bytes` of text each. Null texts are skipped; items with a null key mark words but are not named."""
    rows = benchmark.select(F.col(key).cast("string").alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, math.ceil(total / index_bytes))
    for part in range(parts):
        yield Index([(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part).collect()])


def annotated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", percent: int = 5) -> DataFrame:
    """All rows and columns of `docs` as struct `row`, with n_words, n_hit, spans (flat list of first and last words), items, contaminated.

    A word inside any occurrence of a window is hit; contaminated: n_hit > 0 and n_hit at least `percent`
    percent of n_words. Null and empty texts have no words. An empty benchmark hits nothing. Rows are
    judged one by one, without a shuffle; benchmarks over INDEX_BYTES take a pass for each part.
    """
    per = 100 // percent
    out = None
    held = "found"
    while held in (c.lower() for c in docs.columns):
        held += "_"
    for index in indexes(benchmark):
        shared = sent(docs.sparkSession, index)

        def run(texts: pa.Array, shared=shared) -> dict[str, pa.Array]:
            n_words, spans, items = [], [], []
            for n, found, named in shared.value.search(texts):
                n_words.append(n)
                spans.append([x for ab in merged(found) for x in ab])
                items.append(sorted(i for i in named if i is not None))
            return {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(items, pa.list_(pa.string()))}

        if out is None:
            out = with_text(docs, text, run, "n_words long, spans array<int>, items array<string>")
        else:
            columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
            flat = out.select(*columns, F.struct("spans", "items").alias(held))
            more = with_text(flat, text, run, "n_words long, spans array<int>, items array<string>")
            row = F.struct(*[F.col(f"row.`{c}`") for c in docs.columns]).alias("row")
            out = more.select(row, "n_words", F.concat(f"row.`{held}`.spans", "spans").alias("spans"), F.array_union(f"row.`{held}`.items", "items").alias("items"))
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.struct(F.get("spans", (2 * i).cast("int")).alias("a"), F.get("spans", (2 * i + 1).cast("int")).alias("b"))))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    union = F.aggregate(pairs, start, lambda x, s: F.struct(F.greatest(x["end"], s["b"]).alias("end"), (x["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(x["end"], s["a"] - 1))).alias("n")))["n"]
    n_hit = F.when(F.size("spans") == 0, F.lit(0)).otherwise(union).cast("long")
    found = out.withColumn("n_hit", n_hit).withColumn("items", F.sort_array("items"))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * per >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of `docs`; see annotated."""
    a = annotated(docs.select(key, text), benchmark, text=text)
    return a.select(F.col(f"row.`{key}`").alias(key), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")

