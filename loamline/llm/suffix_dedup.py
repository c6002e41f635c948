"""Removal of repeated byte strings: every byte inside a string of SIZE bytes that also starts elsewhere.

Texts are cut at anchors: the anchor of a string of SIZE bytes is the smallest (hashed) K bytes in it,
so equal strings have equal anchors at equal distances wherever they stand. Neighbouring strings with
the same anchor form a context, one row. Contexts whose anchor stands nowhere else are done; equal
contexts are repeated throughout; different contexts of one anchor are compared string by string, those
of an anchor in one sorted run, or, where an anchor has very many, as counted hashes of single strings.
Equality is that of 64-bit hashes of strings together with 64-bit hashes of their anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords as bw
from .shared import cut, mapped, stored

SIZE, K = 200, 64
#: Different contexts of one anchor that are compared in one task; more are counted by hash over all tasks.
RUN = 20_000
_SHIFT, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = bw._powers_to(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def _between(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (sums[b] - sums[a]) * bw._powers["down"][a]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    n = len(values)
    rows = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return np.minimum(back[:m], ahead[width - 1 : width - 1 + m])


def contexts(text: bytes, size: int = SIZE, k: int = K) -> tuple[np.ndarray, ...]:
    """For each context of a text: anchor hash, context hash, first string, number of strings, the anchor's distance from the first."""
    if len(text) < size:
        return (np.zeros(0, np.int64),) * 5
    sums = _sums(np.frombuffer(text, np.uint8))
    grams = _between(sums, np.arange(len(text) - k + 1), np.arange(k, len(text) + 1))
    packed = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(packed, size - k + 1) & _LOW).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    last = np.concatenate([first[1:] - 1, [len(anchor) - 1]])
    whole = _between(sums, first, last + size) ^ (last - first).astype(np.uint64)
    return grams[anchor[first]].view(np.int64), whole.view(np.int64), first, last - first + 1, anchor[first] - first


def _anchored(docs: DataFrame, size: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [contexts((t.as_py() or "").encode(), size, k) for t in b.column(2)]
            at = np.repeat(np.arange(b.num_rows), [len(f[0]) for f in found])
            g, c, lo, n, off = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(g), pa.array(c), *(pa.array(x.astype(np.int32)) for x in (lo, n, off))], names=["id", "th", "g", "c", "lo", "n", "off"])

    kind = docs.schema["id"].dataType.simpleString()
    return mapped(docs.select("id", "th", "t"), run, f"id {kind}, th long, g long, c long, lo int, n int, off int")


def repeated_in(group: np.ndarray, text: list[bytes], n: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """First and last string of each context that another context of its group has too; -1 if none."""
    context, string, keys = string_keys(group, text, n, off, size)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    first, last = np.full(len(text), np.iinfo(np.int64).max), np.full(len(text), -1)
    np.minimum.at(first, context[twice], string[twice])
    np.maximum.at(last, context[twice], string[twice])
    first[last < 0] = -1
    return first, last


def string_keys(group: np.ndarray, text: list[bytes], n: np.ndarray, off: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every string of contexts: the context's number, the string's number in it, a hash of group, distance to the anchor and bytes."""
    starts = np.concatenate([[0], np.cumsum([len(t) for t in text])])[:-1].astype(np.int64)
    sums = _sums(np.frombuffer(b"".join(text), np.uint8))
    context = np.repeat(np.arange(len(text)), n)
    string = np.arange(len(context)) - np.repeat(np.cumsum(n) - n, n)
    h = _between(sums, starts[context] + string, starts[context] + string + size)
    place = group.view(np.uint64)[context] * np.uint64(0x9E3779B97F4A7C15) + (off[context] - string).astype(np.uint64)
    key = (h ^ (place ^ (place >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)) * np.uint64(0xBF58476D1CE4E5B9)
    return context, string, key


def whole_groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.Table]:
    """Tables that hold all rows of the keys in them, from batches sorted by the key. Only the last key's rows are held over."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(column).to_numpy(zero_copy_only=False)
        if held and held[-1].column(column)[0].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        last = int(np.searchsorted(k, k[-1]))
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _sliced(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(g, c, n, off, bytes) of contexts given as (id, th, g, c, lo, n, off)."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("g", "c", "lo", "n", "off")).alias("cs"))
    met = docs.alias("d").join(lists.alias("w"), F.expr("d.id <=> w.id and d.th = w.th")).select("d.t", "w.cs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, cs in zip(b.column(0), b.column(1), strict=True):
                raw = t.as_py().encode()
                rows += [(x["g"], x["c"], x["n"], x["off"], raw[x["lo"] : x["lo"] + x["n"] - 1 + size]) for x in cs.as_py()]
            g, c, n, off, text = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), pa.array(off, pa.int32()), pa.array(text, pa.binary())], names=["g", "c", "n", "off", "b"])

    return mapped(met, run, "g long, c long, n int, off int, b binary")


def _arrays(t) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    col = lambda name: t.column(name).to_numpy().astype(np.int64)
    return col("g"), t.column("b").to_pylist(), col("n"), col("off"), col("c")


def repeats(docs: DataFrame, *, size: int = SIZE, k: int = K, run: int = RUN) -> DataFrame:
    """From (id, th, t): (id, th, spans) for documents with repeated strings; spans: (first, last) start of repeated strings, in bytes, at most `size` apart, so that all between is covered."""
    found = _anchored(docs, size, k)
    anchors = found.groupBy("g").agg(F.count(F.lit(1)).alias("times"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("times > 1").select("g", (F.col("c1") != F.col("c2")).alias("mixed"))
    anchors = stored(anchors)  # so that the join is a step of its own, in which Spark splits the rows of a hot anchor
    again = cut(found.join(anchors, "g"))
    distinct = again.where("mixed").groupBy("g", "c").agg(F.min(F.struct("id", "th", "lo", "n", "off")).alias("x"), F.count(F.lit(1)).alias("times"))
    mixed = cut(distinct.select("g", "c", "times", "x.*"))
    crowded = mixed.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > run).select("g", F.lit(True).alias("crowd"))
    bytes_of = cut(_sliced(docs, mixed.select("id", "th", "g", "c", "lo", "n", "off"), size).join(crowded, "g", "left").withColumn("crowd", F.coalesce("crowd", F.lit(False))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 0):
            g, text, n, off, c = _arrays(t)
            first, last = repeated_in(g, text, n, off, size)
            hit = last >= 0
            yield pa.RecordBatch.from_arrays([pa.array(g[hit]), pa.array(c[hit]), pa.array(first[hit].astype(np.int32)), pa.array(last[hit].astype(np.int32))], names=["g", "c", "p", "q"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, text, n, off, c = _arrays(pa.Table.from_batches([b]))
            context, string, key = string_keys(g, text, n, off, size)
            yield pa.RecordBatch.from_arrays([pa.array(g[context]), pa.array(c[context]), pa.array(string.astype(np.int32)), pa.array(key.view(np.int64))], names=["g", "c", "s", "key"])

    near = bytes_of.where("not crowd").dropDuplicates(["g", "c"]).select("g", "c", "n", "off", "b").repartition("g").sortWithinPartitions("g")
    few = mapped(near, compare, "g long, c long, p int, q int")
    each = mapped(bytes_of.where("crowd").dropDuplicates(["g", "c"]).select("g", "c", "n", "off", "b"), strings, "g long, c long, s int, key long")
    twice = each.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    many = each.join(twice, "key", "left_semi").groupBy("g", "c").agg(F.min("s").alias("p"), F.max("s").alias("q"))
    part = few.unionByName(many)
    verdict = stored(mixed.select("g", "c", "times", "n").join(part, ["g", "c"], "left").select("g", "c", F.when(F.col("times") > 1, F.lit(0)).otherwise(F.col("p")).alias("p"), F.when(F.col("times") > 1, F.col("n") - 1).otherwise(F.col("q")).alias("q")).where("p is not null"))  # a step of its own, as for anchors
    pure = again.where("not mixed").select("id", "th", F.col("lo").alias("first"), (F.col("lo") + F.col("n") - 1).alias("last"))
    met = again.where("mixed").join(verdict, ["g", "c"]).select("id", "th", (F.col("lo") + F.col("p")).alias("first"), (F.col("lo") + F.col("q")).alias("last"))
    return pure.unionByName(met).groupBy("id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def removal(text: bytes, spans: list[tuple[int, int]], size: int = SIZE) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs [a, b), and what is left."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], b + size))
        else:
            runs.append((a, b + size))
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return runs, b"".join([*kept, text[at:]])


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = SIZE, k: int = K, run: int = RUN) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans), one row for each row of `docs`.

    Every byte inside a string of `size` bytes that also starts elsewhere, in this or another row, is
    removed; `spans` are the maximal removed runs (start, end). Null texts are empty, shorter ones lose
    nothing; repeated rows repeat each other in full. Counts are aggregated before the shuffle, so a
    passage that a third of all documents share is no single task's; texts are shuffled twice, to compare
    contexts that differ and to take the runs out.
    """
    slim = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).select("id", F.xxhash64("t").alias("th"), "t")
    found = repeats(slim, size=size, k=k, run=run)
    met = slim.alias("d").join(found.alias("f"), F.expr("d.id <=> f.id and d.th = f.th"), "left").select("d.id", "d.t", "f.spans")

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                raw = t.as_py().encode()
                runs, kept = removal(raw, [(x["first"], x["last"]) for x in s.as_py() or []], size)
                rows.append((len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": e} for a, e in runs]))
            n, gone, m, sha, runs = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(m, pa.int64()), pa.array(sha, pa.string()), pa.array(runs, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    kind = slim.schema["id"].dataType.simpleString()
    return mapped(met, out, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, end: int>>").withColumnRenamed("id", key)
