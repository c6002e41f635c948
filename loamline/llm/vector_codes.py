"""Product codes of vectors by Lloyd's rounds whose sums are maintained by differences.

Every round writes each vector's present code beside the one before. Only parts whose code changed give
anything to the sums: their components are added to the new entry and taken from the old one, combined
within each task before the shuffle, so that what travels is bounded by entries and tasks, whatever the
number of vectors. Sums and counts of all entries are kept between rounds; they are bounded by the
codebooks' size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import dropped, mapped, sent, stored, stored_at

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Components are held within plus and minus this, so that squares and sums stay in 64 bits.
MOST = 1 << 27
#: Labels up to this number go to every executor; more are joined by shuffle.
BROADCAST_LABELS = 100_000


class Codebooks(NamedTuple):
    """Integer entries by part, entry and position, and what they are kept up by."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: the first of the nearest entries and its squared distance, exactly. Products are made in doubles where all of them fit without rounding, else in integers."""
    most = int(max(np.abs(part).max(initial=0), np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * max(1, part.shape[1]) * most * most < 1 << 53 else np.int64
    p, e = part.astype(kind), entries.astype(kind)
    distance = (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)[None, :]
    codes = distance.argmin(1)
    return codes, distance[np.arange(len(codes)), codes].astype(np.int64)


def usable(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """(k, label, v) of the vectors without null and non-finite components, scaled to integers; and the components in a part. Vectors shorter than the longest, rounded up to whole parts, end in zeros."""
    v = F.col(vector)
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x.cast("double") * SCALE, F.lit(-2.0 * MOST)), F.lit(2.0 * MOST))), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    rows = stored(vectors.where(v.isNotNull() & whole).select(F.col(key).alias("k"), F.col(label).alias("label"), scaled.alias("v")))
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows, -(-longest // parts)


def _matrix(v: pa.ListArray, width: int) -> np.ndarray:
    """The lists as rows of one matrix, filled up with zeros."""
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.asarray(v.offsets, np.int64)
    lengths = np.diff(ends)
    if len(flat) == len(v) * width:
        return flat.reshape(len(v), width).astype(np.int64)
    out = np.zeros((len(v), width), np.int64)
    row = np.repeat(np.arange(len(v)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lengths)] = flat
    return out


def assigned(rows: DataFrame, codebooks: np.ndarray, before: str | None) -> DataFrame:
    """Rows with `code` (an entry for each part) and `error`; `was` is the column `before`, or null."""
    spark, (parts, _, size) = rows.sparkSession, codebooks.shape
    book = sent(spark, codebooks)
    packed = rows.select("k", "label", "v", (F.col(before) if before else F.lit(None).cast("array<int>")).alias("was"))
    names = [*packed.columns, "code", "error"]
    schema = T.StructType([*packed.schema.fields, *T._parse_datatype_string("code array<int>, error long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(2), parts * size)
            found = [nearest(m[:, i * size : (i + 1) * size], book.value[i]) for i in range(parts)]
            codes = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(sum(d for _, d in found))], names=names)

    return mapped(packed, run, schema)


def changes(rows: DataFrame, parts: int, size: int) -> np.ndarray:
    """What parts whose code changed give to and take from each (part, entry): the difference of counts, then of each component's sum. The driver gets a row for each entry met, at most parts times entries."""
    slices = F.array(*[F.struct(F.lit(i).alias("part"), F.get("code", F.lit(i)).alias("new"), F.get("was", F.lit(i)).alias("old"), F.slice("v", i * size + 1, size).alias("v")) for i in range(parts)])
    moved = rows.select(F.explode(F.filter(slices, lambda s: ~s["new"].eqNullSafe(s["old"]))).alias("s")).select("s.*")
    both = F.array(F.struct(F.col("new").alias("entry"), F.lit(1).alias("sign")), F.struct(F.col("old").alias("entry"), F.lit(-1).alias("sign")))
    signed = moved.select("part", "v", F.explode(both).alias("e")).select("part", "v", "e.*").where("entry is not null")
    sums = [F.sum(F.coalesce(F.get("v", F.lit(j)), F.lit(0)).cast("long") * F.col("sign")) for j in range(size)]
    found = signed.groupBy("part", "entry").agg(F.sum("sign"), *sums).collect()
    return np.array([tuple(r) for r in found], np.int64).reshape(len(found), size + 3)


def moved_on(now: Codebooks, delta: np.ndarray) -> Codebooks:
    """The sums after the changes, and each entry in use at the floor of its mean."""
    sums, counts, entries = now.sums.copy(), now.counts.copy(), now.entries.copy()
    if len(delta):
        at = delta[:, 0], delta[:, 1]
        counts[at] += delta[:, 2]
        sums[at] += delta[:, 3:]
    used = counts > 0
    entries[used] = sums[used] // counts[used][:, None]
    return Codebooks(entries, sums, counts)


def fitted(rows: DataFrame, size: int, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """Codebooks after the rounds, and the rows with codes by them. Entries begin as the parts of the smallest keys (null last; equal keys by their components), fewer if there are fewer rows. A round that moves no entry ends the loop, as later ones would change nothing."""
    spark = rows.sparkSession
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((parts, len(first), size), np.int64)
    for i, r in enumerate(first):
        start[:, i] = np.array([*r["v"], *[0] * (parts * size - len(r["v"]))], np.int64).reshape(parts, size)
    now = Codebooks(start, np.zeros_like(start), np.zeros(start.shape[:2], np.int64))
    if not first:
        return now, rows.withColumns({"code": F.array().cast("array<int>"), "error": F.lit(0).cast("long")})
    before, state, path = None, rows, None
    for _ in range(rounds):
        new, new_path = stored_at(assigned(state, now.entries, before))
        after = moved_on(now, changes(new, parts, size))
        if path:
            dropped(spark, path)
        before, state, path = "code", new, new_path
        still, now = np.array_equal(after.entries, now.entries), after
        if still:
            break
    final = stored(assigned(state, now.entries, before))
    if path:
        dropped(spark, path)
    return now, final


def coded(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), one row for each vector without null and non-finite components.

    code: the nearest entry of each part, two hex digits each. error: squared distances summed over the
    parts; label_error: over all rows of the label (null is one label). A null vector, and one that holds
    null, NaN or an infinity, has no row; repeated rows stay repeated; a null key is the last to open a
    codebook; an empty vector is all zeros; components beyond 131 072 are held there. Vectors of a length
    of their own end in zeros. An empty table gives an empty one. Other columns are ignored.
    """
    rows, size = usable(vectors, vector=vector, key=key, label=label)
    books, final = fitted(rows, size)
    hexed = F.concat_ws("", F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")))
    by_label = stored(final.groupBy("label").agg(F.sum("error").alias("label_error")))
    small = by_label.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    r = (F.broadcast(by_label) if small else by_label).alias("r")
    met = final.select("k", "label", hexed.alias("code"), "error").alias("d").join(r, F.expr("d.label <=> r.label"))
    return met.select(F.col("k").alias(key), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
