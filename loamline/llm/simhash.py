"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two that differ in at most three bits share at least five of them, so
every such pair stands together in a posting list of at least one of the eight position triples
{0,1,2,3} or {4,5,6,7} choose 3 (five shared positions put three into one half). Each list is a run of
rows sorted by its key; there the positional bytes that pairs share are tallied, pairs below five are
dropped, the rest are verified bit by bit. Lists that grow long are split first: pairs in them share
two more of the other five bytes, so the list's rows go to ten longer keys, and no pair is lost.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, mapped, stored, with_text

BITS = 3
LEAST_SHARED = 8 - BITS
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in itertools.combinations(half, 3)]
#: Posting lists with more rows than this are split by two more bytes.
LONG_LIST = 1000
_SLICE = 1 << 15


def _bit_sums(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes) -> int:
    """64 majority bits of the XXH64 (seed 42) of all 3-word shingles; fewer words: of the whole sequence; none: 0. Signed."""
    import xxhash

    digest = functools.partial(xxhash.xxh64_intdigest, seed=42)
    ws = text.lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    ends = list(itertools.accumulate(len(w) + 1 for w in ws))
    if len(ws) < 3:
        starts, stops = [0], [len(joined)]
    else:
        starts, stops = [0, *ends[:-3]], [e - 1 for e in ends[2:]]
    sums = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), _SLICE):
        sums += _bit_sums([digest(joined[a:b]) for a, b in zip(starts[i : i + _SLICE], stops[i : i + _SLICE], strict=True)])
    return int(np.packbits(2 * sums > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(texts: pa.Array) -> dict[str, pa.Array]:
    """Equal texts of a batch are worked out once."""
    known: dict[str, int] = {}
    out = []
    for t in texts:
        t = t.as_py() or ""
        if (f := known.get(t)) is None:
            f = known[t] = fingerprint(t.encode())
        out.append(f)
    return {"fp": pa.array(out, pa.int64())}


def _byte(fp: Column, p: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255))


def _key(fp: Column, mark: int, positions: tuple[int, ...]) -> Column:
    """A long from which mark (under 2**16) and the bytes at positions can be read back."""
    out = F.lit(mark).cast("long")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(fp, p))
    return out


def posting_keys(fp: Column) -> Column:
    return F.array(*[_key(fp, i, t) for i, t in enumerate(TRIPLES)])


def longer_keys(fp: Column, triple: Column) -> Column:
    """For each triple, ten keys that also name two of the other five positions."""
    out = F.lit(None).cast("array<bigint>")
    for i, t in enumerate(TRIPLES):
        rest = [p for p in range(8) if p not in t]
        keys = F.array(*[_key(fp, 16 + 10 * i + j, (*t, *two)) for j, two in enumerate(itertools.combinations(rest, 2))])
        out = F.when(triple == i, keys).otherwise(out)
    return out


def linked(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spanning links of one posting list: everything that is reachable in it by verified pairs, one link for each fingerprint but the first of a group."""
    left = np.unique(fps)
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            x = reached.pop()
            apart = left ^ x
            shared = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = (shared >= LEAST_SHARED) & (np.bitwise_count(apart) <= BITS)
            if near.any():
                for y in (hit := left[near]):
                    yield int(x), int(y)
                reached += list(hit)
                left = left[~near]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (key, fp), sorted by key: links. A list may span batches; only the list at hand is held."""

    def made(fps: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(bounds)
        two = np.flatnonzero(sizes == 2)
        a, b = fps[bounds[two]], fps[bounds[two] + 1]
        apart = a ^ b
        near = ((apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= LEAST_SHARED) & (np.bitwise_count(apart) <= BITS) & (a != b) if len(two) else np.zeros(0, bool)
        more = [p for i in np.flatnonzero(sizes > 2) for p in linked(fps[bounds[i] : bounds[i + 1]])]
        x = np.concatenate([a[near], np.array([p[0] for p in more], dtype=np.uint64)])
        y = np.concatenate([b[near], np.array([p[1] for p in more], dtype=np.uint64)])
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    held_k, held = None, []
    for batch in batches:
        k = batch.column(0).to_numpy(zero_copy_only=False)
        fp = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(k):
            continue
        if held and k[0] != held_k:
            f = np.concatenate(held)
            yield made(f, np.array([0, len(f)]))
            held = []
        last = int(np.searchsorted(k, k[-1]))  # the last list may go on
        if last:
            head = np.concatenate([*held, fp[:last]])
            extra = len(head) - last
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(k[:last])) + 1 + extra, [len(head)]])
            yield made(head, bounds)
            held = []
        held_k = k[-1]
        held.append(fp[last:])
    if held:
        f = np.concatenate(held)
        yield made(f, np.array([0, len(f)]))


def near_links(fps: DataFrame) -> DataFrame:
    """fps: column fp, distinct. Links (a, b) that connect all that differ in up to three bits; a spanning set, not all pairs."""
    posts = fps.select("fp", F.explode(posting_keys(F.col("fp"))).alias("k"))
    long = posts.groupBy("k").count().where(F.col("count") > LONG_LIST).select("k", F.lit(True).alias("long"))
    marked = posts.join(long, "k", "left")
    keys = F.when(F.col("long"), longer_keys(F.col("fp"), F.shiftright("k", 24))).otherwise(F.array("k"))
    lists = marked.select(F.explode(keys).alias("k"), "fp").repartition("k").sortWithinPartitions("k", "fp")
    return mapped(lists, _links, "a long, b long")


def classes(found: DataFrame) -> DataFrame:
    """From (fp, id) rows: for each distinct fp its component as `root` (a fingerprint), `component_id` (its smallest id). Store it before a join with all rows: then that is a step in which Spark splits the copies of one text."""
    own = cut(found.groupBy("fp").agg(F.min("id").alias("id")))
    roots = components(near_links(own.select("fp")))
    rooted = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All rows and columns of `docs` as struct `row`, with `fp` (signed), `root` (which component) and `component_id`: the smallest key reachable over links of at most three differing bits, its own included.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows with equal text always
    share a component; repeated rows stay repeated. Null keys count for nothing in the minimum (null if
    all are). Work grows with distinct fingerprints, not with the square of a group of copies.
    """
    marked = with_text(docs, text, fingerprints, "fp long").select("row", "fp")
    groups = stored(classes(cut(marked.select("fp", F.col(f"row.`{key}`").alias("id")))))
    return marked.join(groups, "fp").select("row", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The row of smallest key of each component; of rows that share that key the one of smallest text hash, of rows with the same key and text any one.

    Fingerprints are worked out once; who stays is settled on keys and hashes, and texts are shuffled once, to meet that.
    """
    th = F.xxhash64(F.col(f"row.`{text}`").cast("string")).alias("th")
    narrow = stored(with_text(docs.select(key, text), text, fingerprints, "fp long").select(F.col(f"row.`{key}`").alias("id"), th, "fp"))
    met = narrow.groupBy("fp", "id", "th").agg(F.count(F.lit(1)).alias("n")).join(classes(narrow), "fp")
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "th", "n")).alias("x")
    winners = stored(met.groupBy("root").agg(first).select("x.id", "x.th", "x.n"))
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("id"), F.xxhash64(docs[text].cast("string")).alias("th"))
    own = d.alias("d").join(winners.alias("w"), F.expr("d.id <=> w.id and d.th = w.th")).select("d.*", "w.n")
    alone = own.where("n = 1").select("row.*")
    repeated = own.where("n > 1").groupBy("id", "th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return alone.unionByName(repeated)


def document_classes(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id), one row for each row of `docs`; see near_duplicates. Texts are read once and never shuffled."""
    marked = cut(with_text(docs.select(key, text), text, fingerprints, "fp long").select(F.col(f"row.`{key}`").alias("id"), "fp"))
    return marked.join(stored(classes(marked)), "fp").select(F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
