"""The trie of conversations' first turns, built as a Patricia tree.

Turns are sorted within their conversation and each prefix gets a 128-bit name: the xor of hashes of
(depth, role, text), so that a long conversation's prefixes are named block by block. Equal prefixes meet;
the smallest conversation that has one owns it. What a conversation owns is one unbranched run, from where
it leaves the smaller ones to its end. Only the ends and the places where runs leave (and the root) become
points of the tree; each point has one compressed edge to the point above. Counts are summed over this
tree, by pointer jumping, in a number of rounds logarithmic in its height. Only then is each edge expanded:
its unary nodes have their point's counts, and sums that grow by the edge's suffix below them.

No step gathers a conversation, a node's members or a node's children in one task. SHA-256 of a node's
members is sequential by definition; they pass in order through one hash, a chunk of text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import mapped, stored

#: Depths that one window handles; a longer conversation is carried from block to block.
BLOCK = 1024
#: Conversations whose openings are shared, and turns at most.
SHARED, HEADS = 100, 6
#: Bytes of members' text that are hashed at once.
CHUNK = 1 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def positions(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, a1, a2, n) of every turn: its place in its conversation from 1 (null turns first; equal ones by hash), hashes of role and text, code points of the text. A conversation of most rows is dealt over many tasks."""
    said = [F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))]
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("c"), F.col(turn).alias("turn"), F.xxhash64(F.lit(1), *said).alias("a1"), F.xxhash64(F.lit(2), *said).alias("a2"), F.char_length(said[1]).cast("long").alias("n"))
    rows = stored(rows).withColumn("u", F.monotonically_increasing_id())
    dealt = stored(rows.repartitionByRange("c", F.col("turn").asc_nulls_first(), "a1", "a2", "u").withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("c", "part").agg(F.count("*").alias("k"))
    earlier = F.sum("k").over(W.partitionBy("c").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # only the first conversation of a part may have begun before it, so this has a row for each part at most
    begun = counts.withColumn("earlier", earlier).where("earlier > 0").select("c", "part", "earlier")
    own = F.row_number().over(W.partitionBy("c", "part").orderBy(F.col("turn").asc_nulls_first(), "a1", "a2"))
    placed = dealt.withColumn("own", own).join(F.broadcast(begun), ["c", "part"], "left")
    return stored(placed.select("c", (F.col("own") + F.coalesce("earlier", F.lit(0))).cast("long").alias("pos"), "a1", "a2", "n"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are rebuilt: the first h turns of conversation c - c % 100, then c's own after its first h, h = crc32(decimal c) % 6. Returns (c, depth, a1, a2, n) of all turns, and (c, length) of all conversations, turnless ones too."""
    totals = stored(turns.groupBy("c").agg(F.max("pos").alias("total")))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("int")
    asked = totals.withColumns({"h": h, "base": F.col("c") - F.col("c") % SHARED})
    given = totals.select(F.col("c").alias("base"), F.col("total").alias("there"))
    plan = asked.join(given, "base", "left").withColumn("k", F.least(F.col("h").cast("long"), F.coalesce("there", F.lit(0).cast("long"))))
    plan = stored(plan.select("c", "base", "h", "k", (F.col("k") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(plan, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("depth"), "a1", "a2", "n")
    heads = turns.where((F.col("pos") < HEADS) & (F.col("c") % SHARED == 0)).withColumnRenamed("c", "base")
    shared = heads.join(plan, "base").where("pos <= h").select("c", F.col("pos").alias("depth"), "a1", "a2", "n")
    return own.unionByName(shared), plan.select("c", "length")


def _block(depth: str = "depth") -> Column:
    return F.floor(F.col(depth) / BLOCK)


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(c, depth, p1, p2, q1, q2, n, s, ends): each prefix of each conversation with its name, that above it, code points of the last turn and of all turns, and whether the conversation ends there. The root, of depth 0, is named 0."""
    rows = turns.withColumns({"b1": F.xxhash64("a1", "depth"), "b2": F.xxhash64("a2", "depth"), "block": _block()}).drop("a1", "a2")
    rows = stored(rows.join(lengths, "c").withColumn("ends", F.col("depth") == F.col("length")))
    so_far = W.partitionBy("c", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    named = rows.withColumns({"p1": F.bit_xor("b1").over(so_far), "p2": F.bit_xor("b2").over(so_far), "s": F.sum("n").over(so_far)})
    long = rows.where(f"length >= {BLOCK}").groupBy("c", "block").agg(F.bit_xor("b1").alias("x1"), F.bit_xor("b2").alias("x2"), F.sum("n").alias("xs"))
    before = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carry = long.select("c", "block", F.bit_xor("x1").over(before).alias("x1"), F.bit_xor("x2").over(before).alias("x2"), F.sum("xs").over(before).alias("xs"))
    carried = named.where("block > 0").join(carry, ["c", "block"]).withColumns({"p1": F.col("p1").bitwiseXOR(F.col("x1")), "p2": F.col("p2").bitwiseXOR(F.col("x2")), "s": F.col("s") + F.col("xs")})
    columns = ["c", "depth", "p1", "p2", F.col("p1").bitwiseXOR(F.col("b1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("q2"), "n", "s", "ends"]
    zero = F.lit(0).cast("long")
    roots = lengths.select("c", zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"), zero.alias("n"), zero.alias("s"), (F.col("length") == 0).alias("ends"))
    return stored(named.where("block = 0").select(*columns).unionByName(carried.select(*columns)).unionByName(roots))


def owned(chains: DataFrame) -> DataFrame:
    """Each distinct prefix once, with the smallest conversation that has it (c) and the number of those that end there (m)."""
    facts = [F.min(x).alias(x) for x in ("c", "q1", "q2", "n", "s")]
    return stored(chains.groupBy("p1", "p2", "depth").agg(*facts, F.count_if("ends").alias("m")))


def on_edges(nodes: DataFrame) -> DataFrame:
    """Nodes with their compressed edge: `at`, the depth of the point at its lower end (of the same owner), and the point at its upper end as (uc, ud, us); `top` marks the first node of an owner's run, `point` a point."""
    runs = nodes.groupBy("c").agg(F.min(F.struct("depth", "q1", "q2")).alias("r")).select("c", F.col("r.depth").alias("first"), "r.q1", "r.q2")
    runs = stored(runs)
    left = runs.where("first > 0").select(F.col("q1").alias("p1"), F.col("q2").alias("p2")).distinct().withColumn("left", F.lit(True))
    flagged = stored(nodes.join(left, ["p1", "p2"], "left").withColumns({"left": F.coalesce("left", F.lit(False)), "block": _block()}).withColumn("point", F.expr("m > 0 or left or depth = 0")))
    here = F.when(F.col("point"), F.struct("depth", "s"))
    w = W.partitionBy("c", "block").orderBy("depth")
    filled = flagged.withColumns({"above": F.last(here, True).over(w.rowsBetween(W.unboundedPreceding, -1)), "below": F.first(here, True).over(w.rowsBetween(0, W.unboundedFollowing))})
    near = filled.where("block = 0 and below is not null")
    far = filled.where("block > 0 or below is null")
    met = flagged.groupBy("c", "block").agg(F.min(here).alias("lo"), F.max(here).alias("hi"))
    b = W.partitionBy("c").orderBy("block")
    carry = met.select("c", "block", F.last("hi", True).over(b.rowsBetween(W.unboundedPreceding, -1)).alias("hi"), F.first("lo", True).over(b.rowsBetween(1, W.unboundedFollowing)).alias("lo"))
    far = far.join(carry, ["c", "block"]).withColumns({"above": F.coalesce("above", "hi"), "below": F.coalesce("below", "lo")}).drop("hi", "lo")
    left_at = flagged.where("left").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("c").alias("lc"), F.col("depth").alias("ld"), F.col("s").alias("ls"))
    starts = runs.join(left_at, ["q1", "q2"], "left").select("c", "first", "lc", "ld", "ls")
    rows = near.unionByName(far).join(starts, "c")
    own = F.col("above").isNotNull()
    return stored(
        rows.select(
            "c", "depth", "n", "s", "m", "p1", "p2", "point", F.col("below.depth").alias("at"), (F.col("depth") == F.col("first")).alias("top"), "lc",
            F.when(own, F.col("c")).otherwise(F.col("lc")).alias("uc"), F.when(own, F.col("above.depth")).otherwise(F.col("ld")).alias("ud"), F.coalesce("above.s", "ls", F.lit(0)).alias("us"),
        )
    )


def summed(points: DataFrame) -> DataFrame:
    """(c, at, n_convs, leaves, children, saved) of each point: sums over the compressed tree below it, its own edge included in `saved`.

    A round adds to each point what those exactly 2^i points below it have gathered, and then looks up
    ancestors twice as far.
    """
    kids = points.where("uc is not null").groupBy(F.col("uc").alias("c"), F.col("ud").alias("depth")).agg(F.count("*").alias("children"))
    rows = points.join(kids, ["c", "depth"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    tree = stored(rows.select("c", "depth", "us", "children", F.col("uc"), F.col("ud"), F.col("m").alias("n_convs"), (F.col("children") == 0).cast("long").alias("leaves"), (F.col("m") * F.col("s")).alias("ms"), (F.col("s") - F.col("us")).alias("edge")))
    sums = ["n_convs", "leaves", "ms", "edge"]
    while not tree.where("uc is not null").isEmpty():
        more = tree.where("uc is not null").groupBy(F.col("uc").alias("c"), F.col("ud").alias("depth")).agg(*[F.sum(x).alias(f"more_{x}") for x in sums])
        above = tree.where("uc is not null").select(F.col("c").alias("uc"), F.col("depth").alias("ud"), F.col("uc").alias("ac"), F.col("ud").alias("ad"))
        joined = tree.join(more, ["c", "depth"], "left").join(above, ["uc", "ud"], "left")
        tree = stored(joined.select("c", "depth", "us", "children", F.col("ac").alias("uc"), F.col("ad").alias("ud"), *[(F.col(x) + F.coalesce(f"more_{x}", F.lit(0))).alias(x) for x in sums]))
    saved = F.col("ms") - F.col("us") * F.col("n_convs") - F.col("edge")
    return tree.select("c", F.col("depth").alias("at"), "n_convs", "leaves", "children", saved.alias("saved"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (p1, p2, c): the hash of each group that lies within this task, and the text of those that may go on in others, in chunks."""
    part, out, key, text, seq, partial = TaskContext.get().partitionId(), [], None, [], 0, True

    def row(sha: str | None, chunk: bytes | None) -> dict:
        return {"p1": key[0], "p2": key[1], "part": part, "seq": seq, "sha": sha, "chunk": chunk}

    size = 0
    for b in batches:
        for p1, p2, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (p1, p2) != key:
                if key is not None:
                    whole = ",".join(text).encode()
                    out.append(row(None, whole) if partial else row(hashlib.sha256(whole).hexdigest(), None))
                partial, key, text, size, seq = key is None, (p1, p2), [], 0, 0
            text.append(str(c))
            size += len(text[-1]) + 1
            if size >= CHUNK:
                out.append(row(None, ",".join(text).encode()))
                partial, text, size, seq = True, [], 0, seq + 1
        if len(out) >= 4096 or sum(len(r["chunk"] or b"") for r in out) >= CHUNK:
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)
            out = []
    if key is not None and text:
        out.append(row(None, ",".join(text).encode()))
    yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each group from its chunks, in order."""
    key, sha, out = None, None, []
    for b in batches:
        for p1, p2, chunk in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (p1, p2) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (p1, p2), hashlib.sha256(chunk)
            else:
                sha.update(b"," + chunk)
    if key is not None:
        out.append((*key, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["p1", "p2", "sha"])


_CHUNK = pa.schema([("p1", pa.int64()), ("p2", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), ("sha", pa.string()), ("chunk", pa.binary())])


def end_hashes(chains: DataFrame) -> DataFrame:
    """(p1, p2, sha): SHA-256 of the conversations that end at each node, ascending, as decimals between commas."""
    ends = chains.where("ends").select("p1", "p2", "c")
    cut = stored(mapped(ends.repartitionByRange("p1", "p2", "c").sortWithinPartitions("p1", "p2", "c"), _chunks, "p1 long, p2 long, part int, seq int, sha string, chunk binary"))
    pieces = cut.where("sha is null").repartition("p1", "p2").sortWithinPartitions("p1", "p2", "part", "seq").select("p1", "p2", "chunk")
    return cut.where("sha is not null").select("p1", "p2", "sha").unionByName(mapped(pieces, _joined, "p1 long, p2 long, sha string"))


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The trie of conversations given as (c, depth, a1, a2, n) and (c, length); see prefix_trie for its columns."""
    chains = prefixes(turns, lengths)
    nodes = on_edges(owned(chains))
    below = summed(nodes.where("point")).alias("b")
    n = nodes.alias("n").join(below, F.expr("n.c = b.c and n.at = b.at")).select("n.*", "b.n_convs", "b.leaves", "b.children", "b.saved")
    hashed = n.join(end_hashes(chains), ["p1", "p2"], "left")
    suffix = F.col("saved") - (F.col("n_convs") - 1) * (F.col("s") - F.col("n") - F.col("us"))
    return hashed.select(
        F.col("c").alias("conv_id"), "depth", F.when(F.col("top"), F.col("lc")).otherwise(F.col("c")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") == F.col("at"), F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        suffix.alias("saved_tokens"), F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row for each node of the trie of the rebuilt conversations.

    Null role and text are empty. Rows without a conversation belong to none and are left out. Equal turns
    of one conversation go by a hash of role and text, and rows repeated in full are turns of their own.
    A conversation that is rebuilt without turns ends at the root. An empty table has no node, not even a
    root. Other columns are ignored.
    """
    return trie(*rebuilt(positions(conversations, key=key, turn=turn, role=role, text=text)))
