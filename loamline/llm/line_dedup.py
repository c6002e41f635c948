"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared as words. Two lines are near if one edit (a word put in, left out or changed) turns
one into the other; each then becomes the same sequence by leaving out at most one word. All such
variants of a line are emitted as hashed keys and lines with equal keys meet; the edit distance of what
meets is verified on the words, and of lines that are equal or near the earliest stays.

Lines that can't have a near partner emit nothing: one edit leaves the first or the last half of both
lines alone, so a line whose halves are no other line's needs no variants. Sets of lines that meet are
never paired with each other: lines that lack the same word at the same place are all near, so each is
held against the earliest only, and a line that is itself a variant is held against those it comes from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, let, marked, marks, stored, words

#: By default shorter lines are compared exactly: one word of five is a similarity of 0.8.
LEAST_WORDS = 5


def _lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(ord, line) for every line; ord: document key, hash of its text, line number."""
    d = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    lines = d.select("id", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    return lines.select(F.struct("id", "th", "pos").alias("ord"), "line")


def _line_hash(ws: Column) -> tuple[Column, Column]:
    return F.xxhash64(ws), F.xxhash64(F.lit("line"), F.size(ws), ws)


def half_keys(ws: Column, least_words: int = LEAST_WORDS) -> Column:
    """Hashes of the first and the last half, as long as the shorter of two near lines has them: once as that line, once as one a word longer."""

    def of(n: Column) -> list[Column]:
        half = F.floor(n / 2).cast("int")
        return [F.xxhash64(F.lit("first"), n, F.slice(ws, 1, half)), F.xxhash64(F.lit("last"), n, F.slice(ws, F.size(ws) - half + 1, half))]

    n = F.size(ws)
    return F.when(n == least_words, F.array(*of(n))).when(n > least_words, F.array(*of(n), *of(n - 1)))


def variants(ws: Column) -> Column:
    """(key, at) of each sequence with word `at` left out, and of the whole line with at = -1. A key hashes the length and the set of neighbouring words, so that all variants of a line cost one pass."""
    n = F.size(ws)

    def pair(a: Column, b: Column) -> Column:
        return F.xxhash64(F.coalesce(F.get(ws, a), F.lit("")), F.coalesce(F.get(ws, b), F.lit("")))

    def keys(pairs: Column) -> Column:
        whole = F.aggregate(pairs, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))

        def without(total: Column) -> Column:
            left_out = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(n - 1, total.bitwiseXOR(F.get(pairs, i)).bitwiseXOR(F.get(pairs, i + 1)).bitwiseXOR(pair(i - 1, i + 1))).alias("key"), i.alias("at")))
            return F.concat(F.array(F.struct(F.xxhash64(n, total).alias("key"), F.lit(-1).alias("at"))), left_out)

        return let(whole, without)

    return let(F.transform(F.sequence(F.lit(0), n), lambda i: pair(i - 1, i)), keys)


def _rest(ws: Column, at: Column) -> Column:
    """The words without word `at` (-1: all of them)."""
    return F.when(at < 0, ws).otherwise(F.concat(F.slice(ws, F.lit(1), F.greatest(at, F.lit(0))), F.slice(ws, F.greatest(at, F.lit(0)) + 2, F.size(ws))))


def near_lines(lines: DataFrame, hashed: DataFrame) -> DataFrame:
    """(h1, h2) of distinct lines that have an earlier near line. hashed: (h1, h2, ord, halves)."""
    halves = hashed.where("halves is not null").select("h1", F.explode("halves").alias("half"))
    shared = stored(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("half"))
    each = hashed.where("halves is not null").select("h1", "h2", "ord", F.explode("halves").alias("half"))
    able = marked(each, "half", marks(shared.select(F.col("half").alias("h")))).join(shared, "half", "left_semi")
    able = stored(able.groupBy("h1", "h2").agg(F.min("ord").alias("ord")))
    own = marked(lines.withColumn("oh", F.xxhash64("ord")), "oh", marks(able.select(F.xxhash64("ord").alias("h"))))
    cand = stored(own.join(able, "ord").select("h1", "h2", "ord", words(F.col("line")).alias("ws")))
    # what lines share by the quick key is keyed again by all its words, so that no chance meeting hides a true one
    quick = cand.select("h1", "h2", F.inline(variants(F.col("ws"))).alias("key", "at"))
    common = quick.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    rest = _rest(F.col("ws"), F.col("at"))
    met_once = quick.join(common, "key", "left_semi").select("h1", "h2", "at")
    v = cut(met_once.join(cand, ["h1", "h2"]).select("ord", "at", F.xxhash64(rest).alias("e1"), F.xxhash64(F.lit("rest"), F.size(rest), rest).alias("e2")))
    hubs = v.groupBy("e1", "e2", "at").agg(F.min("ord").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1 or at = -1").select("e1", "e2", F.col("at").alias("hub_at"), "hub")
    met = v.join(hubs, ["e1", "e2"]).where("at >= 0 and (at = hub_at or hub_at = -1) and ord <> hub")
    later = F.col("ord") > F.col("hub")
    pairs = met.select(F.greatest("ord", "hub").alias("later"), F.least("ord", "hub").alias("sooner"), F.when(later, F.col("at")).otherwise(F.col("hub_at")).alias("later_at"), F.when(later, F.col("hub_at")).otherwise(F.col("at")).alias("sooner_at"))
    one = cut(pairs.groupBy("later").agg(F.min(F.struct("sooner", "later_at", "sooner_at")).alias("w")).select("later", "w.*"))
    a, b = cand.select(F.col("ord").alias("later"), "h1", "h2", F.col("ws").alias("a")), cand.select(F.col("ord").alias("sooner"), F.col("ws").alias("b"))
    near = _rest(F.col("a"), F.col("later_at")) == _rest(F.col("b"), F.col("sooner_at"))
    return one.join(a, "later").join(b, "sooner").where(near).select("h1", "h2").distinct()


def repeated_lines(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, th, gone): for each document with lines that go, their numbers."""
    lines = _lines(docs, text, key).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    ws = F.col("ws")
    h1, h2 = _line_hash(ws)
    # words are a column of their own, so that all hashes of them are compiled code and they are found once
    hashed = stored(lines.select("ord", words(F.col("line")).alias("ws")).select(h1.alias("h1"), h2.alias("h2"), half_keys(ws, least_words).alias("halves"), "ord"))
    near = stored(near_lines(lines, hashed))
    repeated = hashed.groupBy("h1", "h2").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2", "first")
    at_issue = stored(repeated.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "full"))
    suspects = marked(hashed.select("h1", "h2", "ord"), "h1", marks(at_issue.select(F.col("h1").alias("h"))))
    gone = suspects.join(at_issue, ["h1", "h2"]).where("near or ord <> first")
    return gone.groupBy("ord.id", "ord.th").agg(F.collect_set("ord.pos").alias("gone"))


def without_repeats(docs: DataFrame, *, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of `docs` as struct `row`, with `kept_text`, `n_lines` (with a word), `n_gone`.

    A line goes if an equal line, or for lines of `least_words` words and more a near one, stands earlier:
    in a document of smaller key (null keys first; equal keys by a hash of the text) or before it in its
    own. White space within a line counts as one space; lines without a word stay. A text that loses
    nothing stays as it is, null and empty texts too; rows repeated in full have the same lines and are
    treated alike. Lines meet by hashes; shuffled are only texts of lines whose half another line shares
    and of documents that lose lines. Minima are aggregated before the shuffle, so a line that a third of all
    documents share is no single task's.
    """
    gone = stored(repeated_lines(docs, text=text, key=key, least_words=least_words))
    d = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("id"), docs[text].cast("string").alias("t"))
    d = d.withColumn("th", F.xxhash64("t")).withColumn("dh", F.xxhash64("id", "th"))
    losers = marks(gone.select(F.xxhash64("id", "th").alias("h")))
    some, others = marked(d, "dh", losers).alias("d"), marked(d, "dh", losers, "left_anti")
    met = some.join(gone.alias("g"), F.expr("d.id <=> g.id and d.th = g.th"), "left").select("d.row", "d.t", "g.gone").unionByName(others.select("row", "t", F.lit(None).cast("array<int>").alias("gone")))
    left = let(F.split("t", "\n"), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("gone")), lambda i: F.get(ls, i)), "\n"))
    n_lines = F.size(F.filter(F.split(F.coalesce("t", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return met.select("row", F.when(F.col("gone").isNull(), F.col("t")).otherwise(left).alias("kept_text"), n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"))


def deduplicated(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_lines, n_gone, text), one row for each row of `docs`; see without_repeats."""
    return without_repeats(docs.select(key, text), text=text, key=key).select(F.col(f"row.`{key}`").alias(key), "n_lines", "n_gone", F.col("kept_text").alias("text"))
