"""Mixing sources to target weights by whole and chance copies of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import WORD, cut

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
#: Sources up to this number go to every executor; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Seeds that each source may draw with; it takes the one whose draw comes nearest its target.
SEEDS = 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds `place`, from 0 by code point, null last. Sources are dealt by range; only the number in each range reaches the driver."""
    dealt = cut(sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect()):
        offsets += [F.lit(part), F.lit(before)]
        before += n
    base = F.create_map(*offsets)[F.col("part")] if offsets else F.lit(0)
    own = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source"))
    return dealt.withColumn("place", base + own - 1).drop("part")


def targets(sources: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """From (source, source_size): adds `target`. Targets share `share` of all sizes by weight; those above `most` times their size stop there and the excess is shared anew by weight."""
    if share > most:
        raise ValueError("no sources can give that much")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = cut(ranked(sources).withColumn("weight", weight))
    cap = F.col("source_size") * float(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # the level only rises, and each round stops one more source at least
        over = F.lit(capped >= 0) & (F.col("weight") * F.lit(level) > cap)
        r = table.agg(F.count(F.when(over, 1)).alias("n"), F.sum(F.when(over, F.col("source_size"))).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        if r["n"] == capped or not r["free"]:
            break
        capped = r["n"]
        level = (share * total - most * (r["full"] or 0)) / r["free"]
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), cap)).drop("weight", "place")


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more if the draw in [0, 1) is below the fraction."""
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rates(sized: DataFrame) -> DataFrame:
    """From (id, source, size, h): for each source its source_size, target, rate and the seed that it draws with."""
    aimed = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    rated = aimed.withColumn("rate", F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0)))
    rows = _with_source(sized, cut(rated), ["source_size", "target", "rate"])
    sums = [F.sum(F.col("size") * copies(F.col("rate"), draw(F.lit(s)))).alias(f"s{s}") for s in range(SEEDS)]
    drawn = rows.groupBy("source", "source_size", "target", "rate").agg(*sums)
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - F.col("target")).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]))["seed"]
    return cut(drawn.select("source", "source_size", "target", "rate", nearest.alias("seed")))


def draw(seed: Column) -> Column:
    """In [0, 1), by a hash of the seed and a document's key and text."""
    return F.shiftrightunsigned(F.xxhash64(seed, "id", "h"), 11) / F.lit(float(1 << 53))


def _sized(docs: DataFrame, text: str, key: str, source: str) -> list[Column]:
    return [F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("h")]


def _with_source(rows: DataFrame, by_source: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with columns of their source. The table of sources is broadcast only if it has been counted to be small."""
    small = by_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    r = (F.broadcast(by_source) if small else by_source).alias("r")
    return rows.alias("d").join(r, F.expr("d.source <=> r.source")).select("d.*", *[f"r.{c}" for c in columns])


def _met(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    return _with_source(rows, by_source, ["source_size", "target", "rate", "seed"]).withColumn("copies", copies(F.col("rate"), draw(F.col("seed"))))


def mixed(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken), one row for each row of `docs`.

    size: words of the text (null: 0). taken: size times the copies that the mix holds: floor(rate) and a
    hash-seeded Bernoulli copy, rate = target / source_size of its source (a null source is one of its own).
    The draw hashes key and text, so reruns agree, and rows repeated in full are drawn alike. A source
    without words has rate 0. Sums are aggregated before the shuffle, so a source with most of the rows is
    no single task's; texts are read once and not shuffled.
    """
    sized = cut(docs.select(*_sized(docs, text, key, source)))
    return _met(sized, rates(sized)).select(F.col("id").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def emitted(docs: DataFrame, *, text: str = "text", key: str = "doc_id", source: str = "source", number: str = "copy") -> DataFrame:
    """The mix itself: every row of `docs` as often as it is taken, numbered from 0 in `number`; see mixed. A column of that name in `docs` is an error, so none is lost."""
    if number.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs have a column {number!r}; give the copies' number another name")
    by_source = rates(cut(docs.select(*_sized(docs, text, key, source))))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_sized(docs, text, key, source)).drop("size")
    times = F.when(F.col("copies") > 0, F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    out = _met(rows, by_source).select("row", F.explode(times).alias("n"))
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns], F.col("n").alias(number))
