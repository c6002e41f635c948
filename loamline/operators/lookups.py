"""Point look-ups over a feature map, symbols and imports; each takes a table of probes, so many are answered in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import sized

# Parts of paths that tell of handlers, and of files that take no part in a flow.
HANDLER_HINTS = "api/ /route handler controllers/ services/ actions/ mutations/ queries/ endpoints/ routes/ server/ /app/".split()
NOISE_HINTS = "/__tests__/ .test. .spec. /tests/ /fixtures/ /i18n/ /locales/ /translation .d.ts /icons/ /assets/".split()


# Words of flows' names that say nothing of their files.
STOP_WORDS = "flow the a an of to from and or with by in on for as view page".split()


def resolved(features: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, feature): the first feature of the map whose display name, name, an alias or a label is the probe, case and outer blanks aside.

    features: (ord, feature, display, aliases, labels, description); probes: (probe). Probes that name nothing have no row.
    """
    keys = F.array_distinct(F.transform(F.concat(F.array("display", "feature"), "aliases", "labels"), lambda x: F.lower(x)))
    each = features.select("ord", "feature", F.explode(keys).alias("key"))
    met = probes.select("probe", F.lower(F.trim("probe")).alias("key")).distinct().join(each, "key")
    return met.groupBy("probe").agg(F.min_by("feature", "ord").alias("feature"))


def found(features: DataFrame, probes: list[str]) -> DataFrame:
    """(probe, feature): the first feature of the map in whose names, aliases, labels or description the probe stands. Probes are few and given by hand, so each feature row is read once and held against all."""
    hay = F.transform(F.array_compact(F.concat(F.array("display", "feature", "description"), "aliases", "labels")), lambda x: F.lower(x))
    hits = features.select("ord", "feature", hay.alias("hay"), F.explode(F.array(*map(F.lit, probes))).alias("probe"))
    return hits.where(F.exists("hay", lambda x: F.contains(x, F.lower("probe")))).groupBy("probe").agg(F.min_by("feature", "ord").alias("feature"))


def symbols_in_flow(flow_files: DataFrame, attributions: DataFrame, probes: DataFrame) -> DataFrame:
    """(flow, path, symbols, lines, precision): attributed symbols of each probed flow by file, or its plain files where the flow has none.

    flow_files: (flow, path); attributions: (flow, path, name, start, stop); probes: (flow). symbols are joined in order of their lines.
    """
    own = attributions.join(probes, "flow", "left_semi")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"]), "|")
    exact = own.groupBy("flow", "path").agg(names.alias("symbols"), F.sum(F.col("stop") - F.col("start") + 1).cast("long").alias("lines")).withColumn("precision", F.lit("symbol"))
    plain = flow_files.join(probes, "flow", "left_semi").join(own.select("flow").distinct(), "flow", "left_anti").select("flow", "path", F.lit(None).cast("string").alias("symbols"), F.lit(None).cast("long").alias("lines"), F.lit("file").alias("precision"))
    return exact.unionByName(plain)


def symbol(table: DataFrame, probes: DataFrame) -> DataFrame:
    """(path, name, start, stop) of the probed symbols (path, name)."""
    return table.join(probes.select("path", "name").distinct(), ["path", "name"]).select("path", "name", "start", "stop")


def listing(table: DataFrame) -> DataFrame:
    """(path, symbols): names and ranges of a file's symbols in order of their lines."""
    shown = F.transform(F.array_sort(F.collect_list(F.struct("start", "name", "stop"))), lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["stop"].cast("string")))
    return table.groupBy("path").agg(F.array_join(shown, "|").alias("symbols"))


def neighbours(edges: DataFrame, files: DataFrame, probes: DataFrame, *, consumers: bool = False) -> DataFrame:
    """(path, other, feature): what each probed file imports, or who imports it, and the feature of that. edges: (src, dst); files: (path, feature); probes: (path)."""
    a, b = ("dst", "src") if consumers else ("src", "dst")
    met = edges.select(F.col(a).alias("path"), F.col(b).alias("other")).join(probes.select("path").distinct(), "path", "left_semi")
    return met.join(files.select(F.col("path").alias("other"), "feature"), "other", "left").select("path", "other", "feature")


def _hits(path: Column, hints: list[str]) -> Column:
    low = F.lower(path)
    return sum((F.when(F.contains(low, F.lit(h)), 1).otherwise(0) for h in hints), F.lit(0))


def flow_candidates(flows: DataFrame, files: DataFrame, *, most: int = 15) -> DataFrame:
    """(flow, owner, path, place): the files of its owner that a flow most likely runs through.

    Score is three for each word of the flow's name in the path and one for each hint of a handler. Files with
    a score come first (score, words, path), then files of the best one's directory; a flow without scored
    files has the owner's by path. Noise is left out. flows: (flow, owner); files: (owner, path). A flow
    meets its owner's files only; place is at most `most`.
    """
    words = F.array_remove(F.array_remove(F.split(F.lower("flow"), r"[\s\-_/]+"), ""), "flow")
    own = files.where(_hits(F.col("path"), NOISE_HINTS) == 0)
    met = flows.select("flow", "owner", words.alias("words")).join(own, "owner")
    token = F.size(F.filter("words", lambda w: F.contains(F.lower("path"), w)))
    scored = met.select("flow", "owner", "path", token.alias("token"), (token * 3 + _hits(F.col("path"), HANDLER_HINTS)).alias("score"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    rank = [F.desc("score"), F.desc("token"), F.col("path")]
    best = scored.groupBy("flow", "owner").agg(F.max("score").alias("top"), F.min_by("dir", F.struct(-F.col("score"), -F.col("token"), "path")).alias("near"))
    kept = scored.join(best, ["flow", "owner"]).where((F.col("score") > 0) | (F.col("top") == 0) | ((F.col("near") != "") & F.startswith(F.col("path"), F.concat("near", F.lit("/")))))
    place = F.row_number().over(W.partitionBy("flow", "owner").orderBy(*rank))
    return kept.withColumn("place", place).where(F.col("place") <= most).select("flow", "owner", "path", "place")


def name_matches(flows: DataFrame, files: DataFrame, *, most: int = 8) -> DataFrame:
    """(flow, owner, path, score): files of the owner that share words with a flow's name: two for each word of the file's stem, one for each of its directories.

    flows: (flow, owner); files: (owner, path). They meet on shared words, not each with each.
    """
    tokens = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), r"[^a-z0-9]+"), ""))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    weighed = lambda c, k: F.transform(tokens(c), lambda w: F.struct(w.alias("w"), F.lit(k).alias("k")))
    own = files.select("owner", "path", F.explode(F.concat(weighed(stem, 2), weighed(parent, 1))).alias("x"))
    words = sized(flows.select("flow", "owner", F.explode(F.array_except(tokens(F.col("flow")), F.array(*map(F.lit, STOP_WORDS)))).alias("w")).distinct())
    score = words.join(own.select("owner", "path", "x.w", "x.k"), ["owner", "w"]).groupBy("flow", "owner", "path").agg(F.sum("k").alias("score"))
    place = F.row_number().over(W.partitionBy("flow", "owner").orderBy(F.desc("score"), "path"))
    return score.withColumn("i", place).where(F.col("i") <= most).drop("i")


def stem_matches(files: DataFrame, anchors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, stem, candidate): for each file stem the anchor of that name, else the longest anchor (three characters and more) that begins it, that it begins, or that is one of its parts; ties to the smaller ord.

    files: (keys, stem); anchors: (keys, ord, stem, candidate). Stems meet anchors of equal keys on equal beginnings and parts.
    """
    k = keys or []
    s = files.select(*k, "stem").distinct().where("stem <> ''")
    a = anchors.select(*k, "ord", F.col("stem").alias("anchor"), "candidate")
    long = a.where(F.length("anchor") >= 3)
    begins = lambda c: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(F.col(c), F.lit(1), i))
    exact = s.withColumn("anchor", F.col("stem")).join(a, [*k, "anchor"]).withColumn("exact", F.lit(True))
    under = s.select(*k, "stem", F.explode(F.array_union(begins("stem"), F.split("stem", "[_-]"))).alias("anchor")).join(long, [*k, "anchor"])
    over = long.select("*", F.explode(begins("anchor")).alias("stem")).join(s, [*k, "stem"])
    cols = [*k, "stem", "anchor", "ord", "candidate"]
    every = exact.select(*cols, "exact").unionByName(under.select(*cols).unionByName(over.select(*cols)).withColumn("exact", F.lit(False)))
    return every.groupBy(*k, "stem").agg(F.min_by("candidate", F.struct(~F.col("exact"), -F.length("anchor"), "ord")).alias("candidate"))
