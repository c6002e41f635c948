"""Rewrites of feature and flow tables by rules and by decisions made elsewhere."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions import paths as P
from .graph import cut

# Names that no alias rule may take, and owners whose paths stay with them.
PROTECTED = ("shared-infra", "documentation", "examples", "developer-infrastructure")


def renamed(rows: DataFrame, names: DataFrame, key: str = "feature") -> DataFrame:
    """rows with `key` replaced where `names` (old, new; new null drops the row) says so; the last of several by new name counts."""
    one = names.groupBy(F.col("old").alias(key)).agg(F.max("new").alias("new"), F.lit(True).alias("named"))
    met = rows.join(one, key, "left").where("named is null or new is not null")
    return met.withColumn(key, F.coalesce("new", key)).drop("new", "named")


def verdicts_applied(flows: DataFrame, verdicts: DataFrame, features: DataFrame, least_confidence: int = 4) -> DataFrame:
    """(flow, owner, moved): flows with a `move` verdict of enough confidence go to its destination, if that is a feature and the flow is still at the owner that was judged."""
    known = features.select(F.col("feature").alias("destination")).distinct()
    sure = verdicts.where((F.col("decision") == "move") & (F.col("confidence") >= least_confidence)).join(known, "destination", "left_semi")
    to = sure.groupBy("flow", F.col("current_owner").alias("owner")).agg(F.max_by("destination", F.struct("confidence", "destination")).alias("to"))
    met = flows.select("flow", "owner").join(to, ["flow", "owner"], "left")
    return met.select("flow", F.coalesce("to", "owner").alias("owner"), F.col("to").isNotNull().alias("moved"))


def secondaries(verdicts: DataFrame, features: DataFrame) -> DataFrame:
    """(flow, features): other features that verdicts of any kind name, if they exist."""
    named = verdicts.select("flow", F.explode("also_belongs_to").alias("feature")).join(features.select("feature").distinct(), "feature", "left_semi")
    return named.groupBy("flow").agg(F.array_join(F.array_sort(F.collect_set("feature")), "|").alias("features"))


def promoted_domains(flows: DataFrame, features: DataFrame, least: int = 3, most_paths: int = 15) -> DataFrame:
    """(domain, target, backfill, kind, owner, item): flows and paths that a feature of their domain takes from their owners.

    A domain of at least `least` flows gets a feature of its name. If a feature covers it already (the first
    by name), that one takes them instead, but only while it has under `most_paths` paths and `least` of the
    flows are elsewhere. Paths come from the owners of the domain's flows, not from protected ones; a domain
    without any such path is left alone. flows: (owner, flow); features: (feature, path).
    """
    own = flows.select("owner", "flow").distinct().withColumn("domain", N.flow_domain(F.col("flow"))).where("domain is not null")
    held = features.select("feature", "path").distinct()
    covering = held.groupBy("feature").agg(F.count("path").alias("paths")).select("feature", "paths", F.explode(N.covered_domains(F.col("feature"))).alias("domain"))
    existing = covering.groupBy("domain").agg(F.min(F.struct("feature", "paths")).alias("e")).select("domain", F.col("e.feature").alias("existing"), "e.paths")
    met = own.join(F.broadcast(existing), "domain", "left")  # one row for each domain
    many = met.groupBy("domain", "existing", "paths").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("existing").isNull() | (F.col("owner") != F.col("existing"))).alias("stranded"))
    due = many.where((F.col("n") >= least) & (F.col("existing").isNull() | ((F.col("paths") < most_paths) & (F.col("stranded") >= least))))
    plan = due.select("domain", F.coalesce("existing", "domain").alias("target"), F.col("existing").isNotNull().alias("backfill"))
    planned = own.join(F.broadcast(plan), "domain").where("not backfill or owner <> target")
    from_ = planned.select("domain", "target", "backfill", "owner").distinct().where(~F.col("owner").isin(*PROTECTED))
    inside = functools.reduce(Column.__or__, [(F.col("domain") == d) & N.in_domain(F.col("path"), d) for d in N.DOMAINS])
    paths = cut(from_.join(held.withColumnRenamed("feature", "owner"), "owner").where(inside).select("domain", "target", "backfill", F.lit("path").alias("kind"), "owner", F.col("path").alias("item")))
    moved = planned.join(F.broadcast(paths.select("domain").distinct()), "domain", "left_semi")
    return paths.unionByName(moved.select("domain", "target", "backfill", F.lit("flow").alias("kind"), "owner", F.col("flow").alias("item")))


def majority(votes: DataFrame, key: str, value: str, share: float = 0.6) -> DataFrame:
    """(key, value, votes, total): the most frequent value of each key if it has at least `share` of the votes; ties go to the first by name."""
    n = votes.groupBy(key, value).agg(F.count(F.lit(1)).alias("votes"))
    best = n.groupBy(key).agg(F.sum("votes").alias("total"), F.min_by(F.struct(value, "votes"), F.struct(-F.col("votes"), value)).alias("b"))
    return best.select(key, f"b.{value}", "b.votes", "total").where(F.col("votes") >= F.col("total") * share)


def capped_flows(flows: DataFrame, most: int = 12) -> DataFrame:
    """(owner, flow, kept_as): the `most` largest flows of an owner stay (equal ones by name). Others join the kept flow that has most of their files in its directories, the larger on ties; a directory belongs to the largest kept flow that has a file there. Those without a directory in common join the largest.

    flows: (owner, flow, path). Directories meet as keys, so no flow is held against all others.
    """
    files = flows.select("owner", "flow", P.parent(F.col("path")).alias("dir"), "path").distinct()
    size = files.groupBy("owner", "flow").agg(F.count(F.lit(1)).alias("size"))
    place = size.withColumn("place", F.row_number().over(W.partitionBy("owner").orderBy(F.desc("size"), "flow"))).select("owner", "flow", "place")
    placed = cut(files.join(place, ["owner", "flow"]))
    of_dir = placed.where(F.col("place") <= most).groupBy("owner", "dir").agg(F.min("place").alias("to"))
    scores = placed.where(F.col("place") > most).join(of_dir, ["owner", "dir"]).groupBy("owner", "flow", "to").agg(F.count(F.lit(1)).alias("n"))
    best = scores.groupBy("owner", "flow").agg(F.min_by("to", F.struct(-F.col("n"), "to")).alias("to"))
    to = F.when(F.col("place") <= most, F.col("place")).otherwise(F.coalesce("to", F.lit(1)))
    aim = place.join(best, ["owner", "flow"], "left").select("owner", "flow", to.alias("place"))
    return aim.join(place.withColumnRenamed("flow", "kept_as"), ["owner", "place"]).select("owner", "flow", "kept_as")


def exact_cover(parts: DataFrame, whole: DataFrame, most: int = 8) -> DataFrame:
    """(feature, valid): whether its proposed parts (feature, part, path) are 2 to `most`, without overlap or leftovers, over whole (feature, path)."""
    p = parts.groupBy("feature").agg(F.countDistinct("part").alias("n"), F.count(F.lit(1)).alias("rows"), F.countDistinct("path").alias("paths"))
    met = whole.select("feature", "path").distinct().join(parts.select("feature", "path", F.lit(1).alias("in_part")).distinct(), ["feature", "path"], "full").join(whole.select("feature", "path", F.lit(1).alias("in_whole")).distinct(), ["feature", "path"], "left")
    off = met.groupBy("feature").agg(F.count_if(F.col("in_part").isNull() | F.col("in_whole").isNull()).alias("off"))
    valid = (F.col("n") >= 2) & (F.col("n") <= most) & (F.col("rows") == F.col("paths")) & (F.col("off") == 0)
    return p.join(off, "feature").select("feature", valid.alias("valid"))


def domain_clusters(files: DataFrame, least_files: int = 2, least_dirs: int = 2) -> DataFrame:
    """(keyword, files, dirs): words of file names that spread over directories. files: (path, dir, word)."""
    n = files.groupBy("word").agg(F.countDistinct("path").alias("files"), F.countDistinct("dir").alias("dirs"))
    return n.where((F.col("files") >= least_files) & (F.col("dirs") >= least_dirs)).withColumnRenamed("word", "keyword")


def name_reattribution(flows: DataFrame, features: DataFrame, protected: tuple[str, ...] = ("shared-infra", "documentation")) -> DataFrame:
    """(flow, owner, moved): a flow goes to the feature whose name matches it best if that scores 2 and beats its owner, or 1 where the owner scores 0.

    flows: (flow, owner). Features meet flows on shared words or word beginnings, not each with each.
    """
    fw = features.select("feature").distinct().where(~F.col("feature").isin(*protected)).select("feature", F.explode(N.name_tokens(F.col("feature"))).alias("w")).select("feature", F.left("w", F.lit(4)).alias("k"))
    lw = flows.select("flow", "owner", F.explode(N.name_tokens(F.col("flow"))).alias("w")).where(F.length("w") >= 4)
    keys = lw.select("flow", "owner", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 3), lambda i: F.substr(F.col("w"), i, F.lit(4)))).alias("k")).distinct()
    both = keys.join(fw.distinct(), "k").select("flow", "owner", "feature").distinct().where("feature <> owner")
    best = both.withColumn("score", N.name_match(F.col("feature"), F.col("flow"))).groupBy("flow", "owner").agg(F.min_by(F.struct("feature", "score"), F.struct(-F.col("score"), "feature")).alias("b"))
    own = N.name_match(F.col("owner"), F.col("flow"))
    met = flows.select("flow", "owner").join(best, ["flow", "owner"], "left")
    move = F.coalesce(((F.col("b.score") >= 2) & (F.col("b.score") > own)) | ((F.col("b.score") >= 1) & (own == 0)), F.lit(False))
    return met.select("flow", F.when(move, F.col("b.feature")).otherwise(F.col("owner")).alias("owner"), move.alias("moved"))


def deduplicated_flows(flows: DataFrame) -> DataFrame:
    """(flow, owner): each flow at one owner: that with most of its files, then most files in all, then the first by name. flows: (flow, owner, own_files, all_files)."""
    w = W.partitionBy("flow").orderBy(F.desc("own_files"), F.desc("all_files"), "owner")
    return flows.withColumn("i", F.row_number().over(w)).where("i = 1").select("flow", "owner")


def top_dir_extraction(files: DataFrame, *, least_files: int = 10, least_group: int = 3) -> DataFrame:
    """(feature, dir, files): groups under a second directory that are large enough to stand alone, in features with at least two such directories. files: (feature, path)."""
    top = F.element_at(F.split("path", "/"), 3)
    groups = files.where(F.size(F.split("path", "/")) > 3).groupBy("feature", top.alias("dir")).agg(F.count(F.lit(1)).alias("files"))
    size = files.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    per = groups.groupBy("feature").agg(F.count(F.lit(1)).alias("dirs"))
    return groups.join(size, "feature").join(per, "feature").where((F.col("n") >= least_files) & (F.col("dirs") >= 2) & (F.col("files") >= least_group)).select("feature", "dir", "files")


def foreign_files(files: DataFrame, *, owner_share: float = 0.6, own_share: float = 0.1, least: int = 4) -> DataFrame:
    """(feature, path, owner): files in a directory that another feature owns (at least `owner_share` of it) and that is less than `own_share` of their feature. files: (feature, path, dir)."""
    n = files.groupBy("dir", "feature").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("dir").agg(F.sum("n").alias("total"), F.max_by("feature", F.struct("n", "feature")).alias("owner"), F.max("n").alias("most"))
    owned = total.where(F.col("most") >= F.col("total") * owner_share).select("dir", "owner")
    size = files.groupBy("feature").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    met = files.join(owned, "dir").where("feature <> owner").join(n, ["dir", "feature"]).join(size, "feature")
    return met.where(F.col("n") < F.col("size") * own_share).select("feature", "path", "owner")


def crud_flows(files: DataFrame, assigned: DataFrame) -> DataFrame:
    """(feature, flow, path): flows for delete, create and update that file names tell of, for files that no flow has. files: (feature, path, name)."""
    free = files.join(assigned.select("path").distinct(), "path", "left_anti")
    verb = F.when(F.col("name").rlike("(?:^|[_-])(?:delete|remove)(?:[_-]|$)"), "delete").when(F.col("name").rlike("(?:^|[_-])(?:create|new|add)(?:[_-]|$)"), "create").when(F.col("name").rlike("(?:^|[_-])(?:update|edit)(?:[_-]|$)"), "update")
    return free.withColumn("verb", verb).where("verb is not null").select("feature", F.concat("verb", F.lit("-"), "feature", F.lit("-flow")).alias("flow"), "path")


def first_claims(claims: DataFrame, files: DataFrame) -> DataFrame:
    """(path, flow, how): each file at the first flow (by place, then name) that claims it; a file that none claims joins the flow with most claimed files in its directory. claims: (flow, place, path); files: (path, dir)."""
    won = claims.join(files.select("path"), "path", "left_semi").groupBy("path").agg(F.min_by("flow", F.struct("place", "flow")).alias("flow"))
    n = won.join(files, "path").groupBy("dir", "flow").agg(F.count(F.lit(1)).alias("n"))
    local = n.groupBy("dir").agg(F.min_by("flow", F.struct(-F.col("n"), "flow")).alias("near"))
    met = files.join(won, "path", "left").join(local, "dir", "left")
    how = F.when(F.col("flow").isNotNull(), "claimed").when(F.col("near").isNotNull(), "directory")
    return met.select("path", F.coalesce("flow", "near").alias("flow"), how.alias("how"))


def split_by(files: DataFrame, catch_all: list[str], least: int = 2) -> DataFrame:
    """(feature, path): files of catch-all features go to `feature/kind` where at least `least` share the kind. files: (feature, path, kind)."""
    n = files.where(F.col("feature").isin(*catch_all)).groupBy("feature", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    met = files.join(n, ["feature", "kind"], "left")
    return met.select(F.when(F.col("n").isNotNull(), F.concat("feature", F.lit("/"), "kind")).otherwise(F.col("feature")).alias("feature"), "path")


def redistributed(files: DataFrame, edges: DataFrame, shared: list[str]) -> DataFrame:
    """(feature, path): files of shared features go to the feature that imports them most (ties to the first by name); files that no other feature imports stay."""
    src = files.select(F.col("path").alias("src"), F.col("feature").alias("consumer"))
    use = edges.join(src, "src").where(~F.col("consumer").isin(*shared)).groupBy(F.col("dst").alias("path"), "consumer").agg(F.count(F.lit(1)).alias("n"))
    to = use.groupBy("path").agg(F.min_by("consumer", F.struct(-F.col("n"), "consumer")).alias("to"))
    met = files.join(to, "path", "left")
    return met.select(F.when(F.col("feature").isin(*shared), F.coalesce("to", "feature")).otherwise(F.col("feature")).alias("feature"), "path")


def named_clusters(clusters: DataFrame) -> DataFrame:
    """(root, name): each cluster named for its most frequent segment, with -2, -3 and so on for further clusters of a name. clusters: (root, segment)."""
    n = clusters.groupBy("root", "segment").agg(F.count(F.lit(1)).alias("n"))
    modal = n.groupBy("root").agg(F.min_by("segment", F.struct(-F.col("n"), "segment")).alias("segment"))
    i = F.row_number().over(W.partitionBy("segment").orderBy("root"))
    return modal.withColumn("i", i).select("root", F.when(F.col("i") == 1, F.col("segment")).otherwise(F.concat("segment", F.lit("-"), F.col("i").cast("string"))).alias("name"))


def inherited(children: DataFrame, parents: DataFrame, values: list[str], least: int = 2) -> DataFrame:
    """children (parent, child, files, values) with the parent's values where a child has fewer than `least` files."""
    p = parents.select(F.col("parent"), *[F.col(v).alias(f"p_{v}") for v in values])
    met = children.join(p, "parent", "left")
    return met.select("parent", "child", "files", *[F.when(F.col("files") >= least, F.col(v)).otherwise(F.col(f"p_{v}")).alias(v) for v in values])


def disjoint_pairs(sets: DataFrame) -> DataFrame:
    """(group, f1, f2): pairs of a group's sets without a common item. sets: (group, name, item). Sets are paired within their group by name only; overlaps are found on equal items."""
    names = sets.select("group", "name").distinct()
    pairs = names.select("group", F.col("name").alias("f1")).join(names.select("group", F.col("name").alias("f2")), "group").where("f1 < f2")
    items = sets.distinct()
    both = items.select("group", "item", F.col("name").alias("f1")).join(items.select("group", "item", F.col("name").alias("f2")), ["group", "item"]).where("f1 < f2").select("group", "f1", "f2").distinct()
    return pairs.join(both, ["group", "f1", "f2"], "left_anti")


def disjoint_names(sets: DataFrame) -> DataFrame:
    """(part, renamed): parts that have one name but no common path get it with the first directory in which the parts' paths differ; others keep it. sets: (name, part, path)."""
    own = sets.distinct()
    shared = own.groupBy("name", "path").agg(F.countDistinct("part").alias("parts")).where("parts > 1").select("name").distinct().withColumn("shared", F.lit(True))
    split = F.split("path", "/")
    ends = own.groupBy("name").agg(F.min(split).alias("low"), F.max(split).alias("high"), F.countDistinct("part").alias("parts"))
    at = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b)), False) - 1
    first = own.groupBy("name", "part").agg(F.min(split).alias("first"))
    met = first.join(ends.select("name", at.cast("int").alias("at"), "parts"), "name").join(shared, "name", "left")
    told = F.col("shared").isNull() & (F.col("parts") > 1) & (F.col("at") >= 0)
    return met.select("part", F.when(told, F.concat_ws("-", "name", F.get("first", F.col("at")))).otherwise(F.col("name")).alias("renamed"))


def split_symbols(symbols: DataFrame) -> DataFrame:
    """(path, flow_symbols, feature_symbols, roles, lines): names that may be part of a flow, those of types, roles and line ranges, in order of lines. symbols: (path, name, kind, start, stop, has_routes)."""
    role = N.symbol_role(F.col("name"), F.col("kind"), F.col("path"), F.col("has_routes"))
    rows = F.array_sort(F.collect_list(F.struct("start", "name", "kind", "stop", role.alias("role"))))
    named = lambda keep: F.array_join(F.transform(F.filter("rows", keep), lambda x: x["name"]), "|")
    is_type = lambda x: x["kind"].isin(*N.TYPE_KINDS)
    shown = lambda v: F.array_join(F.transform("rows", lambda x: F.concat(x["name"], F.lit("="), v(x))), "|")
    return symbols.groupBy("path").agg(rows.alias("rows")).select("path", named(lambda x: ~is_type(x)).alias("flow_symbols"), named(is_type).alias("feature_symbols"), shown(lambda x: x["role"]).alias("roles"), shown(lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))).alias("lines"))


# Features of no domain, places of third parties, names too vague for a very large feature.
NOISE_NAMES = ("shared-infra", "Shared Infra", "uncategorized")
VENDORED = ("external-crates/", "vendor/", "third_party/", "node_modules/")
VAGUE_NAMES = "catalog common generic system root init main base misc stuff platform backend frontend api lib".split()


def is_noise(name: Column) -> Column:
    return name.isin(*NOISE_NAMES) | name.endswith("/uncategorized")


def merged_sub_features(files: DataFrame, *, least: int = 3, most: int = 500) -> DataFrame:
    """(feature, path): `a/x`, `a/y`, `a/z` become `a` where at least `least` share the prefix, hold fewer than `most` files in all and no feature is called `a` yet; `a-x` becomes `a` where that is a feature. files: (feature, path)."""
    names = files.select("feature").distinct()
    prefix = F.substring_index("feature", "/", 1)
    groups = files.where(F.col("feature").contains("/")).groupBy(prefix.alias("prefix")).agg(F.countDistinct("feature").alias("fs"), F.count(F.lit(1)).alias("ps")).where((F.col("fs") >= least) & (F.col("ps") < most))
    joined = groups.join(names, F.col("prefix") == F.col("feature"), "left_anti").select("prefix", F.lit(True).alias("merge"))
    met = files.withColumn("prefix", prefix).join(joined, "prefix", "left")
    once = met.select(F.when(F.col("merge") & F.col("feature").contains("/"), F.col("prefix")).otherwise(F.col("feature")).alias("feature"), "path")
    known = names.select(F.col("feature").alias("head"), F.lit(True).alias("known"))
    head = F.when(F.col("feature").contains("-") & ~F.col("feature").contains("/"), F.substring_index("feature", "-", 1))
    return once.withColumn("head", head).join(known, "head", "left").select(F.when(F.col("known"), F.col("head")).otherwise(F.col("feature")).alias("feature"), "path").distinct()


def reattributed_noise(files: DataFrame, *, votes: int = 3) -> DataFrame:
    """(feature, path): files of noise features go to the feature with most files under their first two path parts, if it has at least `votes` there (ties to the first by name); others are gone. files: (feature, path)."""
    pre = F.array_join(F.slice(F.split("path", "/"), 1, 2), "/")
    own = files.withColumn("pre", pre).withColumn("noise", is_noise(F.col("feature")))
    n = own.where("not noise").groupBy("pre", "feature").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("pre").agg(F.min_by("feature", F.struct(-F.col("n"), "feature")).alias("to"), F.max("n").alias("n")).where(F.col("n") >= votes)
    moved = own.where("noise").join(best, "pre").select(F.col("to").alias("feature"), "path")
    return own.where("not noise").select("feature", "path").unionByName(moved)


def cleaned_map(files: DataFrame, commits: DataFrame) -> DataFrame:
    """(feature, path) after the chain: sub-features merged, noise given back, foreign files removed; then noise features, those of third parties only, those of at most two files and one commit, and vague ones with over a quarter of all and over 100 files are dropped, and repeated name parts made one.

    files: (feature, path); commits: (feature, total_commits), none where a feature is missing.
    """
    own = cut(reattributed_noise(cut(merged_sub_features(files))).withColumn("dir", F.substring_index("path", "/", 1)))
    own = cut(own.join(foreign_files(own).select("feature", "path"), ["feature", "path"], "left_anti"))
    third = F.lit(False)
    for v in VENDORED:
        third = third | F.col("path").startswith(v) | F.col("path").contains("/" + v)
    n = own.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.bool_and(third).alias("third")).join(commits, "feature", "left").na.fill(0, ["total_commits"])
    total = own.agg(F.count(F.lit(1)).alias("total"))  # one row
    vague = F.col("feature").isin(*VAGUE_NAMES) & (F.col("n") > 0.25 * F.col("total")) & (F.col("n") > 100)
    dropped = is_noise(F.col("feature")) | F.col("third") | ((F.col("n") <= 2) & (F.col("total_commits") <= 1)) | vague
    kept = n.join(F.broadcast(total), how="cross").where(~dropped).select("feature")
    parts = F.split("feature", "/")
    single = F.array_join(F.filter(parts, lambda x, i: (i == 0) | (x != F.get(parts, i - 1))), "/")
    return own.join(kept, "feature", "left_semi").select(single.alias("feature"), "path")
