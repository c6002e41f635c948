"""Merges of clusters into features judged and undone: tiny clusters, technical features, incoherent merges, features to split anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .graph import cut

# Names and words of technical features and directories, and directories that say nothing of business.
TECHNICAL_DIRS = (
    "utils", "util", "helpers", "helper", "lib", "libs", "common", "shared", "core", "base", "config", "configs", "constants", "types", "interfaces", "hooks", "hoc", "providers", "context", "contexts", "middleware",
    "middlewares", "decorators", "guards", "interceptors", "pipes", "styles", "assets", "icons", "images", "fonts", "theme", "themes", "__tests__", "__mocks__", "test", "tests", "spec", "specs", "fixtures", "storybook", "stories",
)
TECHNICAL_WORDS = (
    "utils", "util", "utilities", "helpers", "helper", "hooks", "hoc", "shared", "common", "general", "misc", "core", "base", "lib", "icons", "assets", "images", "fonts", "theme", "themes", "locale", "stories", "storybook", "mocks", "fixtures",
    "test", "tests", "styles", "css", "scss", "components", "ui", "workers", "worker", "stores", "store", "dropdowns", "dropdown", "loaders", "loader", "constants", "config", "configs", "providers", "context", "contexts", "types", "models", "schemas",
    "middleware", "empty", "states", "state", "list", "readonly", "fields", "web", "manifest", "preferences", "appearance", "sidebar",
)
TECHNICAL_NAMES = (
    "ui-library", "ui-components", "shared-components", "custom-hooks", "hooks-utils", "general-utils", "data-schemas", "state-management", "api-services", "export-utilities", "app-shell", "routing", "icons-assets", "locale-theme", "custom-components",
    "custom-utils", "dashboard-utils", "chart-components", "input-component", "table-cells", "common-store", "template-components", "data-prefetch", "filter-processor", "entity-processors", "list-components", "rich-filters", "readonly-fields", "sidebar-stats",
    "web-manifest", "empty-states",
)
PLAIN_DIRS = ("src", "app", "lib", "components", "hooks", "utils", "types", "shared", "common", "pages", "views", "features", "modules")


def _top(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def best_targets(orphans: DataFrame, features: DataFrame) -> DataFrame:
    """(name, target): the feature that shares most directories with each orphan, else the largest that shares a top directory; ties go by name, orphans that share nothing have no row.

    Both are judged as they are before anything moves. Directories meet as keys. orphans: (name, path); features: (feature, path).
    """
    dirs = lambda df, who, at: df.select(who, at.alias("dir")).distinct()
    shared = dirs(orphans, "name", P.parent(F.col("path"))).join(dirs(features, "feature", P.parent(F.col("path"))), "dir").groupBy("name", "feature").agg(F.count(F.lit(1)).alias("n"))
    near = cut(shared.groupBy("name").agg(F.min_by("feature", F.struct(-F.col("n"), "feature")).alias("target")))
    size = features.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    largest = dirs(features, "feature", _top(F.col("path"))).join(size, "feature").groupBy("dir").agg(F.min(F.struct(-F.col("n"), "feature")).alias("b"))
    rest = dirs(orphans, "name", _top(F.col("path"))).join(near, "name", "left_anti").join(largest, "dir").groupBy("name").agg(F.min("b").alias("b"))
    return near.unionByName(rest.select("name", F.col("b")["feature"].alias("target")))


def _absorbed(rows: DataFrame, orphans: DataFrame, features: DataFrame) -> DataFrame:
    to = best_targets(orphans, features).select(F.col("name").alias("feature"), "target")
    return rows.join(to, "feature", "left").select(F.coalesce("target", "feature").alias("feature"), "path")


def pre_merged(clusters: DataFrame, *, gate: int = 150, most: int = 3) -> DataFrame:
    """(feature, path): where there are over `gate` clusters, those of at most `most` files join the larger one that is nearest, but for those in one top directory that is no technical one."""
    rows = cut(clusters.select("feature", "path").distinct())
    folder = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 1))
    plain = F.regexp_replace(F.lower(F.min(folder)), "s+$", "").isin(*sorted({d.rstrip("s") for d in TECHNICAL_DIRS}))
    size = cut(rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), ((F.countDistinct(folder) == 1) & ~plain).alias("own")))
    if size.limit(gate + 1).count() <= gate:
        return rows
    tiny = size.where((F.col("n") <= most) & ~F.coalesce("own", F.lit(False))).select("feature")
    large = rows.join(size.where(F.col("n") > most).select("feature"), "feature", "left_semi")
    return _absorbed(rows, rows.join(tiny, "feature", "left_semi").withColumnRenamed("feature", "name"), large)


def is_technical(feature: Column) -> Column:
    """Named for technical layers: a known name, technical words only, or assets of anything."""
    name = F.replace(F.lower(feature), F.lit("_"), F.lit("-"))
    words = F.array_remove(F.split(name, "-"), "")
    return name.isin(*TECHNICAL_NAMES) | name.startswith("assets-") | ((F.size(words) > 0) & (F.size(F.array_except(words, F.array(*map(F.lit, TECHNICAL_WORDS)))) == 0))


def without_technical(files: DataFrame) -> DataFrame:
    """(feature, path): files of technical features under the feature nearest to them all, else each under its own nearest; what is near to none stays. Maps of technical features only stay."""
    rows = cut(files.select("feature", "path").distinct().withColumn("technical", is_technical(F.col("feature"))))
    business, technical = rows.where("not technical").select("feature", "path"), rows.where("technical").select(F.col("feature").alias("name"), "path")
    whole = best_targets(technical, business)
    met = cut(technical.join(whole, "name", "left"))
    each = best_targets(met.where("target is null").select(F.concat_ws("\0", "name", "path").alias("name"), "path"), business)
    single = met.where("target is null").withColumn("key", F.concat_ws("\0", "name", "path")).drop("target").join(each.withColumnRenamed("name", "key"), "key", "left")
    moved = met.where("target is not null").select(F.col("target").alias("feature"), "path").unionByName(single.select(F.coalesce("target", "name").alias("feature"), "path"))
    return business.unionByName(moved)


def coherent(merged: DataFrame, *, least_clusters: int = 3, least_files: int = 15, share: float = 0.3, most_dirs: int = 5) -> DataFrame:
    """(feature, path): merges of `least_clusters` and more clusters with over `least_files` files are undone where the files spread over more than `most_dirs` business directories and more than `share` of their number. merged: (feature, cluster, path)."""
    dirs = F.transform(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), lambda x: F.lower(x))
    business = F.get(F.filter(dirs, lambda x: ~x.isin(*PLAIN_DIRS)), F.lit(0))
    n = merged.groupBy("feature").agg(F.countDistinct("cluster").alias("clusters"), F.countDistinct("path").alias("files"), F.countDistinct(business).alias("dirs"))
    bad = n.where((F.col("clusters") >= least_clusters) & (F.col("files") > least_files) & (F.col("dirs") > F.col("files") * share) & (F.col("dirs") > most_dirs)).select("feature", F.lit(True).alias("undone"))
    return merged.join(bad, "feature", "left").select(F.when(F.col("undone"), F.col("cluster")).otherwise(F.col("feature")).alias("feature"), "path").distinct()


def to_split(files: DataFrame, *, most: int = 40, least: int = 20, share: float = 0.7) -> DataFrame:
    """(feature, files, reason): features to be split anew: over `most` files (`size`), or `least` and more with `share` of them in one directory (`concentration`)."""
    n = files.groupBy("feature", P.parent(F.col("path")).alias("dir")).agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.sum("n").alias("files"), F.max("n").alias("most"))
    reason = F.when(F.col("files") > most, "size").when((F.col("files") >= least) & (F.col("most") >= F.col("files") * share), "concentration")
    return n.select("feature", "files", reason.alias("reason")).where("reason is not null")
