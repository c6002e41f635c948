"""Candidate features of repositories from their file trees alone.

Every file is claimed once, by the earliest phase that can name it: (1) an anchor directory, (2) a support
directory whose stems are anchors' stems, (3) a hook, directory or file stem that is one, (4) its first
telling directory. Groups are then folded by count: (5) those seen in one kind of interface directory only,
(6) singular with plural, and small ones with a larger one whose name begins theirs. Repositories of
Django apps are recognised first and split by app.

files: (repo, path). Stems meet anchors as keys (equal beginnings and parts), never each with each. Where
the order of files matters it is that of their paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import paths as P
from .graph import cut
from .lookups import stem_matches

# Directories and names by what they say of candidates.
ANCHORS = ("routers", "routes", "endpoints", "controllers", "views", "pages", "screens", "features", "apps", "blueprints", "handlers")
DEEP_ANCHORS = ("components", "containers", "modules", "store", "stores", "composables", "services")
SUPPORT = (
    "services", "service", "models", "schemas", "serializers", "utils", "helpers", "lib", "agent", "agents", "skills", "tasks", "jobs", "workers", "middleware",
    "hooks", "stores", "context", "contexts", "providers", "components", "queries", "mutations",
)
GENERIC_CHILDREN = ("ui", "common", "shared", "layout", "layouts", "base", "icons", "primitives", "core", "general", "app")
WRAPPERS = ("web", "api", "admin", "server", "client", "frontend", "backend", "mobile", "desktop", "docs", "cli", "common", "shared", "main", "app", "core", "src")
PLAIN_FILES = ("__init__", "index", "base", "main")
PASSED_OVER = ("src", "app", "core", "lib", "web", "api", "ce", "ee", "packages", "apps", "internal", "public", "types", "constants")
INTERFACE_ONLY = ("components", "containers")
DJANGO_FILES = ("models.py", "views.py", "apps.py", "urls.py", "admin.py", "serializers.py", "tasks.py", "forms.py", "signals.py", "permissions.py", "managers.py", "filters.py", "schema.py")
HOOK = r"^use[-_]?([A-Z][a-zA-Z]+|[a-z][-a-z]+)"


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def _dirs(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def _positions(items: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(items)), lambda i: i < F.size(items))


def _first(items: Column) -> Column:
    return F.get(F.filter(items, lambda x: x.isNotNull()), F.lit(0))


def django_apps(files: DataFrame, *, least_files: int = 2, least_apps: int = 4) -> tuple[DataFrame, DataFrame]:
    """(repo) of repositories with at least `least_apps` apps, and (repo, path, feature) of their files that an app has.

    An app is a package with `least_files` of Django's files and no settings; once a repository is known, one
    such file is enough beside other apps. A file is of the innermost app around it, or of the app that its
    second, third or fourth path part names (repo/graphql/<app>/..); other files are no app's.
    """
    own = files.select("repo", "path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), P.file_name(F.col("path")).alias("file"))
    packages = own.where("dir <> ''").groupBy("repo", "dir").agg(F.bool_or(F.col("file") == "__init__.py").alias("package"), F.count_distinct(F.when(F.col("file").isin(*DJANGO_FILES), F.col("file"))).alias("n"), F.bool_or(F.col("file") == "settings.py").alias("root"))
    able = cut(packages.where("package and not root and n > 0").select("repo", "dir", "n", F.regexp_extract("dir", "^(.*)/[^/]*$", 1).alias("above"), F.substring_index("dir", "/", -1).alias("app")))
    strict = able.where(F.col("n") >= least_files)
    repos = cut(strict.groupBy("repo").agg(F.count(F.lit(1)).alias("apps")).where(F.col("apps") >= least_apps).select("repo"))
    beside = able.where(F.col("n") < least_files).join(strict.select("repo", "above").distinct(), ["repo", "above"], "left_semi")
    apps = cut(strict.unionByName(beside).join(repos, "repo", "left_semi").select("repo", "dir", "app"))
    mine = files.select("repo", "path").join(repos, "repo", "left_semi")
    levels = F.transform(_positions(_dirs(F.col("path"))), lambda i: F.array_join(F.slice(_dirs(F.col("path")), F.lit(1), i + 1), "/"))
    inside = mine.select("repo", "path", F.explode(levels).alias("dir")).join(apps, ["repo", "dir"]).groupBy("repo", "path").agg(F.max_by("app", F.length("dir")).alias("feature"))
    rest = mine.join(inside, ["repo", "path"], "left_anti").select("repo", "path", F.posexplode(F.slice(_dirs(F.col("path")), 2, 3)).alias("i", "app"))
    named = rest.join(apps.select("repo", "app").distinct(), ["repo", "app"]).groupBy("repo", "path").agg(F.min_by("app", "i").alias("feature"))
    return repos, inside.unionByName(named)


def anchor(path: Column) -> Column:
    """(kind, stem) of the directory that names a file's candidate, or null: the child of a deep anchor, x of a directory `x-router`, the child of an anchor or, in the anchor itself, the file's stem."""
    dirs = _dirs(path)
    low = F.transform(dirs, lambda x: F.lower(x))
    file = P.normal_stem(_stem(P.file_name(path)))
    child = lambda i: F.get(low, i + 1)
    bare = lambda x: F.regexp_replace(x, r"^\((.*)\)$", "$1")
    named = lambda kind, stem: F.struct(kind.alias("kind"), stem.alias("stem"))
    deep = _first(F.transform(_positions(low), lambda i: F.when(F.get(low, i).isin(*DEEP_ANCHORS) & child(i).isNotNull() & ~child(i).isin(*GENERIC_CHILDREN), named(F.get(low, i), P.normal_stem(child(i))))))
    router = _first(F.transform(low, lambda x: F.when(F.endswith(x, F.lit("-router")) & (F.length(x) > 7), named(F.lit("router"), P.normal_stem(F.regexp_replace(x, "-router$", ""))))))
    below = lambda i: F.when(~bare(child(i)).isin(*WRAPPERS), named(F.get(low, i), P.normal_stem(bare(child(i)))))
    last = lambda i: F.when((file != "") & ~file.isin(*PLAIN_FILES), named(F.get(low, i), file))
    plain = _first(F.transform(_positions(low), lambda i: F.when(F.get(low, i).isin(*ANCHORS), F.when(child(i).isNotNull(), below(i)).otherwise(last(i)))))
    out = F.coalesce(deep, router, plain)
    return F.when(out["stem"] != "", out)


def _support_tries(path: Column) -> Column:
    """Stems under which a file of a support directory may be known, best first; empty elsewhere."""
    dirs = F.transform(_dirs(path), lambda x: F.lower(x))
    at = _first(F.transform(_positions(dirs), lambda i: F.when(F.get(dirs, i).isin(*SUPPORT), i)))
    stems = F.array(P.normal_stem(F.get(_dirs(path), at + 1)), P.normal_stem(_stem(P.file_name(path))))
    tries = F.transform(F.filter(stems, lambda s: s.isNotNull()), lambda s: F.struct(s.alias("stem"), F.lit(False).alias("exact_only")))
    return F.when(at.isNotNull(), tries).otherwise(F.filter(tries, lambda s: F.lit(False)))


def _deep_tries(path: Column) -> Column:
    """A hook's subject, the directories from the innermost out (plain ones only count if they are an anchor's very stem), and the file's stem."""
    file = _stem(P.file_name(path))
    hook = F.nullif(F.regexp_extract(file, HOOK, 1), F.lit(""))
    aside = (*PASSED_OVER, *SUPPORT, *DEEP_ANCHORS, *D.AUXILIARY_DIRS, *D.TOOL_DIRS)
    own = F.when(F.length(P.normal_stem(file)) >= 3, F.struct(P.normal_stem(file).alias("stem"), F.lit(False).alias("exact_only")))
    first = F.when(hook.isNotNull(), F.struct(P.normal_stem(hook).alias("stem"), F.lit(False).alias("exact_only")))
    dirs = F.transform(F.reverse(_dirs(path)), lambda x: F.struct(P.normal_stem(x).alias("stem"), F.lower(x).isin(*aside).alias("exact_only")))
    return F.array_compact(F.concat(F.array(first), dirs, F.array(own)))


def _claimed(files: DataFrame, tries: Column, anchors: DataFrame) -> DataFrame:
    """(repo, path, candidate) of files whose first trying stem that matches an anchor's."""
    each = cut(files.select("repo", "path", F.posexplode(tries).alias("i", "t")).select("repo", "path", "i", "t.stem", "t.exact_only").where("stem <> ''"))
    met = stem_matches(each.select("repo", "stem"), anchors, keys=["repo"])
    exact = anchors.select("repo", "stem").distinct().withColumn("is_anchor", F.lit(True))
    hit = each.join(met, ["repo", "stem"]).join(exact, ["repo", "stem"], "left").where("not exact_only or is_anchor")
    return hit.groupBy("repo", "path").agg(F.min_by("candidate", "i").alias("candidate"))


def claims(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(repo, path, candidate, phase) of phases 1 to 4, and (repo, candidate, kind): the directories that a candidate was seen in. Set-up files have no claim."""
    own = cut(files.select("repo", "path").distinct().where(~D.is_infra(F.col("path"))).withColumn("a", anchor(F.col("path"))))
    first = own.where("a is not null").select("repo", "path", F.col("a.stem").alias("candidate"), F.col("a.kind").alias("kind"))
    parts = F.split("candidate", "[_-]")
    variants = F.concat(F.array("candidate"), F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>")))
    anchors = cut(first.select("repo", "path", "candidate", F.explode(F.array_distinct(variants)).alias("stem")).groupBy("repo", "stem").agg(F.min("path").alias("ord"), F.max_by("candidate", "path").alias("candidate")))
    rest = own.where("a is null").select("repo", "path")
    second = cut(_claimed(rest, _support_tries(F.col("path")), anchors))
    rest = rest.join(second, ["repo", "path"], "left_anti")
    third = cut(_claimed(rest, _deep_tries(F.col("path")), anchors))
    rest = rest.join(third, ["repo", "path"], "left_anti").withColumn("named", P.first_segment(F.col("path")))
    loose = _claimed(rest.where("named = 'root'"), F.array(F.struct(F.replace(F.lower(_stem(P.file_name(F.col("path")))), F.lit("-"), F.lit("_")).alias("stem"), F.lit(False).alias("exact_only"))), anchors)
    fourth = rest.join(loose, ["repo", "path"], "left").select("repo", "path", F.coalesce("candidate", "named").alias("candidate"))
    every = first.select("repo", "path", "candidate", F.lit(1).alias("phase"))
    for phase, rows in ((2, second), (3, third), (4, fourth)):
        every = every.unionByName(rows.withColumn("phase", F.lit(phase)))
    dirs = F.explode(F.transform(_dirs(F.col("path")), lambda x: F.lower(x))).alias("kind")
    supported = second.unionByName(third).select("repo", "candidate", dirs).where(F.col("kind").isin(*SUPPORT, *DEEP_ANCHORS))
    alike = third.select("repo", "candidate", dirs).where(P.normal_stem(F.col("kind")) == F.col("candidate"))
    seen = first.select("repo", "candidate", "kind").unionByName(supported).unionByName(alike).distinct()
    return cut(every), seen


def without_interface_only(claimed: DataFrame, seen: DataFrame) -> DataFrame:
    """Phase 5: candidates seen in components or containers only become shared-ui."""
    single = seen.groupBy("repo", "candidate").agg(F.count(F.lit(1)).alias("kinds"), F.min("kind").alias("kind")).where((F.col("kinds") == 1) & F.col("kind").isin(*INTERFACE_ONLY)).select("repo", "candidate", F.lit(True).alias("plain"))
    met = claimed.join(single, ["repo", "candidate"], "left")
    return met.withColumn("candidate", F.when(F.col("plain"), "shared-ui").otherwise(F.col("candidate"))).drop("plain")


def _other_numbers(name: Column) -> Column:
    """Singular and plural forms of a name, in the order in which they are tried."""
    cut_ = lambda k: F.expr(f"substring(candidate, 1, length(candidate) - {k})")
    return F.array_compact(F.array(
        F.when(name.endswith("ies"), F.concat(cut_(3), F.lit("y"))), F.when(name.endswith("s") & ~name.endswith("ss"), cut_(1)),
        F.when(~name.endswith("s"), F.concat(name, F.lit("s"))), F.when(name.endswith("y") & ~name.endswith("ey"), F.concat(cut_(1), F.lit("ies"))),
    ))


def _sized(rows: DataFrame) -> DataFrame:
    """(repo, candidate, n, place): candidates by size, largest first, then by name."""
    n = rows.groupBy("repo", "candidate").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(F.desc("n"), "candidate")))


def _settled(names: DataFrame, wishes: DataFrame) -> DataFrame:
    """(repo, candidate, target): wishes (repo, candidate, target, i) that are granted, the first of each: a name joins a target that stays. A target always comes before its name, and chains have at most four links, so four rounds settle all."""
    moved = names.select("repo", "candidate").where(F.lit(False)).withColumn("target", F.lit(""))
    for _ in range(4):
        open_ = wishes.join(moved.select("repo", F.col("candidate").alias("target")), ["repo", "target"], "left_anti")
        moved = cut(open_.groupBy("repo", "candidate").agg(F.min_by("target", "i").alias("target")))
    return moved


def _renamed(rows: DataFrame, moved: DataFrame) -> DataFrame:
    return rows.join(moved, ["repo", "candidate"], "left").withColumn("candidate", F.coalesce("target", "candidate")).drop("target")


def merged_siblings(claimed: DataFrame, least: int = 5) -> DataFrame:
    """Phase 6: of singular and plural the larger takes both; then candidates of fewer than `least` files join the longest beginning of their name (whole parts) that is a larger candidate. One that has itself gone takes nothing."""
    sized = cut(_sized(claimed))
    known = sized.select("repo", F.col("candidate").alias("target"), F.col("place").alias("before"), F.col("n").alias("m"))
    wishes = cut(sized.select("repo", "candidate", "place", F.posexplode(_other_numbers(F.col("candidate"))).alias("i", "target")).join(known, ["repo", "target"]).where("before < place"))
    rows = cut(_renamed(claimed, _settled(sized, wishes.select("repo", "candidate", "target", "i"))))
    sized = cut(_sized(rows))
    known = sized.select("repo", F.col("candidate").alias("target"), F.col("n").alias("m"))
    parts = F.split("candidate", "[-_]")
    lengths = F.reverse(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0))
    heads = F.flatten(F.transform(lengths, lambda k: F.array(F.array_join(F.slice(parts, F.lit(1), k), "-"), F.array_join(F.slice(parts, F.lit(1), k), "_"))))
    wishes = sized.where(F.col("n") < least).select("repo", "candidate", "n", F.posexplode(heads).alias("i", "target")).join(known, ["repo", "target"]).where("m > n and target <> candidate")
    one = cut(wishes.groupBy("repo", "candidate").agg(F.min(F.struct("i", "target")).alias("w")).select("repo", "candidate", "w.target", "w.i"))
    return _renamed(rows, _settled(sized, one))


def detected(files: DataFrame) -> DataFrame:
    """(repo, path, claimed, phase, candidate): each file's candidate as it was claimed, by which phase (0: a Django app), and after all. Set-up files, and files of a Django repository without an app, are left out."""
    repos, apps = django_apps(files)
    rows, seen = claims(files.join(repos, "repo", "left_anti"))
    after = merged_siblings(without_interface_only(rows.withColumn("claimed", F.col("candidate")), seen))
    split = apps.select("repo", "path", F.col("feature").alias("claimed"), F.lit(0).alias("phase"), F.col("feature").alias("candidate"))
    return after.select("repo", "path", "claimed", "phase", "candidate").unionByName(split)
