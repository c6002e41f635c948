"""Packages of repositories from their workspace manifests.

trees: (repo, path, content), content null where it isn't a manifest. A manifest's patterns are split at
their first wildcard; what is before it meets the repository's directories as a key, and the rest is matched
within those only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut

# Managers by their manifests, in the order in which they count, and where Nx keeps projects.
MANAGERS = ("pnpm", "npm", "nx", "lerna", "cargo", "go")
NX_DIRS = ("apps", "libs", "packages", "modules")
MANIFESTS = ("package.json", "Cargo.toml", "project.json")


def _plain(items: Column) -> Column:
    """Entries of a list without quotes, blanks, comments and leading ./"""
    bare = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\s\"']+|[\s\"']+$", ""), r"^(!?)(?:\./)+|/+$", "$1"))
    return F.filter(bare, lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def _items(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def patterns(trees: DataFrame) -> DataFrame:
    """(repo, manager, pattern): of each repository the patterns of the first manager that has any. pnpm-workspace.yaml, workspaces of package.json (yarn where there is a yarn.lock), nx.json, lerna.json, Cargo.toml, go.work, all at the top; broken ones count for nothing."""
    text = F.col("content")
    listed = _items(F.regexp_extract(text, r"(?m)^\s*packages:[^\n]*\n((?:[ \t]*(?:#[^\n]*|- [^\n]*)?(?:\n|$))+)", 1), r"(?m)^[ \t]*- (.*)$")
    array = lambda path: F.from_json(F.get_json_object(text, path), "array<string>")
    member = F.split(F.regexp_extract(text, r"(?m)^\s*members[^\n\[]*\[([^\]]*)\]", 1), r"[,\n]")
    used = F.flatten(F.transform(_items(text, r"(?m)^\s*use\s*\(([^)]*)\)"), lambda b: F.split(b, "\n")))
    single = _items(text, r"(?m)^\s*use[ \t]+([^\s(]+)")
    none = F.array().cast("array<string>")
    own = F.when(F.col("path") == "pnpm-workspace.yaml", F.struct(F.lit(0).alias("rank"), _plain(listed).alias("p")))
    own = own.when(F.col("path") == "package.json", F.struct(F.lit(1).alias("rank"), _plain(F.coalesce(array("$.workspaces"), array("$.workspaces.packages"), none)).alias("p")))
    own = own.when(F.col("path") == "nx.json", F.struct(F.lit(2).alias("rank"), F.array(*[F.lit(f"{d}/*") for d in NX_DIRS]).alias("p")))
    broken = F.from_json(text, "map<string,string>").isNull()
    own = own.when((F.col("path") == "lerna.json") & ~broken, F.struct(F.lit(3).alias("rank"), _plain(F.coalesce(array("$.packages"), F.array(F.lit("packages/*")))).alias("p")))
    own = own.when((F.col("path") == "Cargo.toml") & text.contains("[workspace]"), F.struct(F.lit(4).alias("rank"), _plain(member).alias("p")))
    own = own.when(F.col("path") == "go.work", F.struct(F.lit(5).alias("rank"), _plain(F.concat(used, single)).alias("p")))
    told = trees.where("content is not null").select("repo", own.alias("o")).where("o is not null and size(o.p) > 0")
    # nx counts only where it has a project
    project = trees.where(F.col("path").rlike(r"^(?:apps|libs|packages|modules)/[^./][^/]*/(?:project|package)\.json$")).select("repo", F.lit(2).alias("rank")).distinct()
    told = told.select("repo", "o.rank", "o.p").join(project.withColumn("nx", F.lit(True)), ["repo", "rank"], "left").where("rank <> 2 or nx")
    first = told.groupBy("repo").agg(F.min_by(F.struct("rank", "p"), "rank").alias("b"))
    yarn = trees.where("path = 'yarn.lock'").select("repo", F.lit(True).alias("yarn")).distinct()
    name = F.when((F.col("b.rank") == 1) & F.col("yarn"), "yarn").otherwise(F.get(F.array(*map(F.lit, MANAGERS)), F.col("b.rank")))
    return first.join(yarn, "repo", "left").select("repo", name.alias("manager"), F.explode(F.array_distinct("b.p")).alias("pattern"))


def _regex(glob: Column) -> Column:
    """Of a pattern's rest: * within a segment, ** over any number of them, ? for one character."""
    out = F.regexp_replace(glob, r"([.\\+\[\]$(){}|^])", r"\\$1")
    out = F.regexp_replace(out, r"\*\*/", "\u0001")
    out = F.regexp_replace(F.regexp_replace(out, r"\*\*", "\u0002"), r"\*", "[^/]*")
    out = F.regexp_replace(out, r"\?", "[^/]")
    return F.concat(F.lit("^"), F.replace(F.replace(out, F.lit("\u0001"), F.lit("(?:[^/]+/)*")), F.lit("\u0002"), F.lit("[^/]+(?:/[^/]+)*")), F.lit("$"))


def _levels(path: Column) -> Column:
    """All directories above a path."""
    parts = F.split(path, "/")
    return F.transform(F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: (i > 0) & (i < F.size(parts))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def packages(trees: DataFrame) -> DataFrame:
    """(repo, manager, name, root): the directories that the manifests' patterns name. `**` takes children, and deeper directories with a manifest of their own; patterns after ! take directories out again; hidden ones don't count. A package is called as its package.json (without scope) or Cargo.toml says, else as its directory."""
    asked = cut(patterns(trees))
    dirs = cut(trees.select("repo", F.explode(_levels(F.col("path"))).alias("dir")).distinct())
    made = trees.where(F.substring_index("path", "/", -1).isin(*MANIFESTS) & F.col("path").contains("/")).select("repo", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), "path", "content")
    named = F.nullif(F.substring_index(F.get_json_object("content", "$.name"), "/", -1), F.lit(""))
    crate = F.nullif(F.regexp_extract("content", r'(?m)^name\s*=\s*"(.+)"', 1), F.lit(""))
    names = made.groupBy("repo", "dir").agg(F.max(F.when(F.col("path").endswith("/package.json"), named)).alias("npm"), F.max(F.when(F.col("path").endswith("/Cargo.toml"), crate)).alias("crate"))
    bare = F.regexp_replace("pattern", "^!", "")
    head = F.regexp_replace(F.regexp_extract(bare, r"^([^*?]*)", 1), "/?[^/]*$", "")
    rules = asked.withColumns({"taken": ~F.startswith("pattern", F.lit("!")), "bare": bare, "wild": bare.rlike(r"[*?]"), "head": head})
    exact = rules.where("not wild").join(dirs.withColumnRenamed("dir", "bare"), ["repo", "bare"]).select("repo", "manager", "taken", F.col("bare").alias("dir"))
    tops = dirs.select("repo", "dir", F.explode(F.concat(F.array(F.lit("")), _levels(F.col("dir")))).alias("head"))
    met = rules.where("wild").join(tops, ["repo", "head"]).join(names.select("repo", "dir", F.lit(True).alias("has")), ["repo", "dir"], "left")
    below = lambda c: F.when(F.col("head") == "", F.col(c)).otherwise(F.expr(f"substring({c}, length(head) + 2)"))
    deep = below("dir").contains("/") & F.contains("bare", F.lit("**")) & F.col("taken")
    globbed = met.where(F.rlike(below("dir"), _regex(below("bare"))) & (~deep | F.col("has"))).select("repo", "manager", "taken", "dir")
    found = exact.unionByName(globbed).where(~F.substring_index("dir", "/", -1).startswith(".")).groupBy("repo", "manager", "dir").agg(F.min("taken").alias("taken")).where("taken")
    nx = found.where("manager = 'nx'").join(made.where("path not like '%Cargo.toml'").select("repo", "dir"), ["repo", "dir"], "left_semi")
    own = found.where("manager <> 'nx'").unionByName(nx)
    return own.join(names, ["repo", "dir"], "left").select("repo", "manager", F.coalesce("npm", "crate", F.substring_index("dir", "/", -1)).alias("name"), F.col("dir").alias("root"))


def package_files(trees: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, path, root): each file with the innermost package around it, null for files of none."""
    above = trees.select("repo", "path", F.explode(_levels(F.col("path"))).alias("root")).join(found.select("repo", "root"), ["repo", "root"])
    inner = above.groupBy("repo", "path").agg(F.max_by("root", F.length("root")).alias("root"))
    return trees.select("repo", "path").join(inner, ["repo", "path"], "left")
