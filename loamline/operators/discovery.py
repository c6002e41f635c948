"""Entry points, kinds of repositories, alias rules, and features by structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import paths as P
from .rules import PROTECTED

# Names of entry points.
HANDLERS = r"^(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)$|^handle[A-Z]|Handler$|Controller$|Subscriber$|^(?:create|update|delete|fetch|list|get|set|sync)[A-Z]"
# Files of application builders, directories of no product, Python files that start an application.
APP_CONFIGS = "next.config.js next.config.mjs next.config.ts next.config.cjs vite.config.js vite.config.mjs vite.config.ts vite.config.cjs nuxt.config.js nuxt.config.ts astro.config.js astro.config.mjs astro.config.ts remix.config.js remix.config.cjs gatsby-config.js gatsby-config.ts svelte.config.js angular.json vue.config.js expo.json app.json".split()
ASIDE_DIRS = "examples example demo demos playground playgrounds sandbox sandboxes tests test __tests__ e2e www docs documentation site website landing".split()
PY_STARTS = "main.py app.py manage.py asgi.py wsgi.py __main__.py run.py server.py".split()
DEV_SERVERS = r"^(?:next |vite|remix dev|nuxt dev|astro dev)| (?:next |vite|remix dev|nuxt dev|astro dev)"
#: Top directories that are layers.
LAYER_DIRS = "server client backend frontend web mobile lib libs utils utilities helpers common shared core internal runtime vendor bundled compiled types typings models schemas interfaces config configs configuration constants middleware interceptors guards decorators providers adapters drivers connectors scripts tools tooling build dist out generated codegen proto protos test tests __tests__ testing testutils fixtures mocks __mocks__ assets static public media images fonts styles docs documentation examples samples".split()
# Directories and stems that don't split a large feature, and directories that hold no sources.
UNSPLIT_DIRS = "tests test __tests__ migrations templates static".split()
SOURCELESS_DIRS = "tests test __tests__ migrations templates static management templatetags locale".split()
PLAIN_STEMS = "__init__ apps urls admin conftest setup config".split()


def entry_points(symbols: DataFrame, routes: DataFrame) -> DataFrame:
    """(file, symbol, kind, start, stop): for each route of a file the symbol named like its method, else the file's first; and symbols named like handlers that no route has taken.

    symbols: (file, symbol, kind, start, stop); routes: (file, method, pattern).
    """
    own = symbols.groupBy("file", "symbol").agg(F.min_by(F.struct("kind", "start", "stop"), "start").alias("s")).select("file", "symbol", "s.*")
    first = own.groupBy("file").agg(F.min_by("symbol", "start").alias("first"))
    by_method = routes.select("file", F.upper("method").alias("symbol")).distinct().join(first, "file")
    anchors = by_method.join(own.select("file", "symbol", F.lit(True).alias("has")), ["file", "symbol"], "left").select("file", F.when(F.col("has"), F.col("symbol")).otherwise(F.col("first")).alias("symbol")).distinct()
    routed = own.join(anchors, ["file", "symbol"]).select("file", "symbol", F.lit("route").alias("kind"), "start", "stop")
    named = own.where(F.col("symbol").rlike(HANDLERS)).join(anchors, ["file", "symbol"], "left_anti").select("file", "symbol", "kind", "start", "stop")
    return routed.unionByName(named)


def promoted_flows(promotions: DataFrame, entries: DataFrame, features: DataFrame, flows: DataFrame, *, least_confidence: int = 3) -> DataFrame:
    """(flow, owner, file, symbol): new flows whose owner exists, that are sure enough, are no flow yet and have a member among the entry points; the first promotion (by ord) of a name counts.

    promotions: (ord, flow, owner, confidence, file, symbol), a row for each member; entries: (file, symbol); flows: (flow).
    """
    ok = promotions.where((F.col("confidence") >= least_confidence) & (F.trim("flow") != "")).join(features.select(F.col("feature").alias("owner")), "owner", "left_semi").join(flows.select("flow"), "flow", "left_anti").join(entries.select("file", "symbol").distinct(), ["file", "symbol"], "left_semi")
    first = ok.groupBy("flow").agg(F.min("ord").alias("ord"))
    return ok.join(first, ["flow", "ord"]).select("flow", "owner", "file", "symbol")


def library_votes(files: DataFrame) -> DataFrame:
    """(repo, app_votes, lib_votes, is_library): what configuration files, manifests and entry files of each repository speak for; a tie is an application.

    files: (repo, path, content); content may be null but for manifests at the top.
    """
    path, name, content = F.col("path"), F.substring_index("path", "/", -1), F.coalesce("content", F.lit(""))
    top = lambda *names: path.isin(*names)
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    aside = F.arrays_overlap(F.slice(F.split(F.lower("path"), "/"), F.lit(1), F.size(F.split("path", "/")) - 1), F.array(*map(F.lit, ASIDE_DIRS)))
    field = lambda p: F.coalesce(F.get_json_object(content, p), F.lit(""))
    exports = (field("$.main") != "") | (field("$.exports") != "") | (field("$.module") != "")
    script = field("$.scripts.start").rlike(DEV_SERVERS) | field("$.scripts.dev").rlike(DEV_SERVERS)
    console = top("pyproject.toml") & content.rlike(r"\[(?:project|tool\.poetry)\.scripts\]") | top("setup.py") & content.contains("console_scripts")
    seen = files.groupBy("repo").agg(
        any_(name.isin(*APP_CONFIGS) & ~aside).alias("built"), any_(name.isin(*APP_CONFIGS) & aside).alias("demo"),
        any_(top("package.json") & exports).alias("exports"), any_(top("package.json") & (field("$.private") == "false")).alias("public"), any_(top("package.json") & script).alias("served"),
        any_(top("pyproject.toml", "setup.py")).alias("py"), any_(top(*PY_STARTS) | console).alias("py_app"),
        any_(top("go.mod")).alias("go"), any_(path.endswith("main.go") & ~path.startswith("vendor/") | path.startswith("cmd/")).alias("go_app"),
        any_(top("Cargo.toml") & content.contains("[lib]")).alias("crate"), any_(top("Cargo.toml")).alias("cargo"), any_(top("Cargo.toml") & content.contains("[[bin]]") | path.endswith("src/main.rs") & ~path.startswith("target/")).alias("bin"),
    )
    c = F.col
    vote = lambda when, n: F.when(when, n).otherwise(0)
    app = vote(c("built"), 2) + vote(c("served"), 1) + vote(c("py") & c("py_app"), 1) + vote(c("go") & c("go_app"), 1) + vote(c("cargo") & c("bin"), 1)
    lib = vote(c("demo") & ~c("built"), 1) + vote(c("exports"), 1) + vote(c("public"), 1) + vote(c("py") & ~c("py_app"), 2) + vote(c("go") & ~c("go_app"), 2) + vote(c("cargo") & c("crate") & ~c("bin"), 2)
    return seen.select("repo", app.cast("long").alias("app_votes"), lib.cast("long").alias("lib_votes")).withColumn("is_library", c("lib_votes") > c("app_votes"))


def layout(files: DataFrame, layers: list[str] | tuple[str, ...] = tuple(LAYER_DIRS)) -> DataFrame:
    """(repo, dirs, ratio, layout): share of layers among each repository's top directories; over half makes the layout one of layers. files: (repo, path)."""
    top = files.where(F.col("path").contains("/")).select("repo", F.split("path", "/")[0].alias("dir")).distinct()
    n = top.groupBy("repo").agg(F.count(F.lit(1)).alias("dirs"), F.count_if(F.lower("dir").isin(*layers)).alias("k"))
    return n.select("repo", "dirs", F.round(F.col("k") / F.col("dirs"), 6).alias("ratio"), F.when(F.col("k") * 2 > F.col("dirs"), "layer").otherwise("feature").alias("layout"))


def alias_rules(packages: DataFrame, owners: DataFrame, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """(canonical, source, variants): names of workspace packages, then of the first owner of code-owner lines; a name of both counts as a package's and keeps the owners' paths.

    packages: (name, root); owners: CODEOWNERS lines (value).
    """
    line = F.regexp_extract("value", r"^\s*([^#\s]\S*)\s+(@\S+)", 0)
    mine = owners.where(line != "").select(F.regexp_extract("value", r"^\s*(\S+)\s+(@\S+)", 1).alias("path"), D.team_name(F.regexp_extract("value", r"^\s*(\S+)\s+(@\S+)", 2)).alias("canonical"))
    rows = packages.select(F.trim("name").alias("canonical"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("path")).unionByName(mine.select("canonical", F.lit(1).alias("rank"), "path"))
    named = rows.where((F.col("canonical") != "") & ~F.col("canonical").isin(*protected))
    return named.groupBy("canonical").agg(F.when(F.min("rank") == 0, "workspace").otherwise("owners").alias("source"), F.array_join(F.array_sort(F.collect_set("path")), "|").alias("variants"))


def structural_features(files: DataFrame) -> DataFrame:
    """(feature, path): each file's first directory that names something; see split_large for what is then too large."""
    return files.select(P.first_segment(F.col("path")).alias("feature"), "path")


def split_large(files: DataFrame, *, most: int = 40, balance: float = 0.7) -> DataFrame:
    """(feature, path, was): features of over `most` files split by the directory below their common one if that gives over two groups and none has `balance` of the files; else by file stem (single files, tests and set-up stay) if that gives over three such groups; else left whole.

    files: (feature, path). All is counted, no group is gathered.
    """
    parts = F.split("path", "/")
    size = files.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.min(parts).alias("low"), F.max(parts).alias("high"))
    same = F.array_position(F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b) & a.isNotNull() & b.isNotNull()), False)
    depth = F.when(same > 0, same - 1).otherwise(F.least(F.size("low"), F.size("high"))).cast("int")
    large = files.join(size.select("feature", "n", depth.alias("depth")).where(F.col("n") > most), "feature")
    sub = F.lower(F.get(parts, F.col("depth")))
    by_dir = F.when((F.col("depth") < F.size(parts) - 1) & ~sub.isin(*UNSPLIT_DIRS), F.concat("feature", F.lit("-"), sub)).otherwise(F.col("feature"))
    stem = D.stem(F.col("path"))
    inside = F.lower(F.get(parts, F.size(parts) - 2))
    plain = F.coalesce(inside.isin(*SOURCELESS_DIRS), F.lit(False)) | stem.isin(*PLAIN_STEMS) | stem.rlike("^tests?_")
    tried = large.select("feature", "path", "n", by_dir.alias("a"), F.when(plain, F.col("feature")).otherwise(F.concat("feature", F.lit("-"), stem)).alias("b0"))
    single = tried.groupBy("feature", F.col("b0")).agg(F.count(F.lit(1)).alias("k")).where("k <= 1").select("feature", "b0", F.lit(True).alias("single"))
    tried = tried.join(single, ["feature", "b0"], "left").withColumn("b", F.when(F.col("single"), F.col("feature")).otherwise(F.col("b0")))

    def fits(group: str, over: int, always: bool) -> DataFrame:
        k = tried.groupBy("feature", "n", F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("k"))
        groups = F.count(F.lit(1)) + (F.lit(1) - F.max(F.when(F.col("g") == F.col("feature"), 1).otherwise(0)) if always else F.lit(0))  # the parent's group counts though it may be empty
        return k.groupBy("feature", "n").agg(groups.alias("groups"), F.max("k").alias("top")).where((F.col("groups") > over) & (F.col("top") < F.col("n") * balance)).select("feature", F.lit(True).alias(f"by_{group}"))

    met = tried.join(fits("a", 2, False), "feature", "left").join(fits("b", 3, True), "feature", "left")
    split = met.select(F.when(F.col("by_a"), F.col("a")).when(F.col("by_b"), F.col("b")).otherwise(F.col("feature")).alias("feature"), "path", F.col("feature").alias("was"))
    small = files.join(size.where(F.col("n") > most).select("feature"), "feature", "left_anti").select("feature", "path", F.col("feature").alias("was"))
    return small.unionByName(split)


def injected(names: DataFrame, given: DataFrame) -> DataFrame:
    """(repo, feature, given): names under which flows or descriptions were given, matched to features: equal, else for each feature in order the first unused name that contains it, is contained in it, or is its singular or plural.

    names: (repo, ord, feature); given: (repo, ord, name). As each match uses a name up, the features of one repository are matched in one row; their number is a repository's features, not its files.
    """
    g = given.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("given"))
    f = names.groupBy("repo").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "feature"))), lambda x: x["feature"]).alias("own"))
    bare = lambda x: F.regexp_replace(x, "s+$", "")

    def near(a: Column, b: Column) -> Column:
        return F.contains(b, a) | F.contains(a, b) | (bare(a) == bare(b))

    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<feature:string,given:string>>").alias("out"))

    def step(done: Column, name: Column) -> Column:
        free = F.filter("given", lambda x: ~F.array_contains(done["used"], x) & near(name, x))
        pick = F.when(F.array_contains("given", name), name).when(F.size(free) > 0, F.get(free, F.lit(0))).otherwise(none)
        return F.struct(F.when(pick.isNull(), done["used"]).otherwise(F.array_append(done["used"], pick)).alias("used"), F.when(pick.isNull(), done["out"]).otherwise(F.array_append(done["out"], F.struct(name.alias("feature"), pick.alias("given")))).alias("out"))

    return f.join(g, "repo").select("repo", F.inline(F.aggregate("own", start, step)["out"]))


def cross_validated(flows: DataFrame, verdicts: DataFrame, features: DataFrame, *, least_confidence: int = 4) -> DataFrame:
    """(flow, owner, dropped): flows that a second judge drops, or gives another owner that exists, if it is sure; the surest verdict counts. verdicts: (flow, action, target, confidence)."""
    known = features.select(F.col("feature").alias("target"), F.lit(True).alias("exists"))
    sure = verdicts.where(F.col("confidence") >= least_confidence).join(known, "target", "left").where("action = 'drop' or exists")
    best = sure.groupBy("flow").agg(F.max_by(F.struct("action", "target"), F.struct("confidence", "action", "target")).alias("v"))
    return flows.select("flow", "owner").join(best, "flow", "left").select("flow", F.when(F.col("v.action") == "move", F.col("v.target")).otherwise(F.col("owner")).alias("owner"), F.coalesce(F.col("v.action") == "drop", F.lit(False)).alias("dropped"))


def ranked(rows: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key."""
    return rows.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("i") <= most).drop("i")
